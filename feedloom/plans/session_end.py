"""The session-end run as one job graph.

Stages hand over tables, not files on one machine.  Scored checks are the one costly
intermediate; they are written once and read by every later stage.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.fixed_values import AUTO_DRAIN_SOURCES
from feedloom.functions import checks
from feedloom.functions import lessons as lesson_text
from feedloom.operators import classify, health, ledger, measure, playbook, reports, similarity
from feedloom.sources import sinks


@dataclass
class Inputs:
    """Tables of one run.  ``lessons``: pattern, rule, occurrence_count, baseline_date.  The stages of an optional table are
    left out where it is not given."""

    ratings: DataFrame
    lessons: DataFrame
    judged: DataFrame
    queue: DataFrame
    prior_scores: DataFrame
    edits: DataFrame
    taxonomy: Mapping[str, Sequence[str]] | DataFrame
    reclass: DataFrame | None = None
    #: Labels of sessions (label, session_id, status, ...): promotions.
    labels: DataFrame | None = None
    #: Fires of warnings with the patterns that may be enforced and the modes now in force.
    enforcement_log: DataFrame | None = None
    enforceable: DataFrame | None = None
    overrides: DataFrame | None = None
    #: Wordings proposed before (pattern, variant_id, proposed date, ...): which lessons may evolve.
    variants: DataFrame | None = None
    #: Held-in and held-out cases with the pass rates of the baseline, and judged responses.
    cases: DataFrame | None = None
    baseline: DataFrame | None = None
    responses: DataFrame | None = None
    #: Decisions so far and earlier playbooks, for chronic failures.
    audit: DataFrame | None = None
    snapshots: DataFrame | None = None
    #: Pending queue rows of these sources, so many days old, are approved unattended.
    drain_sources: Sequence[str] = field(default_factory=lambda: tuple(AUTO_DRAIN_SOURCES))
    drain_age: int = 0
    playbook_size: int = 40


def run(inputs: Inputs, out: str, as_of: str) -> dict[str, str]:
    """Write every result under ``out`` and return their paths."""
    spark = inputs.ratings.sparkSession
    covered = checks.covered_patterns()
    paths: dict[str, str] = {}

    def save(name: str, df: DataFrame) -> DataFrame:
        paths[name] = f"{out}/{name}"
        sinks.write_snapshot(df, paths[name])
        return spark.read.parquet(paths[name])

    # Stage 1: label and score.
    ratings = classify.classify(inputs.ratings, inputs.taxonomy, inputs.reclass)
    results = save("check_results", checks.score_or_captured(ratings, ["timestamp", "session_id", "rating"]))
    save("check_report", reports.check_report(results))
    save("pattern_stats", reports.pattern_stats(ratings))
    save("coverage_gaps", measure.coverage_gaps(ratings, covered))

    # Stage 2: measure and gate.
    scores = save(
        "effectiveness", measure.effectiveness(ratings, inputs.lessons, results, inputs.judged, covered, as_of)
    )
    paths["effectiveness_log"] = f"{out}/effectiveness_log"
    sinks.append_effectiveness(scores, paths["effectiveness_log"], as_of)
    save("escalation", measure.gate_escalation(scores, inputs.queue, inputs.prior_scores, as_of))
    side = save("side_effects", measure.side_effects(ratings, inputs.lessons))
    save("worst_side_effects", measure.worst_side_effect(side))
    save("skill_gate", ledger.skill_gate(ratings, inputs.edits))
    save("edit_outcomes", ledger.edit_outcomes(inputs.edits, ratings))
    save("stalled_edits", ledger.stall(inputs.edits, ratings, as_of))

    save("burn_in", ledger.burn_in(inputs.edits, ratings))

    # Stage 3: tidy up ratings and lessons.
    save("hygiene", reports.hygiene_report(ratings))
    paths["ratings_clean"], paths["ratings_junk"] = f"{out}/ratings_clean", f"{out}/ratings_junk"
    sinks.write_quarantine(ratings, paths["ratings_clean"], paths["ratings_junk"])
    candidates = save("merge_candidates", similarity.merge_candidates(inputs.lessons))
    merges = save("merges", ledger.resolve_merges(candidates))
    lessons = save("lessons", ledger.apply_merges(inputs.lessons, merges))
    save("merged_evidence", ledger.merged_evidence(inputs.lessons, merges))
    save("retired_lessons", ledger.retire(lessons, scores))
    if inputs.variants is not None:
        save("evolve_eligible", ledger.evolve_eligible(scores, lessons, inputs.variants, as_of))

    # Stage 4: what goes to review, and what leaves it unattended.
    proposed = [
        ledger.queue_merges(candidates, inputs.queue, as_of),
        ledger.queue_side_effects(measure.worst_side_effect(side), inputs.queue, as_of),
    ]
    if inputs.labels is not None:
        promotions = save("promotion_candidates", ledger.promotion_candidates(inputs.labels))
        proposed.append(ledger.queue_promotions(promotions, inputs.queue, as_of))
    if inputs.enforcement_log is not None and inputs.enforceable is not None and inputs.overrides is not None:
        fired = ledger.enforcement_candidates(inputs.enforcement_log, inputs.enforceable, inputs.overrides, inputs.queue, as_of)
        save("enforcement_candidates", fired)
    new_rows = save("queue_new", reduce(DataFrame.unionByName, proposed).withColumn("record_id", _record_id(as_of).cast(inputs.queue.schema["record_id"].dataType)))
    queue = inputs.queue.unionByName(new_rows, allowMissingColumns=True)
    drained = ledger.auto_drain_eligible(queue, inputs.drain_sources, inputs.drain_age, as_of)
    decisions = drained.select(
        "record_id", F.lit("approved").alias("action"), F.lit("auto-drain").alias("reviewer"), F.lit("unattended source").alias("reason")
    )
    after, decided = ledger.apply_decisions(queue, decisions, as_of)
    queue = save("queue", after)
    save("queue_audit", decided)
    save("queue_stats", ledger.queue_stats(queue, as_of))

    # Stage 5: held-out cases and judged responses.
    if inputs.cases is not None:
        suite = save("suite", ledger.suite_run(ledger.expectation_errors(inputs.cases)))
        if inputs.baseline is not None:
            whole = suite.where("split IS NOT NULL AND domain IS NULL AND pattern IS NULL")
            save("suite_gate", ledger.baseline_gate(whole, inputs.baseline))
    if inputs.responses is not None:
        judged = save("rubric", ledger.rubric(inputs.responses))
        save("rubric_summary", ledger.rubric_summary(judged))

    # Stage 6: publish.
    section = lesson_text.guess_section(F.col("pattern"), F.col("rule"))
    quality = lesson_text.rule_quality(F.col("rule"))
    written = lessons.select("pattern", "rule", "occurrence_count", section.alias("section"), quality.alias("quality"))
    bullets = save("bullets", playbook.dedupe_bullets(playbook.bullets(written, scores).withColumn("seed", F.lit(False))))
    save("playbook", playbook.playbook_cap(bullets, inputs.playbook_size))
    if inputs.overrides is not None and inputs.audit is not None and inputs.snapshots is not None:
        tried = ledger.chronic(scores, inputs.overrides, inputs.audit, queue, inputs.edits, bullets, inputs.snapshots)
        save("chronic_failures", tried)
    save("triples", playbook.verdict_triples(scores, as_of))
    save("health", health.health_checks(scores, ratings, queue, as_of))
    return paths


def _record_id(as_of: str) -> Column:
    """Id of a new queue row: the same in every run of the day."""
    return F.xxhash64(F.lit(as_of), F.col("source"), F.col("pattern"))
