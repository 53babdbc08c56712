"""Review queue, skill edits, judge votes, held-out suites and other ledgers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.fixed_values import (
    AUTO_DRAIN_SOURCES,
    CHRONIC_MIN,
    INTERVENTIONS,
    LOW_RATING,
    MIN_AFTER,
    PROTECTED_LESSONS,
    REVIEW_EXPIRE_DAYS,
    STALE_PENDING_DAYS,
    STOPWORDS_PROMOTION,
)
from feedloom.functions import checks
from feedloom.operators.measure import days_between, verdict
from feedloom.scale import latest_by_key, prefix_lag, prefix_sums, top_k
from feedloom.session import cut_lineage

def rows() -> Column:
    return F.count(F.lit(1))


# --- review queue -----------------------------------------------------------------------


def queue_age(as_of: str) -> Column:
    return days_between(F.col("detected_at"), F.lit(as_of), on_failure=0)


def urgency(queue: DataFrame, as_of: str, expire_days: int = REVIEW_EXPIRE_DAYS) -> DataFrame:
    """Pending reviews with age, days left and whether they are about to escalate; oldest first."""
    age = queue_age(as_of)
    return (
        queue.where(F.col("status") == "pending")
        .withColumn("age_days", age)
        .withColumn("days_left", expire_days - F.col("age_days"))
        .withColumn("expiring", F.col("age_days") > expire_days)
        .orderBy(F.desc("age_days"))
    )


def queue_stats(queue: DataFrame, as_of: str) -> DataFrame:
    """Records per status with the mean change and the greatest age."""
    return queue.withColumn("_age", queue_age(as_of)).groupBy("status").agg(
        rows().alias("n"),
        F.round(F.avg(F.coalesce("delta", F.lit(0.0))), 4).alias("avg_delta"),
        F.max("_age").alias("max_age"),
        F.min("detected_at").alias("oldest"),
    )


def recidivists(queue: DataFrame) -> DataFrame:
    """Patterns queued more than once, with how each record ended.

    The full ordered path is ``status_path``: it stays a table, because one pattern may
    own a large share of the queue.
    """
    return (
        queue.groupBy("pattern")
        .agg(
            rows().alias("n"),
            F.count_if(F.col("status") == "pending").alias("n_pending"),
            F.count_if(F.col("status") == "approved").alias("n_approved"),
            F.count_if(F.col("status") == "rejected").alias("n_rejected"),
            F.min("detected_at").alias("first_at"),
            F.max("detected_at").alias("last_at"),
        )
        .where(F.col("n") > 1)
    )


def status_path(queue: DataFrame) -> DataFrame:
    """Position of every record in its pattern's history, by detection date then record."""
    return prefix_sums(
        queue.select("pattern", "record_id", "detected_at", "status"),
        ["pattern"],
        ["detected_at", "record_id"],
        {"position": F.lit(1).cast("long")},
    )


def queue_history(queue: DataFrame, audit: DataFrame) -> DataFrame:
    """Queue and audit events of every pattern in order, with the status before each."""
    events = queue.select(
        "pattern", F.col("detected_at").alias("at"), F.lit("queue").alias("kind"), "record_id", F.col("status").alias("event")
    ).unionByName(
        audit.select(
            "pattern", F.col("timestamp").alias("at"), F.lit("audit").alias("kind"), "record_id", F.col("action").alias("event")
        )
    )
    return prefix_lag(events, ["pattern"], ["at", "kind", "record_id"], "event", "previous")


def auto_drain_eligible(queue: DataFrame, sources: Sequence[str], min_age: int, as_of: str) -> DataFrame:
    """Pending records old enough, from sources that may be approved unattended."""
    allowed = sorted(set(sources) & set(AUTO_DRAIN_SOURCES))
    source = F.coalesce(F.col("source"), F.lit("base"))
    return queue.where((F.col("status") == "pending") & source.isin(allowed) & (queue_age(as_of) >= min_age))


def ambiguous_targets(queue: DataFrame) -> DataFrame:
    """Patterns with several pending records: a decision must name the source."""
    return (
        queue.where(F.col("status") == "pending")
        .groupBy("pattern")
        .agg(rows().alias("n_pending"), F.count_distinct(F.coalesce("source", F.lit("base"))).alias("n_sources"))
        .where(F.col("n_pending") > 1)
    )


def apply_decisions(queue: DataFrame, decisions: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(new queue, audit rows).

    A decision names ``record_id, action, reviewer, reason``; it only moves a pending record.
    """
    d = decisions.select("record_id", F.col("action").alias("_action"), F.col("reviewer").alias("_reviewer"), F.col("reason").alias("_reason"))
    joined = queue.join(d, "record_id", "left")
    moved = (F.col("status") == "pending") & F.col("_action").isNotNull()
    new_queue = (
        joined.withColumn("reviewed_at", F.when(moved, F.lit(as_of)).otherwise(F.col("reviewed_at")))
        .withColumn("reviewer", F.when(moved, F.col("_reviewer")).otherwise(F.col("reviewer")))
        .withColumn("status", F.when(moved, F.col("_action")).otherwise(F.col("status")))
        .select(*queue.columns)
    )
    audit = joined.where(moved).select(
        F.lit(as_of).alias("timestamp"),
        "pattern",
        "record_id",
        F.col("_action").alias("action"),
        F.col("_reviewer").alias("reviewer"),
        F.col("_reason").alias("reason"),
        "delta",
        "after_n",
    )
    return new_queue, audit


def bulk_decisions(queue: DataFrame, min_age: int, as_of: str, reviewer: str = "USER") -> DataFrame:
    """Decisions that approve every pending record of at least ``min_age`` days."""
    return queue.where((F.col("status") == "pending") & (queue_age(as_of) >= min_age)).select(
        "record_id", F.lit("approved").alias("action"), F.lit(reviewer).alias("reviewer"), F.lit("bulk-approved").alias("reason")
    )


def not_queued(candidates: DataFrame, queue: DataFrame, source: str) -> DataFrame:
    """Candidates without a pending record of the same pattern from the same source."""
    waiting = queue.where((F.col("status") == "pending") & (F.col("source") == source)).select("pattern").distinct()
    return candidates.join(waiting, "pattern", "left_anti")


def queue_records(candidates: DataFrame, queue: DataFrame, source: str, as_of: str) -> DataFrame:
    """New rows of the review queue for candidates (pattern, delta, after_n, note) not waiting there yet."""
    none = F.lit(None).cast("string")
    return not_queued(candidates, queue, source).select(
        "pattern",
        F.lit(as_of).alias("detected_at"),
        F.col("delta").cast("double").alias("delta"),
        F.col("after_n").cast("int").alias("after_n"),
        F.lit("n/a").alias("obj_verdict"),
        F.lit("n/a").alias("judge_verdict"),
        F.lit("pending").alias("status"),
        none.alias("reviewed_at"),
        none.alias("reviewer"),
        F.lit(source).alias("source"),
        "note",
    )


def queue_merges(candidates: DataFrame, queue: DataFrame, as_of: str) -> DataFrame:
    """Queue rows of merge candidates (survivor, loser, overlaps, counts); the pattern names both."""
    overlap = lambda c: F.col(c).cast("decimal(10,3)").cast("string")
    note = F.concat(
        F.lit("survivor="), "survivor", F.lit(", loser="), "loser", F.lit(", rule_overlap="), overlap("rule_overlap"),
        F.lit(", name_overlap="), overlap("name_overlap"),
    )
    rows_ = candidates.select(
        F.concat("survivor", F.lit("<-"), "loser").alias("pattern"),
        F.lit(None).cast("double").alias("delta"),
        (F.col("survivor_n") + F.col("loser_n")).alias("after_n"),
        note.alias("note"),
    )
    return queue_records(rows_, queue, "lesson_dedup", as_of)


def queue_side_effects(worst: DataFrame, queue: DataFrame, as_of: str) -> DataFrame:
    """Queue rows of the worst side effect of each offending lesson."""
    rate = lambda c: F.col(c).cast("decimal(10,4)").cast("string")
    note = F.concat(
        F.lit("lesson of "), "lesson_date", F.lit(": "), "side_effect_pattern", F.lit(" "), rate("before_rate"), F.lit(" -> "), rate("after_rate")
    )
    rows_ = worst.select(F.col("offending_lesson").alias("pattern"), "delta", "after_n", note.alias("note"))
    return queue_records(rows_, queue, "held_out_regression", as_of)


def queue_promotions(candidates: DataFrame, queue: DataFrame, as_of: str) -> DataFrame:
    """Queue rows of labels carried by enough sessions (label, sessions, avg_rating)."""
    note = F.concat(F.lit("sessions="), F.col("sessions").cast("string"), F.lit(", avg_rating="), F.col("avg_rating").cast("decimal(10,4)").cast("string"))
    rows_ = candidates.select(F.col("label").alias("pattern"), F.lit(None).cast("double").alias("delta"), F.col("sessions").alias("after_n"), note.alias("note"))
    return queue_records(rows_, queue, "pattern_promotion", as_of)


# --- skills ---------------------------------------------------------------------------------


def by_skill(ratings: DataFrame) -> DataFrame:
    """One row per (session, attributed skill): the primary skill or any candidate."""
    names = F.array_distinct(
        F.transform(F.concat(F.array("skill"), F.coalesce("skill_candidates", F.array().cast("array<string>"))), F.lower)
    )
    return ratings.withColumn("attributed", F.explode(F.array_except(names, F.array(F.lit(""), F.lit(None)))))


def daily_skill_sessions(ratings: DataFrame) -> DataFrame:
    """(attributed, day, timed, n, low_n): one row per skill and day, so a skill that owns
    most sessions costs one row per day in later joins."""
    return (
        by_skill(ratings)
        .groupBy(
            "attributed",
            F.substring("timestamp", 1, 10).alias("day"),
            (F.length("timestamp") > 10).alias("timed"),
        )
        .agg(rows().alias("n"), F.count_if(F.col("rating") <= LOW_RATING).alias("low_n"), F.max("timestamp").alias("newest"))
    )


def _after_edit(edits: DataFrame, daily: DataFrame) -> DataFrame:
    """Per edit: sessions of its skill overall and after it was applied.

    The comparison is textual: a timestamp on the day of the edit counts as after it.
    """
    joined = edits.join(daily, F.col("skill") == F.col("attributed"), "left")
    after = (F.col("day") > F.col("applied")) | ((F.col("day") == F.col("applied")) & F.col("timed"))
    total = lambda c, cond=None: F.coalesce(
        F.sum(F.when(cond, F.col(c)) if cond is not None else F.col(c)), F.lit(0)
    )
    return joined.groupBy(*edits.columns).agg(
        total("n", after).alias("post_n"),
        total("low_n", after).alias("_post_low"),
        total("n").alias("all_n"),
        total("low_n").alias("_all_low"),
        F.max("newest").alias("newest"),
    )


def _share(low: str, n: str) -> Column:
    return F.when(F.col(n) > 0, F.col(low) / F.col(n)).otherwise(0.0)


def skill_gate(ratings: DataFrame, edits: DataFrame, min_low: int = 3, min_rate: float = 0.4) -> DataFrame:
    """Skills that qualify for an edit, with their dominant failure pattern.

    Needs ``min_low`` low sessions and a low share of ``min_rate``, no active edit, and a
    dominant pattern that was not tried and reverted before.
    """
    low = F.col("rating") <= LOW_RATING
    # The empty label counts all sessions of a skill, so one scan gives rates and patterns.
    labels = F.concat(
        F.array(F.lit("")),
        F.when(low, F.filter("patterns", lambda p: p != "other")).otherwise(F.array().cast("array<string>")),
    )
    per_label = (
        by_skill(ratings)
        .select("attributed", low.alias("_low"), (F.lower("skill") == F.col("attributed")).alias("_own"), F.explode(labels).alias("pattern"))
        .groupBy("attributed", "pattern")
        .agg(rows().alias("c"), F.count_if("_low").alias("_low_n"), F.count_if(F.col("_low") & F.col("_own")).alias("_own_low"))
    )
    whole = F.col("pattern") == ""
    rates = per_label.groupBy("attributed").agg(
        F.max(F.when(whole, F.col("c"))).alias("n"),
        F.max(F.when(whole, F.col("_low_n"))).alias("low_n"),
        F.max(F.when(whole, F.col("_own_low"))).alias("_primary_low"),
        F.min_by(
            F.when(~whole, F.col("pattern")), F.when(~whole, F.struct((-F.col("c")).alias("c"), F.col("pattern").alias("p")))
        ).alias("pattern"),
    )
    active = edits.where(F.col("status") == "active").select(F.col("skill").alias("attributed")).distinct()
    reverted = edits.where(F.col("status") == "reverted").select(F.col("skill").alias("attributed"), "pattern").distinct()
    return (
        rates.where((F.col("low_n") >= min_low) & (F.col("low_n") / F.col("n") >= min_rate) & (F.col("_primary_low") > 0))
        .join(active, "attributed", "left_anti")
        .withColumn("pattern", F.coalesce("pattern", F.lit("general_quality")))
        .join(reverted, ["attributed", "pattern"], "left_anti")
        .select(F.col("attributed").alias("skill"), "n", "low_n", F.round(F.col("low_n") / F.col("n"), 4).alias("rate"), "pattern")
    )


def edit_outcomes(edits: DataFrame, ratings: DataFrame, min_after: int = MIN_AFTER) -> DataFrame:
    """Active edits judged on the sessions after them: confirmed, reverted or still active."""
    counted = _after_edit(edits.where(F.col("status") == "active"), daily_skill_sessions(ratings))
    rate = _share("_post_low", "post_n")
    v = verdict(F.col("baseline_fail_rate"), rate, F.col("post_n"), min_after)
    return counted.withColumn("verdict", v).select(
        "skill",
        "pattern",
        "applied",
        "post_n",
        F.round(rate, 3).alias("post_fail_rate"),
        "verdict",
        F.when(F.col("verdict").isin("flat", "regressed"), "reverted")
        .when(F.col("verdict").isin("working", "improving", "resolved"), "confirmed")
        .otherwise("active")
        .alias("new_status"),
    )


def burn_in(edits: DataFrame, ratings: DataFrame, min_after: int = MIN_AFTER) -> DataFrame:
    """Active edits with a provisional verdict from all sessions of the skill."""
    counted = _after_edit(edits.where(F.col("status") == "active"), daily_skill_sessions(ratings))
    every = _share("_all_low", "all_n")
    v = verdict(F.col("baseline_fail_rate"), every, F.greatest("all_n", F.lit(min_after)), min_after)
    confirm = (
        (F.col("all_n") >= min_after)
        & F.col("provisional_verdict").isin("working", "improving", "resolved")
        & (every < F.col("baseline_fail_rate") - 0.005)
    )
    return counted.withColumn("provisional_verdict", v).select(
        "skill",
        "pattern",
        "applied",
        "post_n",
        F.when(F.col("post_n") > 0, F.round(_share("_post_low", "post_n"), 3)).alias("post_fail_rate"),
        "all_n",
        F.round(every, 3).alias("all_fail_rate"),
        "provisional_verdict",
        (F.col("post_n") < min_after).alias("needs_live_sessions"),
        confirm.alias("provisional_confirm"),
    )


def stall(edits: DataFrame, ratings: DataFrame, as_of: str, stall_days: int = STALE_PENDING_DAYS) -> DataFrame:
    """Park active edits that saw no traffic for too long; wake stalled ones that now have some."""
    counted = _after_edit(edits, daily_skill_sessions(ratings))
    age = days_between(F.substring("applied", 1, 10), F.lit(as_of), on_failure=-1)
    status = (
        F.when((F.col("status") == "active") & (age > stall_days) & (F.col("post_n") == 0), "stalled")
        .when((F.col("status") == "stalled") & (F.col("post_n") > 0), "active")
        .otherwise(F.col("status"))
    )
    return counted.select(
        "skill", "pattern", "applied", F.col("status").alias("old_status"), status.alias("new_status"), "post_n", "newest"
    )


def prior_failed(edits: DataFrame, k: int = 5) -> DataFrame:
    """Last k reverted edits of each skill."""
    return top_k(
        edits.where(F.col("status") == "reverted"), ["skill"], [F.desc("applied"), F.col("pattern")], k
    )


# --- judge ------------------------------------------------------------------------------------


_WORD = 62  # passes held by one long


def judge_quorum(votes: DataFrame, patterns: Sequence[str], quorum: int) -> DataFrame:
    """Full (turn, pattern) matrix by majority over ``quorum`` passes.

    One aggregate per turn keeps the flagging passes of every pattern as bits, ``_WORD`` passes in a long,
    and no turn x pattern join is needed.
    """
    need = quorum // 2 + 1
    flag = F.col("flagged") & F.col("pass_no").between(0, quorum - 1)
    words = -(-quorum // _WORD)
    bit = F.expr(f"shiftleft(1L, CAST(pass_no % {_WORD} AS INT))")
    aggs = []
    for i, p in enumerate(patterns):
        mine = flag & (F.col("pattern") == p)
        for w in range(words):
            own = mine & F.col("pass_no").between(w * _WORD, (w + 1) * _WORD - 1)
            aggs.append(F.bit_or(F.when(own, bit)).alias(f"_w{i}_{w}"))
        aggs.append(
            F.min_by(
                F.when(mine, F.substring("evidence", 1, 160)),
                F.when(mine, F.struct("pass_no", "evidence")),
            ).alias(f"_e{i}")
        )
    passes = lambda i: reduce(Column.__add__, [F.coalesce(F.bit_count(f"_w{i}_{w}"), F.lit(0)) for w in range(words)])
    per_turn = votes.groupBy("timestamp", "session_id").agg(*aggs)
    rows = [
        F.struct(
            F.lit(p).alias("pattern"),
            (passes(i) < need).alias("passed"),
            F.when(passes(i) >= need, F.col(f"_e{i}")).otherwise("").alias("evidence"),
        )
        for i, p in enumerate(patterns)
    ]
    return per_turn.select("timestamp", "session_id", F.inline(F.array(*rows)))


def judge_batch(queue: DataFrame, n: int = 12) -> tuple[DataFrame, DataFrame]:
    """(first n turns, the rest) of the judge queue by turn key."""
    batch = queue.orderBy("timestamp", "session_id").limit(n)
    rest = queue.join(batch.select("timestamp", "session_id"), ["timestamp", "session_id"], "left_anti")
    return batch, rest


# --- held-out cases ----------------------------------------------------------------------------


def expectation_errors(cases: DataFrame) -> DataFrame:
    """Add ``errors``: mismatches between expected and scored checks.

    ``cases`` carry ``response`` and ``expect map<eval_id, struct<applied, passed>>``.
    Scores are computed in the same row, so nothing is joined.
    """
    scored = checks.score_map(cases, "response")

    def mismatch(entry: Column) -> Column:
        got = F.element_at("scored", entry["key"])
        want = entry["value"]
        return F.array_compact(
            F.array(
                F.when(got.isNull(), F.concat(entry["key"], F.lit(": missing"))),
                F.when(
                    want["applied"].isNotNull() & (got["applied"] != want["applied"]),
                    F.concat(entry["key"], F.lit(": applied")),
                ),
                F.when(
                    want["passed"].isNotNull() & ~got["passed"].eqNullSafe(want["passed"]),
                    F.concat(entry["key"], F.lit(": passed")),
                ),
                F.when(
                    (want["applied"] == F.lit(False)) & want["passed"].isNull() & got["passed"].isNotNull(),
                    F.concat(entry["key"], F.lit(": not expected to apply")),
                ),
            )
        )

    errors = F.flatten(F.transform(F.map_entries("expect"), mismatch))
    return scored.withColumn("errors", F.sort_array(errors)).withColumn("ok", F.size("errors") == 0).drop("scored")


def suite_run(judged_cases: DataFrame) -> DataFrame:
    """Pass and fail counts per split, per domain and per pattern in one pass."""
    return (
        judged_cases.groupingSets([["split"], ["split", "domain"], ["split", "pattern"]], "split", "domain", "pattern")
        .agg(
            rows().alias("n"),
            F.count_if("ok").alias("passed"),
            F.count_if(~F.col("ok")).alias("failed"),
            F.round(F.count_if("ok") / rows(), 4).alias("pass_rate"),
        )
    )


def baseline_gate(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Per split: change against the stored pass rate and whether it regressed; row ``gate`` sums up:
    the gate passes where no split regressed."""
    base = baseline.select("split", F.col("pass_rate").alias("_base"))
    worse = F.col("pass_rate") < F.col("_base")
    splits = current.join(base, "split").select(
        "split", "pass_rate", F.round(F.col("pass_rate") - F.col("_base"), 4).alias("delta"), worse.alias("regressed"), (~worse).alias("gate_pass")
    )
    none = F.lit(None).cast("double")
    any_worse = F.coalesce(F.bool_or("regressed"), F.lit(False))
    gate = splits.agg(F.lit("gate").alias("split"), none.alias("pass_rate"), none.alias("delta"), any_worse.alias("regressed"), (~any_worse).alias("gate_pass"))
    return splits.unionByName(gate)


def rubric(responses: DataFrame) -> DataFrame:
    """Add ``errors`` and ``ok`` for must-not, must-any and expected checks.

    Rows carry ``response, must_not_match array, must_match_any array, expect map``.
    """
    checked = expectation_errors(responses).withColumnRenamed("errors", "_check_errors")
    low = F.lower(F.coalesce(F.col("response"), F.lit("")))
    bad = F.transform(
        F.filter("must_not_match", lambda m: low.contains(F.lower(m))), lambda m: F.concat(F.lit("forbidden: "), m)
    )
    missed = (F.size("must_match_any") > 0) & ~F.exists("must_match_any", lambda m: low.contains(F.lower(m)))
    errors = F.concat(bad, F.when(missed, F.array(F.lit("nothing required matched"))).otherwise(F.array().cast("array<string>")), F.col("_check_errors"))
    return checked.withColumn("errors", errors).withColumn("ok", F.size("errors") == 0).drop("_check_errors")


def rubric_summary(judged: DataFrame, floor: float = 0.75) -> DataFrame:
    """Pass rate per split against the acceptance floor."""
    return (
        judged.groupBy("split")
        .agg(rows().alias("n"), F.count_if("ok").alias("passed"), F.round(F.count_if("ok") / rows(), 4).alias("pass_rate"))
        .withColumn("accepted", F.col("pass_rate") >= floor)
    )


def pass_k(trials: DataFrame, k: int) -> DataFrame:
    """One row: share of tasks where all of the first k trials pass, and where any does.

    Tasks with fewer than k trials are left out.
    """
    per = (
        trials.where(F.col("trial_no") < k)
        .groupBy("task")
        .agg(rows().alias("n"), F.bool_and("ok").alias("every"), F.bool_or("ok").alias("some"))
        .where(F.col("n") >= k)
    )
    return per.agg(
        rows().alias("tasks"),
        F.round(F.avg(F.col("every").cast("int")), 4).alias("pass_hat_k"),
        F.round(F.avg(F.col("some").cast("int")), 4).alias("pass_at_k"),
    )


# --- promotion ---------------------------------------------------------------------------------


def latest_labels(ledger: DataFrame) -> DataFrame:
    """Latest label of each session."""
    return latest_by_key(ledger, ["session_id"], [F.col("labeled_at"), F.col("label")])


def promotion_candidates(ledger: DataFrame, min_sessions: int = 3) -> DataFrame:
    """Pending labels carried by enough distinct sessions; a zero rating is no rating."""
    return (
        latest_labels(ledger)
        .where(F.col("status") == "pending")
        .groupBy("label")
        .agg(
            rows().alias("sessions"),
            F.round(F.coalesce(F.avg(F.when(F.col("rating") != 0, F.col("rating"))), F.lit(0.0)), 4).alias("avg_rating"),
        )
        .where(F.col("sessions") >= min_sessions)
    )


def suggest_keywords(ledger: DataFrame, top: int = 6) -> DataFrame:
    """Starter keywords of each pending label: its own words, then its frequent tokens.

    Tokens are counted by occurrence; ties go to the alphabet.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce("sentiment_summary", F.lit(""))), F.lit("([a-z]{4,})"), F.lit(1))
    kept = F.filter(words, lambda w: ~w.isin(STOPWORDS_PROMOTION))
    counts = (
        latest_labels(ledger)
        .where(F.col("status") == "pending")
        .select("label", F.explode_outer(kept).alias("token"))
        .groupBy("label", "token")
        .agg(F.count("token").alias("n"))
    )
    ranked = top_k(counts, ["label"], [F.desc("n"), F.col("token")], top)
    own = F.filter(F.split("label", "_"), lambda w: w != "")
    picked = F.transform(F.array_sort(F.collect_list(F.struct("rank", "token"))), lambda r: r["token"])
    return ranked.groupBy("label").agg(picked.alias("_t")).select(
        "label", F.concat(own, F.array_except(F.array_compact("_t"), own)).alias("keywords")
    )


def enforcement_candidates(
    log: DataFrame, eligible: DataFrame, overrides: DataFrame, queue: DataFrame, as_of: str, days: int = 14, min_fires: int = 5
) -> DataFrame:
    """Patterns in warn mode that fired often enough in the trailing window.

    Only the patterns of ``eligible`` (pattern), those whose mode is a matter of configuration, count.
    """
    cutoff = F.to_timestamp(F.lit(as_of)) - F.make_dt_interval(F.lit(days))
    fires = log.join(eligible.select("pattern").distinct(), "pattern", "left_semi").groupBy("pattern").agg(
        F.count_if(F.col("ts") >= cutoff).alias("fires_in_window"), rows().alias("total_fires")
    )
    joined = fires.join(overrides.select("pattern", F.col("mode").alias("_mode")), "pattern", "left").where(
        F.coalesce("_mode", F.lit("warn")) == "warn"
    )
    return not_queued(joined.where(F.col("fires_in_window") >= min_fires), queue, "enforcement_promotion").drop("_mode")


# --- lessons ----------------------------------------------------------------------------------


def chronic(
    scores: DataFrame, overrides: DataFrame, audit: DataFrame, queue: DataFrame, edits: DataFrame, bullets: DataFrame, snapshots: DataFrame
) -> DataFrame:
    """Regressed patterns: which interventions were tried, which is next, and how often
    the pattern has been on top of the list."""
    n_audit = audit.groupBy("pattern").agg(rows().alias("_audit"))
    n_pending = queue.where(F.col("status") == "pending").groupBy("pattern").agg(rows().alias("_pending"))
    n_edits = edits.groupBy("pattern").agg(rows().alias("_edits"))
    quality = bullets.groupBy("pattern").agg(F.max(F.coalesce("quality", F.lit(0))).alias("ace_quality"), rows().alias("_bullets"))
    last = latest_by_key(snapshots.select("pattern", "taken_at", "top_hits"), ["pattern"], [F.col("taken_at")])
    joined = scores.where(F.col("verdict") == "regressed").select("pattern")
    for side in (
        n_audit, n_pending, n_edits, quality, last.select("pattern", F.col("top_hits").alias("_hits")),
        overrides.select("pattern", (F.col("mode") == "block").alias("_blocked")),
    ):
        joined = joined.join(side, "pattern", "left")
    some = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    blocked = F.coalesce(F.col("_blocked"), F.lit(False))
    tried = F.array_compact(
        F.array(
            F.when(some("_audit"), "lesson"),
            F.when(some("_bullets"), "ace_bullet"),
            F.when(blocked, "enforcement_block"),
            F.when(some("_edits"), "skill_guardrail"),
            F.when(some("_pending"), "human_pairing"),
        )
    )
    untried = F.array_except(F.array(*[F.lit(i) for i in INTERVENTIONS]), tried)
    is_chronic = blocked & (F.coalesce("_audit", F.lit(0)) >= CHRONIC_MIN)
    return joined.select(
        "pattern",
        is_chronic.alias("chronic"),
        blocked.alias("blocked"),
        F.coalesce("_audit", F.lit(0)).alias("audit_entries"),
        F.coalesce("_pending", F.lit(0)).alias("pending_entries"),
        "ace_quality",
        F.coalesce("_edits", F.lit(0)).alias("skill_edits"),
        untried.alias("untried"),
        F.coalesce(F.get(untried, F.lit(0)), F.lit("human_pairing (repeat)")).alias("next_intervention"),
        F.when(is_chronic, F.coalesce("_hits", F.lit(0)) + 1).otherwise(0).alias("top_hits"),
    )


def retire(lessons: DataFrame, scores: DataFrame, retire_days: int = 14, max_occurrences: int = 3) -> DataFrame:
    """Unprotected lessons that never gathered evidence."""
    joined = lessons.join(scores.select("pattern", "verdict", "after_n", "days_open"), "pattern", "left")
    v = F.coalesce("verdict", F.lit("pending"))
    after_n, days = F.coalesce("after_n", F.lit(0)), F.coalesce("days_open", F.lit(0))
    stale = (v == "stale-pending") & (days >= retire_days)
    zombie = (
        (v == "pending")
        & (after_n <= 1)
        & (F.coalesce("occurrence_count", F.lit(0)) <= max_occurrences)
        & (days >= retire_days)
    )
    reason = F.when(stale, "stale-pending").when(zombie, "pending zombie")
    return joined.where(~F.col("pattern").isin(PROTECTED_LESSONS) & (stale | zombie)).select("pattern", reason.alias("reason"))


def evolve_eligible(scores: DataFrame, lessons: DataFrame, variants: DataFrame, as_of: str, cooldown_days: int = 7) -> DataFrame:
    """Flat or regressed lessons whose last proposal is old enough."""
    v = (
        F.when(F.col("eval_covered"), F.col("obj_verdict"))
        .when(F.col("judge_covered"), F.col("judge_verdict"))
        .otherwise(F.col("verdict"))
    )
    last = variants.groupBy("pattern").agg(F.max("proposed_at").alias("last_proposed"))
    return (
        scores.select("pattern", v.alias("escalation_verdict"))
        .where(F.col("escalation_verdict").isin("flat", "regressed"))
        .join(lessons.select("pattern").distinct(), "pattern", "left_semi")
        .join(last, "pattern", "left")
        .where(
            F.col("last_proposed").isNull()
            | (days_between(F.col("last_proposed"), F.lit(as_of), on_failure=9999) >= cooldown_days)
        )
    )


def resolve_merges(candidates: DataFrame) -> DataFrame:
    """(survivor, loser) without chains from candidates (survivor, loser, score, survivor_n).

    A loser goes to its most alike survivor, the one with more occurrences on a tie; where that
    one is itself a loser, to its survivor, and so on.  A survivor always has more occurrences or
    the lower name, so there are no rings; each round doubles the steps taken.
    """
    best = F.min_by("survivor", F.struct((-F.col("score")).alias("s"), (-F.col("survivor_n")).alias("n"), F.col("survivor").alias("p")))
    merges = cut_lineage(candidates.groupBy("loser").agg(best.alias("survivor")))
    while True:
        further = merges.select(F.col("loser").alias("survivor"), F.col("survivor").alias("_root"))
        step = cut_lineage(merges.join(further, "survivor", "left").select("loser", "survivor", "_root"))
        if not step.where("_root IS NOT NULL").take(1):
            return merges.select("survivor", "loser")
        merges = step.select("loser", F.coalesce("_root", "survivor").alias("survivor"))


def apply_merges(lessons: DataFrame, merges: DataFrame) -> DataFrame:
    """Fold losers into survivors: counts add up and losers disappear; what they leave as evidence
    is ``merged_evidence``.

    ``merges`` hold ``survivor, loser`` without chains, as ``resolve_merges`` gives them; of several
    survivors of a loser the lowest name counts.
    """
    merges = merges.groupBy("loser").agg(F.min("survivor").alias("survivor"))
    losers = merges.join(lessons.select(F.col("pattern").alias("loser"), F.col("occurrence_count").alias("_n")), "loser")
    gained = losers.groupBy(F.col("survivor").alias("pattern")).agg(
        F.sum("_n").alias("_gain"), F.count(F.lit(1)).alias("merged_lessons")
    )
    kept = lessons.join(merges.select(F.col("loser").alias("pattern")), "pattern", "left_anti")
    return (
        kept.join(gained, "pattern", "left")
        .withColumn("occurrence_count", F.col("occurrence_count") + F.coalesce("_gain", F.lit(0)))
        .withColumn("merged_lessons", F.coalesce("merged_lessons", F.lit(0)))
        .drop("_gain")
    )


def merged_evidence(lessons: DataFrame, merges: DataFrame) -> DataFrame:
    """(pattern, merged_from, occurrence_count, rule): the evidence survivors inherit, as rows."""
    merges = merges.groupBy("loser").agg(F.min("survivor").alias("survivor"))
    return merges.join(lessons.withColumnRenamed("pattern", "loser"), "loser").select(
        F.col("survivor").alias("pattern"), F.col("loser").alias("merged_from"), "occurrence_count", "rule"
    )


def apply_variant(lessons: DataFrame, variants: DataFrame, choices: DataFrame, as_of: str) -> DataFrame:
    """New lesson snapshot with the chosen wording; the first date stays."""
    chosen = variants.join(choices, ["pattern", "variant_id"]).select("pattern", F.col("text").alias("_text"))
    swapped = F.col("_text").isNotNull()
    return (
        lessons.join(chosen, "pattern", "left")
        .withColumn("rule", F.coalesce("_text", "rule"))
        .withColumn("last_updated", F.when(swapped, F.lit(as_of)).otherwise(F.col("last_updated")))
        .drop("_text")
    )


# --- snapshots and registries ---------------------------------------------------------------------


def file_class(path: Column) -> Column:
    return (
        F.when(path.startswith("lesson_autogen"), "lessons")
        .when(path.endswith(".jsonl"), "ledgers")
        .when(path.startswith("STATE/"), "state")
        .when(path.startswith("held_out_suite/fixtures"), "fixtures")
        .when(path.startswith("DIAGNOSTICS/"), "diagnostics")
        .when(path.endswith(".py"), "scripts")
        .when(path.startswith("commands/"), "skills")
        .otherwise("other")
    )


def snapshot_diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """Files added, changed (time by more than a second, or size) or removed."""
    b = before.select("path", F.col("mtime").alias("_bt"), F.col("size").alias("_bs"))
    joined = now.join(b, "path", "full_outer")
    change = (
        F.when(F.col("_bs").isNull(), "added")
        .when(F.col("size").isNull(), "removed")
        .when((F.abs(F.col("_bt") - F.col("mtime")) > 1.0) | (F.col("_bs") != F.col("size")), "changed")
    )
    return joined.select(
        "path", change.alias("change"), F.col("_bs").alias("old_size"), F.col("size").alias("new_size"), file_class(F.col("path")).alias("kind")
    ).where(F.col("change").isNotNull())


def reconcile_registry(code: DataFrame, registry: DataFrame) -> DataFrame:
    """Grow-only registry: what changes for each check.  Nothing is ever deleted."""
    r = registry.select("eval_id", F.col("version").alias("_version"), F.col("status").alias("_status"))
    joined = code.withColumn("_in_code", F.lit(True)).join(r, "eval_id", "full_outer")
    in_code = F.coalesce("_in_code", F.lit(False))
    changes = F.array_compact(
        F.array(
            F.when(in_code & F.col("_status").isNull(), "added"),
            F.when(in_code & F.col("_status").isNotNull() & ~F.col("_version").eqNullSafe(F.col("version")), "version"),
            F.when(in_code & (F.col("_status") == "retired"), "reactivated"),
            F.when(in_code & (F.col("_status") == "orphaned"), "un-orphaned"),
            F.when(~in_code & (F.col("_status") == "active"), "orphaned"),
        )
    )
    status = F.when(in_code, "active").when(F.col("_status") == "active", "orphaned").otherwise(F.col("_status"))
    return joined.select(
        "eval_id", F.coalesce("version", "_version").alias("version"), status.alias("status"), changes.alias("changes")
    )


# --- episodes --------------------------------------------------------------------------------------


def latest_episodes(rows: DataFrame) -> DataFrame:
    """Latest unflushed row per name, by queue position."""
    usable = rows.where(
        ~F.lower(F.coalesce("status", F.lit("pending"))).isin("flushed", "done", "ok")
        & (F.coalesce("name", F.lit("")) != "")
        & (F.coalesce("episode_body", F.lit("")) != "")
    )
    return latest_by_key(usable, ["name"], [F.col("seq")])


def flush_split(rows: DataFrame, limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """(to flush, remaining): the first ``limit`` names by their first appearance."""
    latest = latest_episodes(rows)
    first = rows.where(F.coalesce("episode_body", F.lit("")) != "").groupBy("name").agg(F.min("seq").alias("_first"))
    todo = latest.join(first, "name").orderBy("_first").limit(limit).drop("_first")
    return todo, latest.join(todo.select("name"), "name", "left_anti")


def new_documents(docs: DataFrame, archive: DataFrame, ledger: DataFrame) -> DataFrame:
    """Documents not ingested yet, by name or by name and content."""
    keyed = docs.withColumn("content_key", F.concat("name", F.lit(":"), F.substring(F.sha2("text", 256), 1, 16)))
    seen = archive.select("name").unionByName(ledger.select("name")).distinct()
    seen_keys = ledger.select(F.col("name").alias("content_key")).distinct()
    return keyed.join(seen, "name", "left_anti").join(seen_keys, "content_key", "left_anti")


def unseen_content(episodes: DataFrame, queued: DataFrame, n: int = 200) -> DataFrame:
    """Episodes whose first 800 characters are not among the newest n queued ones."""
    digest = F.substring(F.sha2(F.substring("episode_body", 1, 800), 256), 1, 16)
    recent = queued.orderBy(F.desc("seq")).limit(n).select(digest.alias("_h"))
    return episodes.withColumn("_h", digest).join(recent.distinct(), "_h", "left_anti").drop("_h")


def negative_results(edits: DataFrame, archive: DataFrame) -> DataFrame:
    """Reverted edits not archived yet, keyed by skill, pattern and date."""
    return edits.where(F.col("status") == "reverted").join(
        archive.select("skill", "pattern", "applied"), ["skill", "pattern", "applied"], "left_anti"
    )


def label_entries(labels: DataFrame, entries: DataFrame) -> DataFrame:
    """Attach each labelled session's entry; labels are keyed by session and timestamp."""
    return labels.join(entries, ["session_id", "timestamp"], "left")


