"""Registry of deterministic pass/fail checks over response text.

A check has a gate (does it apply to this text?) and a test (did the text behave?).
One pass over a text finds the gate words of all checks as a bit set; a gate's expression runs only
where its bits are set, and the shared evidence predicates only where some fired check needs them, so
quiet rows stay cheap.  Gates and tests are native Columns; a check may instead have a ``vector_test``, a
function of a pandas Series, which gets only the texts on which the check's gate fired.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.fixed_values import ARTIFACT_PATTERNS, CHECK_PATTERNS
from feedloom.functions import artifacts
from feedloom.functions.gates import WordGates
from feedloom.functions.regex import column_contains_any, folded, matches

SHARED = {
    "weak": artifacts.weak_artifact,
    "strong": artifacts.strong_artifact,
    "research": lambda text: matches(text, CHECK_PATTERNS["research_trace"]),
}


@dataclass(frozen=True)
class CheckSpec:
    """One check.  ``evidence`` names shared predicates that each satisfy the test;
    ``test`` is an extra predicate that also satisfies it.  With neither, it always fails."""

    eval_id: str
    pattern: str
    gate: Callable[[Column], Column]
    test: Callable[[Column], Column] | None = None
    evidence: tuple[str, ...] = ()
    version: int = 1
    source: str = "manual"
    #: Instead of ``test``: gets the texts on which the gate fired as a Series and gives a boolean for each.
    vector_test: Callable[[pd.Series], pd.Series] | None = None


# Words of which every match of an expression holds one, in lower case, as a whole word.
GATE_WORDS: dict[str, tuple[str, ...]] = {
    "claim": ("done", "complete", "completed", "fixed", "merged", "posted", "deployed", "shipped", "finished", "approved", "full"),
    "hedge": ("think", "believe", "assume", "probably", "should", "likely", "presumably", "must"),
    "post": ("posted", "pushed", "merged", "committed", "commented", "submitted", "published", "sent"),
    "bq_exec": ("bq",),
    "agree": ("right", "correct", "same", "would", "agree", "makes"),
    "technical_claim": ("work", "would", "same"),
    "retry": ("try", "retrying", "running", "still", "failed", "same"),
    "dup_approve": ("approved", "approving", "approval", "reapproved"),
    "dismiss_scope": ("look", "looks", "related", "unrelated", "change", "changes", "nothing", "scope", "same", "you", "youre"),
    "premature_certainty": (
        "works", "false", "nothing", "issue", "issues", "formatting", "noise", "warning", "safely", "problem", "bug", "blocker",
    ),
    "conclusion_claim": ("root", "issue", "problem", "bug", "error", "because", "caused", "due", "reason"),
    "self_correction": ("wrong", "mistake", "correction", "reassess", "actually", "misread", "missed"),
    "pr_approve": ("approved", "approval"),
    "inline_review": ("inline", "review", "comment"),
    "scope_global": ("throughout", "replaced", "across", "globally", "every", "occurrences", "entire"),
    "stale_act": ("based", "earlier", "initial", "previous", "continuing"),
    "post_without_ask": ("posted", "submitted", "comment"),
    "regression_claim": ("fixed", "done", "complete", "resolved"),
    "redundant_rec": ("consider", "try", "recommend", "optional", "nice", "while"),
    "wrong_tool": ("wrong", "incorrect", "tool", "used", "use", "forbidden", "mcp__jira"),
    "approve_claim": ("approved", "approval"),
    "unhelpful_trouble": ("try", "sure", "unclear", "might", "could", "hard", "know"),
    "instruction_forbid": ("said", "asked", "told", "despite", "ignoring", "explicitly", "against"),
    "setup_or_dep_claim": (
        "package", "dependency", "module", "import", "installed", "install", "setup", "modulenotfounderror", "importerror", "client", "block",
    ),
    "airflow_retry_act": ("task", "dag", "dagrun", "up_for_retry", "upstream_failed", "upstream", "trigger", "trigger_rule"),
    "confident_state": (
        "table", "column", "schema", "partition", "partitioned", "job", "dag", "pipeline", "pr", "check", "checks", "ci", "deployment",
        "cluster", "dataset", "view", "topic", "subscription", "production", "already", "row", "there", "tests", "verified", "confirmed",
        "bug", "issue", "error",
    ),
    "metric_claim": (
        "row", "rows", "test", "tests", "file", "files", "byte", "bytes", "partition", "partitions", "column", "columns", "record",
        "records", "pr", "pull", "line", "exit", "took", "latency",
    ),
}
# A second list, for expressions whose first one holds common words.
GATE_ALSO: dict[str, tuple[str, ...]] = {
    "confident_state": (
        "is", "are", "has", "have", "exist", "exists", "contain", "contains", "passed", "failed", "running", "green", "healthy", "empty",
        "missing", "by", "production", "deployed", "merged", "approved", "shows", "pass", "that",
    ),
}
# The same for expressions that may also begin inside a word.
GATE_PARTS: dict[str, tuple[str, ...]] = {
    "jira_mcp": ("mcp__jira",),
    "verify_badge": ("verif",),
    "change_badge": ("change", "fix", "patch", "updated", "added"),
}


def _gate(build: Callable[[Column], Column], names: Sequence[str]) -> Callable[[Column], Column]:
    build.words = [words[n] for n in names for words in (GATE_WORDS, GATE_ALSO) if n in words]
    build.parts = [GATE_PARTS[n] for n in names if n in GATE_PARTS]
    return build


def says(*names: str) -> Callable[[Column], Column]:
    """All named expressions occur."""

    def build(text: Column) -> Column:
        hit = matches(text, CHECK_PATTERNS[names[0]])
        for name in names[1:]:
            hit = hit & matches(text, CHECK_PATTERNS[name])
        return hit

    return _gate(build, names)


def untagged(*names: str) -> Callable[[Column], Column]:
    """All named expressions occur and nothing marks the text as uncertain."""
    base = says(*names)
    return _gate(lambda text: base(text) & ~matches(text, CHECK_PATTERNS["tagged_uncertain"]), names)


def _first_person_fix(text: Column) -> Column:
    return says("change_badge")(text) | matches(text, ARTIFACT_PATTERNS["hotfix"])


_gate(_first_person_fix, ["change_badge"])

_ANY_TRACE = ("research", "weak", "strong")

# Ids, patterns and versions of the checks, in reporting order.
CHECKS: tuple[CheckSpec, ...] = (
    CheckSpec("completion_without_artifact", "unverified_completion", says("claim"), None, ("strong",), 2, "seed"),
    CheckSpec("hedge_without_verification", "unverified_claims", says("hedge"), None, ("weak",), 1, "seed"),
    CheckSpec("posting_claim_without_trace", "acting_without_permission", says("post"), None, ("weak",), 1, "seed"),
    CheckSpec("sql_without_dry_run", "no_dry_run_sql", says("bq_exec"), says("dry_run"), (), 1, "seed"),
    CheckSpec(
        "confident_agreement_without_verification", "incomplete_analysis",
        says("agree", "technical_claim"), None, ("weak",),
    ),
    CheckSpec(
        "scope_dismissal_without_research", "incomplete_analysis",
        says("dismiss_scope"), None, ("research", "weak"), 2,
    ),
    CheckSpec(
        "premature_certainty_without_trace", "incomplete_analysis", says("premature_certainty"), None, _ANY_TRACE
    ),
    CheckSpec("conclusion_without_evidence", "incomplete_analysis", says("conclusion_claim"), None, _ANY_TRACE),
    CheckSpec("retry_without_diagnosis", "blind_retry", says("retry"), says("diagnosis")),
    CheckSpec("jira_mcp_used", "tool_misuse", says("jira_mcp")),
    CheckSpec("wrong_tool_admission", "tool_misuse", says("wrong_tool"), says("wrong_tool_recovery")),
    CheckSpec("duplicate_approval_claimed", "duplicate_approval", says("dup_approve"), version=2),
    CheckSpec("pr_approve_without_status", "pr_review_failure", says("pr_approve"), says("pr_status_trace"), ("weak",)),
    CheckSpec("review_post_without_fresh_diff", "stale_context", says("inline_review", "post"), says("diff_fresh")),
    CheckSpec("global_scope_without_confirm", "scope_misunderstanding", says("scope_global"), says("scope_confirm")),
    CheckSpec("stale_analysis_continued", "stale_context", says("stale_act"), says("diff_fresh"), ("weak",)),
    CheckSpec("external_post_without_ask", "posted_without_approval", says("post_without_ask"), says("ask_before_post")),
    CheckSpec(
        "fix_claim_without_regression_check", "regression_introduction",
        says("regression_claim"), says("regression_test"), ("weak",),
    ),
    CheckSpec("extra_rec_without_scope_label", "redundant_recommendation", says("redundant_rec"), says("scope_only")),
    CheckSpec(
        "confident_state_without_evidence", "unverified_claims", untagged("confident_state"), None, ("strong",)
    ),
    CheckSpec("metric_without_evidence", "unverified_claims", untagged("metric_claim"), None, ("strong",)),
    CheckSpec(
        "bare_metric_not_strong_artifact", "unverified_completion", says("claim", "metric_claim"), None, ("strong",)
    ),
    CheckSpec("verify_badge_without_evidence", "unverified_completion", says("verify_badge"), None, ("strong",)),
    CheckSpec("change_badge_without_proof", "unverified_completion", _first_person_fix, None, ("strong",)),
    CheckSpec(
        "correction_without_reverify", "unverified_claims",
        untagged("self_correction", "confident_state"), None, ("strong",),
    ),
    CheckSpec(
        "approve_without_verification_trace", "approved_without_verification",
        says("approve_claim"), says("approve_verify"),
    ),
    CheckSpec(
        "unhelpful_troubleshooting_no_diagnosis", "unhelpful_troubleshooting",
        says("unhelpful_trouble"), says("trouble_diagnosis"),
    ),
    CheckSpec(
        "explicit_instruction_ignored", "explicit_instruction_violation",
        says("instruction_forbid"), says("instruction_honor"),
    ),
    CheckSpec(
        "setup_claim_without_dep_resolve", "missing_dependency", says("setup_or_dep_claim"), says("dep_resolve_proof")
    ),
    CheckSpec(
        "airflow_retry_without_upstream_check", "airflow_blind_retry",
        says("airflow_retry_act"), says("airflow_upstream_diag"),
    ),
)


def covered_patterns(checks: Sequence[CheckSpec] = CHECKS) -> list[str]:
    return sorted({c.pattern for c in checks})


def _guarded(check: CheckSpec, gates: WordGates) -> Column:
    """The gate behind the bits of its words and a literal search for the parts it cannot match without."""
    gate = check.gate(F.col("_text"))
    for parts in getattr(check.gate, "parts", ()):
        gate = column_contains_any("_low", list(parts)) & gate
    for words in getattr(check.gate, "words", ()):
        gate = gates.test(tuple(words), "_bits") & gate
    return gate


def _staged(df: DataFrame, text: str, keep: Sequence[str], checks: Sequence[CheckSpec]) -> DataFrame:
    """``keep``, the text, one gate per check and the shared evidence.

    Separate projections keep the text, the words, the gates and the evidence from being expanded
    into every place that uses them.
    """
    body = F.col("_text")
    gates = WordGates([tuple(words) for c in checks for words in getattr(c.gate, "words", ())])
    step = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    step = step.withColumn("_low", folded(body))
    if gates.lists:
        step = step.withColumn("_found", gates.found(F.col("_low")))
        step = step.select("*", *[bits.alias(f"_bits{k}") for k, bits in enumerate(gates.bits(F.col("_found")))])
    step = step.select("*", *[_guarded(c, gates).alias(f"_g{i}") for i, c in enumerate(checks)])
    shared = []
    for name, build in SHARED.items():
        needed = F.lit(False)
        for i, c in enumerate(checks):
            if name in c.evidence:
                needed = needed | F.col(f"_g{i}")
        shared.append(F.when(needed, build(body)).otherwise(False).alias(f"_{name}"))
    return step.select("*", *shared)


def _outcome(check: CheckSpec) -> Column:
    passed = F.lit(False)
    for name in check.evidence:
        passed = passed | F.col(f"_{name}")
    if check.test is not None:
        passed = passed | check.test(F.col("_text"))
    return passed


def score(
    df: DataFrame, text: str, keep: Sequence[str], checks: Sequence[CheckSpec] = CHECKS, fired_only: bool = True
) -> DataFrame:
    """Long results: the ``keep`` columns plus ``eval_id, pattern, applied, passed``.

    ``passed`` is null where the check did not apply; such rows appear only with
    ``fired_only=False``.  Checks with a ``vector_test`` are scored in a pass of their own.
    """
    native = [c for c in checks if c.vector_test is None]
    parts = [_score_native(df, text, keep, native, fired_only)] if native else []
    parts += [_score_vector(df, text, keep, c, fired_only) for c in checks if c.vector_test is not None]
    return reduce(DataFrame.union, parts)


def _score_vector(df: DataFrame, text: str, keep: Sequence[str], check: CheckSpec, fired_only: bool) -> DataFrame:
    """Only texts on which the gate fired reach Python."""
    staged = _staged(df, text, keep, [check])
    named = [F.lit(check.eval_id).alias("eval_id"), F.lit(check.pattern).alias("pattern")]
    passed = F.pandas_udf(check.vector_test, "boolean")(F.col("_text"))
    for name in check.evidence:
        passed = passed | F.col(f"_{name}")
    fired = staged.where("_g0").select(*keep, *named, F.lit(True).alias("applied"), passed.alias("passed"))
    if fired_only:
        return fired
    quiet = staged.where("NOT _g0").select(*keep, *named, F.lit(False).alias("applied"), F.lit(None).cast("boolean").alias("passed"))
    return fired.union(quiet)


def _score_native(df: DataFrame, text: str, keep: Sequence[str], checks: Sequence[CheckSpec], fired_only: bool) -> DataFrame:
    rows = []
    for i, c in enumerate(checks):
        gate = F.col(f"_g{i}")
        row = F.struct(
            F.lit(c.eval_id).alias("eval_id"),
            F.lit(c.pattern).alias("pattern"),
            gate.alias("applied"),
            F.when(gate, _outcome(c)).alias("passed"),
        )
        rows.append(F.when(gate, row) if fired_only else row)
    # The outer form keeps the optimizer from adding a size() filter that would
    # evaluate every gate a second time below the projection.
    out = _staged(df, text, keep, checks).select(*keep, F.inline_outer(F.array_compact(F.array(*rows))))
    return out.where(F.col("eval_id").isNotNull())


def score_map(df: DataFrame, text: str, checks: Sequence[CheckSpec] = CHECKS, name: str = "scored") -> DataFrame:
    """Add a map from every check id to struct(applied, passed); checks with a ``vector_test`` need ``score``."""
    if any(c.vector_test is not None for c in checks):
        raise ValueError("score_map takes native checks only")
    entries = []
    for i, c in enumerate(checks):
        gate = F.col(f"_g{i}")
        entries += [F.lit(c.eval_id), F.struct(gate.alias("applied"), F.when(gate, _outcome(c)).alias("passed"))]
    return _staged(df, text, df.columns, checks).select(*df.columns, F.create_map(*entries).alias(name))


def score_or_captured(ratings: DataFrame, keep: Sequence[str], checks: Sequence[CheckSpec] = CHECKS) -> DataFrame:
    """Captured ``eval_results`` where a rating has them, else a fresh score of its preview.

    One pass: the text of a row with captured results is never scored.
    """
    captured = F.coalesce(F.size("eval_results"), F.lit(-1)) > 0
    marked = ratings.withColumn("_captured", captured)
    stored = marked.where("_captured").select(
        *keep, F.explode("eval_results").alias("eval_id", "_r")
    ).select(*keep, "eval_id", F.coalesce("_r.pattern", F.lit("")).alias("pattern"), F.lit(True).alias("applied"), "_r.passed")
    fresh = score(marked.where(~F.col("_captured")), "response_preview", keep, checks)
    return stored.unionByName(fresh)
