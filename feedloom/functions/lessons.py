"""Lesson-text predicates and the rule reflector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.fixed_values import (
    REAL_VERDICTS,
    RULE_ARTIFACT,
    RULE_GENERIC_AVOID,
    RULE_HOLLOW,
    RULE_IMPERATIVE,
    RULE_SEQUENCE,
    RULE_STUB,
    SLUDGE,
    TEMPLATE_RULE,
)
from feedloom.functions.regex import any_regex, matches, strip


def _clean(rule: Column) -> Column:
    return strip(F.coalesce(rule, F.lit("")))


def weak_rule(rule: Column) -> Column:
    """A stub or hollow advice."""
    r = _clean(rule)
    low = F.lower(r)
    return (
        (F.length(r) < 40)
        | matches(r, RULE_STUB)
        | (matches(r, RULE_GENERIC_AVOID) & (F.length(r) < 70))
        | (low.startswith("avoid ") & low.contains("verify before acting"))
        | (matches(r, RULE_HOLLOW) & (F.length(r) < 90))
    )


def rule_quality(rule: Column) -> Column:
    """0 for a stub up to 4 for an actionable rule."""
    r = _clean(rule)
    sequenced = (
        F.lower(r).contains(" instead") | (r.contains(";") & (F.length(r) > 80)) | matches(r, RULE_SEQUENCE)
    )
    points = (
        F.lit(1)
        + matches(r, RULE_IMPERATIVE).cast("int")
        + matches(r, RULE_ARTIFACT).cast("int")
        + sequenced.cast("int")
    )
    return F.when(weak_rule(rule), F.lit(0)).otherwise(points)


def is_template_rule(rule: Column) -> Column:
    return matches(_clean(rule), TEMPLATE_RULE)


def is_sludge(description: Column) -> Column:
    d = _clean(description)
    return (F.length(d) < 24) | matches(d, any_regex(SLUDGE))


def guess_section(pattern: Column, rule: Column) -> Column:
    """Section from the wording when the rule bank has no entry."""
    low = F.lower(F.coalesce(rule, F.lit("")))
    formula = low.rlike(r"formula|order:|master →|bq query|dry-run")
    pitfall = low.rlike(r"never |do not |don't |pitfall|stop\.") | pattern.rlike(
        r"(_error|_failure|_violation|_regression)\z"
    )
    return F.when(formula, "formula").when(pitfall, "pitfall").otherwise("strategy")


def injection_section(
    verdict: Column, section: Column, quality: Column, description: Column, min_quality: int = 2
) -> Column:
    """Where a bullet may be injected; anything unproven or low-grade is deferred."""
    deferred = is_sludge(description) | (quality < min_quality) | ~verdict.isin(REAL_VERDICTS)
    return (
        F.when(deferred, "deferred")
        .when(verdict.isin("resolved", "working", "improving"), "resolved")
        .when(section.isin("strategy", "pitfall", "formula"), section)
        .otherwise("strategy")
    )


def lesson_format_ok(content: Column) -> Column:
    """Two front-matter markers, the required keys, and balanced fences in the body."""
    markers = F.size(F.split(content, "---")) - 1
    parts = F.split(content, "---", 3)
    front = F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    body = F.coalesce(F.get(parts, F.lit(2)), F.lit(""))
    fences = F.size(F.split(body, "```")) - 1
    return (
        (markers >= 2)
        & front.contains("name:")
        & front.contains("description:")
        & front.contains("metadata:")
        & (fences % 2 == 0)
    )


def evidence_rule(evidence: Column, hints: list[tuple[str, str]]) -> Column:
    """Rule suggested by the evidence lines.

    ``hints`` is an ordered list of (expression over the joined lower-case evidence,
    rule).  Without a hint, a first line that already reads like an instruction is
    promoted; evidence that only reports a mood yields nothing.
    """
    joined = F.lower(F.array_join(evidence, " "))
    chosen = F.lit(None).cast("string")
    for pattern, rule in reversed(hints):
        chosen = F.when(joined.rlike(pattern), F.lit(rule)).otherwise(chosen)
    top = F.get(evidence, F.lit(0))
    mood_only = F.forall(
        evidence,
        lambda e: matches(e, r"\b(angry|frustrated|confused|mild|impatient|skeptic)\b") & (F.length(e) < 80),
    )
    promoted = F.when(
        ~mood_only & matches(top, r"\b(never|don't|do not|must|always|before)\b") & (F.length(top) > 40),
        F.substring(top, 1, 280),
    )
    return F.when(F.size(evidence) > 0, F.coalesce(chosen, promoted))


def reflect(
    lessons: DataFrame,
    bank: DataFrame,
    evidence_hints: list[tuple[str, str]] = (),
    heuristics: list[tuple[str, str]] = (),
) -> DataFrame:
    """Upgrade each lesson's rule to the best available wording.

    ``lessons``: pattern, rule, evidence array<string>, root_cause, where_.
    ``bank``: pattern, section, description, one row per pattern.
    ``heuristics``: ordered (expression over the pattern name, rule template with
    ``{phrase}``); the last entry should match everything.
    Order of choice: a good rule as it is, the bank, the evidence, the root cause, the
    heuristics for weak rules, else the rule unchanged.
    """
    joined = lessons.join(
        bank.select("pattern", F.col("description").alias("_bank"), F.col("section").alias("_bank_section")),
        "pattern",
        "left",
    )
    pattern, rule = F.col("pattern"), F.col("rule")
    weak, grade = weak_rule(rule), rule_quality(rule)
    from_evidence = evidence_rule(F.col("evidence"), list(evidence_hints))
    cause = strip(F.coalesce(F.col("root_cause"), F.lit("")))
    as_order = F.when(
        cause.rlike(r"^(Never|Always|Do |Don't|Before|After|When|Check|Read|Run)"), cause
    ).otherwise(
        F.concat(
            F.lit("Given root cause ("),
            F.substring(cause, 1, 120),
            F.lit("): verify with tools before asserting or completing."),
        )
    )
    phrase = F.trim(F.replace(pattern, F.lit("_"), F.lit(" ")))
    last_resort = F.lit(None).cast("string")
    for name_pattern, template in reversed(list(heuristics)):
        text = F.replace(F.lit(template), F.lit("{phrase}"), phrase)
        last_resort = F.when(pattern.rlike(name_pattern), text).otherwise(last_resort)
    spot = F.coalesce(F.col("where_"), F.lit(""))
    last_resort = F.when(
        spot != "", F.concat(last_resort, F.lit(" Hotspots: "), F.substring(spot, 1, 80), F.lit("."))
    ).otherwise(last_resort)

    step = joined.select(
        "*",
        weak.alias("weak_input"),
        grade.alias("_grade"),
        from_evidence.alias("_evidence"),
        as_order.alias("_cause"),
        last_resort.alias("_last"),
    )
    cause_ok = (
        (F.length(strip(F.coalesce(F.col("root_cause"), F.lit("")))) > 30)
        & ~weak_rule(F.col("root_cause"))
        & (rule_quality(F.col("_cause")) >= 2)
    )
    source = (
        F.when(~F.col("weak_input") & (F.col("_grade") >= 3), "passthrough")
        .when(F.col("_bank").isNotNull(), "bank")
        .when(F.col("_evidence").isNotNull() & ~weak_rule(F.col("_evidence")), "evidence")
        .when(cause_ok, "root_cause")
        .when(F.col("weak_input") | (F.col("_grade") < 2), "heuristic")
        .otherwise("passthrough")
    )
    step = step.withColumn("_source", source)
    text = (
        F.when(F.col("_source") == "bank", F.col("_bank"))
        .when(F.col("_source") == "evidence", F.substring("_evidence", 1, 400))
        .when(F.col("_source") == "root_cause", F.substring("_cause", 1, 400))
        .when(F.col("_source") == "heuristic", F.substring("_last", 1, 400))
        .otherwise(F.substring(strip(F.col("rule")), 1, 400))
    )
    step = step.withColumn("description", text)
    return step.select(
        "pattern",
        "description",
        F.coalesce("_bank_section", guess_section(pattern, F.col("description"))).alias("section"),
        rule_quality(F.col("description")).alias("quality"),
        F.when(F.col("_source") == "root_cause", "evidence").otherwise(F.col("_source")).alias("source"),
        "weak_input",
    )
