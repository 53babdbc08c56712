"""Did each lesson work?  Rates before and after, verdicts, escalation, side effects.

The fact table is read once and reduced to one row per (day, pattern) with a partial
aggregate.  Everything after that works on that small cube, so no rating row is ever
joined to a lesson and a pattern that owns most rows costs one row per day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.fixed_values import (
    ENFORCEABLE,
    ESCALATION_ORDER,
    LOW_RATING,
    MIN_AFTER,
    REAL_VERDICTS,
    REVIEW_EXPIRE_DAYS,
    SIDE_MIN_DELTA,
    SIDE_MIN_N,
    SIDE_NEW_FLOOR,
    SIDE_RATIO,
    STALE_PENDING_DAYS,
)
from feedloom.scale import latest_by_key
from feedloom.session import cut_lineage

TOTAL = ""  # pattern label of the all-sessions row in a daily cube


def days_between(start: Column, end: Column, on_failure: int = 999) -> Column:
    """Calendar days between ISO dates given as text."""
    return F.coalesce(F.datediff(F.try_to_date(end), F.try_to_date(start)), F.lit(on_failure))


def verdict(
    before: Column,
    after: Column,
    after_n: Column,
    min_after: int = MIN_AFTER,
    days_open: Column | None = None,
    stale_after: int = STALE_PENDING_DAYS,
) -> Column:
    """Outcome of a lesson from unrounded rates."""
    stale = (days_open >= stale_after) if days_open is not None else F.lit(False)
    return (
        F.when((after_n < min_after) & stale, "stale-pending")
        .when(after_n < min_after, "pending")
        .when(before == 0, "no-baseline")
        .when(after == 0, "resolved")
        .when(after <= before * 0.5, "working")
        .when(after < before, "improving")
        .when(after <= before * 1.2, "flat")
        .otherwise("regressed")
    )


def is_real(v: Column) -> Column:
    return v.isin(REAL_VERDICTS)


def daily_low_hits(ratings: DataFrame) -> DataFrame:
    """(event_date, pattern, hits): low-rated sessions per pattern, and all sessions
    under ``TOTAL``; one scan, one shuffle of pre-aggregated rows."""
    labels = F.concat(
        F.array(F.lit(TOTAL)),
        F.when(F.col("rating") <= LOW_RATING, F.array_distinct("patterns")).otherwise(F.array().cast("array<string>")),
    )
    return (
        ratings.select("event_date", F.explode(labels).alias("pattern"))
        .groupBy("event_date", "pattern")
        .agg(F.count(F.lit(1)).alias("hits"))
    )


def texts_by_key(ratings: DataFrame, text: str = "response_preview") -> DataFrame:
    """(timestamp, session_id, text): all that ``failed_checks`` of scored ratings needs, equal texts of a key once.

    Scoring the few columns behind a shuffle also spreads it over all cores, however few splits the ratings have.
    """
    session = F.when(F.col("timestamp") != "", "").otherwise(F.col("session_id"))
    return ratings.select("timestamp", session.alias("session_id"), text).distinct()


def failed_checks(results: DataFrame) -> DataFrame:
    """(key, pattern, failed): any failed check of a pattern at that key."""
    key = F.coalesce(
        F.when(F.col("timestamp") != "", F.col("timestamp")),
        F.when(F.col("session_id") != "", F.col("session_id")),
        F.lit(""),
    )
    return (
        results.select(key.alias("key"), "pattern", (F.col("passed") == F.lit(False)).alias("_f"))
        .groupBy("key", "pattern")
        .agg(F.coalesce(F.bool_or("_f"), F.lit(False)).alias("failed"))
    )


def daily_objective_hits(ratings: DataFrame, results: DataFrame) -> DataFrame:
    """(event_date, pattern, hits): sessions whose timestamp carries a failed check.

    Ratings are counted per timestamp first, so a timestamp shared by many rows is one
    row in the join.
    """
    stamps = ratings.groupBy("timestamp", "event_date").agg(F.count(F.lit(1)).alias("_n"))
    fails = failed_checks(results).where("failed").select(F.col("key").alias("timestamp"), "pattern")
    return (
        stamps.join(fails, "timestamp").groupBy("event_date", "pattern").agg(F.sum("_n").alias("hits"))
    )


def daily_judge_hits(judged: DataFrame) -> DataFrame:
    """(event_date, pattern, hits, n) over the judge's own rows."""
    return (
        failed_checks(judged)
        .where(F.col("pattern") != "")
        .select(F.substring("key", 1, 10).alias("event_date"), "pattern", F.col("failed").cast("int").alias("f"))
        .groupBy("event_date", "pattern")
        .agg(F.sum("f").alias("hits"), F.count(F.lit(1)).alias("n"))
    )


def totals_around(daily: DataFrame, dates: DataFrame) -> DataFrame:
    """(baseline_date, before_n, after_n) for each date.

    The window runs over one row per calendar day plus one per lesson date, a table
    bounded by the length of the history, not by the number of sessions.
    """
    days = daily.where(F.col("pattern") == TOTAL).select(
        F.col("event_date").alias("day"), F.col("hits").alias("n"), F.lit(False).alias("mark")
    )
    marks = dates.select("baseline_date").distinct().select(
        F.col("baseline_date").alias("day"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("mark")
    )
    order = Window.orderBy("day").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same_day = Window.partitionBy("day")
    line = days.unionByName(marks).select(
        "day",
        "mark",
        (F.sum("n").over(order) - F.sum("n").over(same_day)).alias("before_n"),
        F.sum("n").over(Window.partitionBy(F.lit(1))).alias("_all"),
    )
    return line.where("mark").select(
        F.col("day").alias("baseline_date"), "before_n", (F.col("_all") - F.col("before_n")).alias("after_n")
    )


def _split(daily: DataFrame, lessons: DataFrame, values: list[str], prefix: str) -> DataFrame:
    """Per lesson: sums of ``values`` before and after its date, by equi-join on pattern."""
    pairs = lessons.select("pattern", "baseline_date").join(daily, "pattern")
    before = F.col("event_date") < F.col("baseline_date")
    aggs = []
    for v in values:
        aggs.append(F.sum(F.when(before, F.col(v)).otherwise(0)).alias(f"{prefix}_before_{v}"))
        aggs.append(F.sum(F.when(before, 0).otherwise(F.col(v))).alias(f"{prefix}_after_{v}"))
    return pairs.groupBy("pattern").agg(*aggs)


def _rate(hits: Column, n: Column) -> Column:
    return F.when(F.coalesce(n, F.lit(0)) > 0, F.coalesce(hits, F.lit(0)) / n).otherwise(F.lit(0.0))


def effectiveness(
    ratings: DataFrame,
    lessons: DataFrame,
    results: DataFrame,
    judged: DataFrame,
    covered: list[str],
    as_of: str,
    min_after: int = MIN_AFTER,
) -> DataFrame:
    """One row per lesson: rates around its date and a verdict on each of three signals.

    ``ratings`` need ``timestamp, event_date, rating, patterns``; ``lessons`` are one row
    per pattern with ``baseline_date`` (empty means undated).
    """
    dated = lessons.where(F.coalesce(F.col("baseline_date"), F.lit("")) != "").select("pattern", "baseline_date")
    # Written once: the cube is tiny and two later steps read it.
    daily = cut_lineage(daily_low_hits(ratings))
    wide = (
        dated.join(totals_around(daily, dated), "baseline_date")
        .join(_split(daily.where(F.col("pattern") != TOTAL), dated, ["hits"], "s"), "pattern", "left")
        .join(_split(daily_objective_hits(ratings, results), dated, ["hits"], "o"), "pattern", "left")
        .join(_split(daily_judge_hits(judged), dated, ["hits", "n"], "j"), "pattern", "left")
        .join(
            judged.where(F.col("pattern") != "").select("pattern").distinct().withColumn("_judged", F.lit(True)),
            "pattern",
            "left",
        )
    )
    rates = wide.select(
        "pattern",
        "baseline_date",
        F.col("before_n"),
        F.col("after_n"),
        days_between(F.col("baseline_date"), F.lit(as_of)).alias("days_open"),
        _rate(F.col("s_before_hits"), F.col("before_n")).alias("_sb"),
        _rate(F.col("s_after_hits"), F.col("after_n")).alias("_sa"),
        F.col("pattern").isin(covered).alias("eval_covered"),
        _rate(F.col("o_before_hits"), F.col("before_n")).alias("_ob"),
        _rate(F.col("o_after_hits"), F.col("after_n")).alias("_oa"),
        F.coalesce("_judged", F.lit(False)).alias("judge_covered"),
        _rate(F.col("j_before_hits"), F.col("j_before_n")).alias("_jb"),
        _rate(F.col("j_after_hits"), F.col("j_after_n")).alias("_ja"),
        F.coalesce("j_after_n", F.lit(0)).alias("judge_after_n"),
    )
    opened = F.col("days_open")
    scored = (
        rates.withColumn("verdict", verdict(F.col("_sb"), F.col("_sa"), F.col("after_n"), min_after, opened))
        .withColumn(
            "obj_verdict",
            F.when(
                F.col("eval_covered"), verdict(F.col("_ob"), F.col("_oa"), F.col("after_n"), min_after, opened)
            ).otherwise("no-eval"),
        )
        .withColumn(
            "judge_verdict",
            F.when(
                F.col("judge_covered"),
                verdict(F.col("_jb"), F.col("_ja"), F.col("judge_after_n"), min_after, opened),
            ).otherwise("no-judge"),
        )
    )
    zero_if = lambda flag, c: F.when(F.col(flag), F.col(c)).otherwise(0.0)
    result = scored.select(
        "pattern",
        "baseline_date",
        "days_open",
        F.round("_sb", 4).alias("before_rate"),
        F.round("_sa", 4).alias("after_rate"),
        F.round(F.col("_sa") - F.col("_sb"), 4).alias("delta"),
        "before_n",
        "after_n",
        "verdict",
        (
            is_real(F.col("verdict")) | is_real(F.col("obj_verdict")) | is_real(F.col("judge_verdict"))
        ).alias("injectable"),
        "eval_covered",
        F.round(zero_if("eval_covered", "_ob"), 4).alias("obj_before"),
        F.round(zero_if("eval_covered", "_oa"), 4).alias("obj_after"),
        F.when(F.col("eval_covered"), F.round(F.col("_oa") - F.col("_ob"), 4)).otherwise(0.0).alias("obj_delta"),
        "obj_verdict",
        "judge_covered",
        F.round(zero_if("judge_covered", "_jb"), 4).alias("judge_before"),
        F.round(zero_if("judge_covered", "_ja"), 4).alias("judge_after"),
        F.when(F.col("judge_covered"), F.round(F.col("_ja") - F.col("_jb"), 4)).otherwise(0.0).alias("judge_delta"),
        "judge_verdict",
        "judge_after_n",
    )
    undated = lessons.where(F.coalesce(F.col("baseline_date"), F.lit("")) == "").select(
        "pattern",
        F.lit("").alias("baseline_date"),
        F.lit(0).alias("days_open"),
        *[F.lit(0.0).alias(c) for c in ("before_rate", "after_rate", "delta")],
        *[F.lit(0).cast("long").alias(c) for c in ("before_n", "after_n")],
        F.lit("undated").alias("verdict"),
        F.lit(False).alias("injectable"),
        F.lit(False).alias("eval_covered"),
        *[F.lit(0.0).alias(c) for c in ("obj_before", "obj_after", "obj_delta")],
        F.lit("no-eval").alias("obj_verdict"),
        F.lit(False).alias("judge_covered"),
        *[F.lit(0.0).alias(c) for c in ("judge_before", "judge_after", "judge_delta")],
        F.lit("no-judge").alias("judge_verdict"),
        F.lit(0).cast("long").alias("judge_after_n"),
    )
    return result.unionByName(undated)


def escalation_verdict(min_after: int = MIN_AFTER) -> Column:
    """Checks outrank the judge, the judge outranks ratings; bad ratings still win for an
    enforceable pattern whose checks look fine."""
    subjective_wins = (
        F.col("verdict").isin("flat", "regressed")
        & (F.col("after_n") >= min_after)
        & F.col("pattern").isin(ENFORCEABLE)
        & ~F.col("obj_verdict").isin("regressed", "flat")
    )
    return (
        F.when(F.col("eval_covered") & subjective_wins, F.col("verdict"))
        .when(F.col("eval_covered"), F.col("obj_verdict"))
        .when(F.col("judge_covered"), F.col("judge_verdict"))
        .otherwise(F.col("verdict"))
    )


def escalation(scores: DataFrame, min_after: int = MIN_AFTER) -> DataFrame:
    """Lessons whose deciding signal is flat or regressed."""
    return scores.withColumn("escalation_verdict", escalation_verdict(min_after)).where(
        F.col("escalation_verdict").isin("flat", "regressed")
    )


def escalation_rank(scores: DataFrame) -> DataFrame:
    """All lessons, most severe first, worst change first."""
    order = F.coalesce(
        F.element_at(
            F.create_map(*[F.lit(x) for kv in ESCALATION_ORDER.items() for x in kv]), F.col("escalation_verdict")
        ),
        F.lit(10),
    )
    ranked = scores.withColumn("escalation_verdict", escalation_verdict()).withColumn("severity", order)
    return ranked.orderBy("severity", "delta", "pattern")


def expire_reviews(queue: DataFrame, as_of: str, expire_days: int = REVIEW_EXPIRE_DAYS) -> DataFrame:
    """Pending reviews past the limit become auto-escalated."""
    expired = (F.col("status") == "pending") & (
        days_between(F.col("detected_at"), F.lit(as_of)) > expire_days
    )
    return (
        queue.withColumn("_expired", expired)
        .withColumn("status", F.when(F.col("_expired"), "auto-escalated").otherwise(F.col("status")))
        .withColumn("reviewed_at", F.when(F.col("_expired"), F.lit(as_of)).otherwise(F.col("reviewed_at")))
        .withColumn("reviewer", F.when(F.col("_expired"), F.lit("auto-expire")).otherwise(F.col("reviewer")))
        .drop("_expired")
    )


def gate_escalation(
    scores: DataFrame, queue: DataFrame, prior: DataFrame, as_of: str, min_after: int = MIN_AFTER
) -> DataFrame:
    """Each escalated lesson with ``gate``: escalate, first_time_regressed or under_review."""
    pending = (
        expire_reviews(queue, as_of).where(F.col("status") == "pending").select("pattern").distinct()
    ).withColumn("_pending", F.lit(True))
    before = prior.select("pattern", F.col("verdict").alias("_prior"))
    joined = escalation(scores, min_after).join(pending, "pattern", "left").join(before, "pattern", "left")
    waiting = F.coalesce(F.col("_pending"), F.lit(False))
    gated = ~F.col("pattern").isin(ENFORCEABLE)
    gate = (
        F.when(
            gated
            & (F.col("escalation_verdict") == "regressed")
            & ~waiting
            & ~F.coalesce(F.col("_prior") == "regressed", F.lit(False)),
            "first_time_regressed",
        )
        .when(gated & waiting, "under_review")
        .otherwise("escalate")
    )
    return joined.withColumn("gate", gate).drop("_pending", "_prior")


def coverage_gaps(ratings: DataFrame, covered: list[str]) -> DataFrame:
    """Patterns of low-rated sessions that no check covers, with counts."""
    return (
        ratings.where(F.col("rating") <= LOW_RATING)
        .select(F.explode("patterns").alias("pattern"))
        .where((F.col("pattern") != "other") & ~F.col("pattern").isin(covered))
        .groupBy("pattern")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def side_effects(ratings: DataFrame, lessons: DataFrame, min_side_n: int = SIDE_MIN_N) -> DataFrame:
    """Patterns that got worse after a lesson for a different pattern landed.

    Hits are reduced to the intervals between lesson dates, summed per pattern before and
    from each lesson date, and met with the lessons by date.
    """
    dated = lessons.where(F.coalesce(F.col("baseline_date"), F.lit("")) != "").select("pattern", "baseline_date")
    daily = cut_lineage(daily_low_hits(ratings))
    totals = totals_around(daily, dated).where((F.col("before_n") >= min_side_n) & (F.col("after_n") >= min_side_n))
    lesson = dated.join(totals, "baseline_date").withColumnRenamed("pattern", "offending_lesson")

    hits = daily.where(~F.col("pattern").isin(TOTAL, "other"))
    marks = dated.select(F.col("baseline_date").alias("day")).distinct()
    axis = hits.select(F.col("event_date").alias("day")).distinct().withColumn("_d", F.lit(None).cast("string"))
    axis = axis.unionByName(marks.withColumn("_d", F.col("day")))
    order = Window.orderBy("day").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    interval = axis.select("day", F.coalesce(F.max("_d").over(order), F.lit("")).alias("since")).distinct()
    by_interval = (
        hits.join(interval, hits.event_date == interval.day)
        .groupBy("since", "pattern")
        .agg(F.sum("hits").alias("hits"))
    )
    dates = dated.agg(F.array_sort(F.collect_set("baseline_date")).alias("_dates"))  # one row
    per_pattern = by_interval.groupBy("pattern").agg(F.collect_list(F.struct("since", "hits")).alias("_h"))
    at_date = per_pattern.crossJoin(F.broadcast(dates)).select("pattern", "_h", F.explode("_dates").alias("baseline_date"))
    hits_in = lambda keep: F.aggregate(F.filter("_h", keep), F.lit(0).cast("long"), lambda n, x: n + x["hits"])
    at_date = at_date.select(
        F.col("pattern").alias("side_effect_pattern"),
        "baseline_date",
        hits_in(lambda x: x["since"] < F.col("baseline_date")).alias("_b"),
        hits_in(lambda x: x["since"] >= F.col("baseline_date")).alias("_a"),
    )
    counts = (
        lesson.select("offending_lesson", "baseline_date", "before_n", "after_n")
        .distinct()
        .join(at_date, "baseline_date")
        .where(F.col("offending_lesson") != F.col("side_effect_pattern"))
        .withColumn("_before", F.col("_b") / F.col("before_n"))
        .withColumn("_after", F.col("_a") / F.col("after_n"))
    )
    b, a = F.col("_before"), F.col("_after")
    worse = ((b > 0) & (a >= b * SIDE_RATIO) & (a - b >= SIDE_MIN_DELTA)) | ((b == 0) & (a >= SIDE_NEW_FLOOR))
    return counts.where(worse).select(
        "offending_lesson",
        "side_effect_pattern",
        F.col("baseline_date").alias("lesson_date"),
        F.round(b, 4).alias("before_rate"),
        F.round(a, 4).alias("after_rate"),
        F.round(a - b, 4).alias("delta"),
        "before_n",
        "after_n",
    )


def worst_side_effect(flagged: DataFrame) -> DataFrame:
    """One row per offending lesson: the largest increase, first name on a tie."""
    return (
        flagged.groupBy("offending_lesson")
        .agg(
            F.min_by(
                F.struct("side_effect_pattern", "lesson_date", "before_rate", "after_rate", "delta", "before_n", "after_n"),
                F.struct((-F.col("delta")).alias("d"), F.col("side_effect_pattern").alias("p")),
            ).alias("_w")
        )
        .select("offending_lesson", "_w.*")
    )


def historical_epoch(log: DataFrame) -> DataFrame:
    """Earliest valid lesson date per pattern in the effectiveness log."""
    day = F.substring(
        F.coalesce(F.when(F.col("lesson_date") != "", F.col("lesson_date")), F.col("baseline_date"), F.lit("")), 1, 10
    )
    return (
        log.select("pattern", day.alias("_d"))
        .where((F.col("pattern") != "") & F.col("_d").rlike(r"^\d{4}-\d{2}-\d{2}"))
        .groupBy("pattern")
        .agg(F.min("_d").alias("first_date"))
    )


def frozen_epoch(baseline: Column, first_seen: Column, last_updated: Column) -> Column:
    """Measurement date of a lesson; rewriting its text never moves it."""
    filled = lambda c: F.when(c != "", c)
    return F.coalesce(filled(baseline), filled(first_seen), filled(last_updated), F.lit(""))


def verdict_series(log: DataFrame) -> DataFrame:
    """Runs at which a pattern's verdict changed, with the previous verdict.

    One row per pattern and run, so the window is as long as the run history.
    """
    once = latest_by_key(log.select("pattern", "measured_at", "verdict"), ["pattern", "measured_at"], [F.col("verdict")])
    w = Window.partitionBy("pattern").orderBy("measured_at")
    return (
        once.withColumn("previous", F.lag("verdict").over(w))
        .where(F.col("previous").isNull() | (F.col("previous") != F.col("verdict")))
        .select("pattern", "measured_at", "previous", "verdict")
    )
