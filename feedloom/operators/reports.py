"""Counts and rankings over ratings, checks and logs.

All are partial aggregates; rankings keep the first k rows per partition before merging.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.fixed_values import ATTRIBUTION_FLOOR, GENERAL_SKILL, JUNK_PATTERNS, LOW_RATING
from feedloom.functions.regex import any_regex, matches, strip
from feedloom.functions.text import learning_category
from feedloom.scale import prefix_sums, top_k




def is_low() -> Column:
    return F.col("rating") <= LOW_RATING


def check_report(results: DataFrame) -> DataFrame:
    """Fired, passed and failed per check; a missing outcome counts as failed."""
    ok = F.coalesce(F.col("passed"), F.lit(False))
    return (
        results.groupBy("eval_id", "pattern")
        .agg(F.count(F.lit(1)).alias("fired"), F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"))
        .withColumn("fail_rate", F.round(F.col("failed") / F.col("fired"), 4))
    )


def check_cube(results: DataFrame) -> DataFrame:
    """Fired, failed and fail rate of every check by agent and skill, with subtotals (``level`` as grouping id).

    ``results``: eval_id, passed, agent, skill.
    """
    failed = F.count_if(~F.coalesce(F.col("passed"), F.lit(False)))
    sets = [["eval_id", "agent", "skill"], ["eval_id", "agent"], ["eval_id", "skill"], ["eval_id"]]
    return results.groupingSets(sets, "eval_id", "agent", "skill").agg(
        F.grouping_id().alias("level"),
        F.count(F.lit(1)).alias("fired"),
        failed.alias("failed"),
        F.round(failed / F.count(F.lit(1)), 4).alias("fail_rate"),
    )


def pattern_stats(ratings: DataFrame, min_occurrences: int = 2) -> DataFrame:
    """Per pattern over low ratings: count, average, share and the action it leads to.

    An empty label counts all low ratings, so one aggregate gives both the parts and the
    whole; the window then sees one row per pattern.
    """
    labels = F.concat(F.array(F.lit("")), F.col("patterns"))
    per = (
        ratings.where(is_low())
        .select("rating", F.explode(labels).alias("pattern"))
        .groupBy("pattern")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("rating"), 4).alias("avg_rating"))
    )
    whole = F.max(F.when(F.col("pattern") == "", F.col("n"))).over(Window.partitionBy(F.lit(1)))
    action = (
        F.when(F.col("pattern") == "other", "skip_unclassified")
        .when(F.col("n") < min_occurrences, F.concat(F.lit("skip_count_"), F.col("n").cast("string")))
        .otherwise("lesson_written")
    )
    shared = per.select(
        "pattern", "n", "avg_rating", F.round(F.col("n") / whole, 4).alias("share_of_low"), action.alias("action")
    )
    return shared.where(F.col("pattern") != "")


def rating_distribution(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("rating").agg(F.count(F.lit(1)).alias("n"))


def rating_overview(ratings: DataFrame) -> DataFrame:
    return ratings.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("rating"), 4).alias("avg_rating"),
        F.count_if(is_low()).alias("low_n"),
        F.round(F.count_if(is_low()) / F.count(F.lit(1)), 4).alias("low_share"),
    )


def skill_concentration(ratings: DataFrame, top: int = 10) -> DataFrame:
    """Skills with the most low ratings."""
    return (
        ratings.where(F.col("skill") != "")
        .groupBy("skill")
        .agg(
            F.count_if(is_low()).alias("low_n"),
            F.count(F.lit(1)).alias("total_n"),
            F.round(F.avg(F.when(is_low(), F.col("rating"))), 4).alias("avg_low"),
        )
        .where(F.col("low_n") > 0)
        .orderBy(F.desc("low_n"), "skill")
        .limit(top)
    )


def where_it_happens(ratings: DataFrame, k: int = 3) -> DataFrame:
    """Top repos, tools and skills of each pattern over low ratings."""
    facets = F.concat(
        F.array(
            F.named_struct(F.lit("facet"), F.lit("repo"), F.lit("value"), F.col("repo")),
            F.named_struct(F.lit("facet"), F.lit("skill"), F.lit("value"), F.col("skill")),
        ),
        F.transform("tools_used", lambda t: F.named_struct(F.lit("facet"), F.lit("tool"), F.lit("value"), t)),
    )
    counts = (
        ratings.where(is_low())
        .select(F.explode("patterns").alias("pattern"), facets.alias("_f"))
        .select("pattern", F.inline("_f"))
        .where(F.col("value") != "")
        .groupBy("pattern", "facet", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return top_k(counts, ["pattern", "facet"], [F.desc("n"), F.col("value")], k)


def is_junk() -> Column:
    """Rows that carry no usable signal; a human score never counts as junk."""
    shown = F.concat(
        F.coalesce(F.col("response_preview"), F.lit("")), F.lit(" "), F.coalesce(F.col("sentiment_summary"), F.lit(""))
    )
    junk = (
        F.col("rating").isNull()
        | ((F.length(strip(shown)) < 40) & (F.col("source") == "implicit"))
        | matches(shown, any_regex(JUNK_PATTERNS))
    )
    return F.coalesce((F.col("source") != "explicit") & junk, F.col("rating").isNull())


def hygiene_report(ratings: DataFrame) -> DataFrame:
    """One row: junk share and how well clean rows are attributed to skills."""
    flagged = ratings.withColumn("_junk", is_junk())
    clean = ~F.col("_junk")
    real = clean & F.col("skill").isNotNull() & ~F.col("skill").isin("", GENERAL_SKILL)
    counted = flagged.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("_junk")).alias("junk"),
        F.count_if(clean).alias("clean"),
        F.count_if(real).alias("with_real_skill"),
        F.count_if(clean & (F.size("skill_candidates") > 1)).alias("with_many_candidates"),
        F.count_if(clean & (F.coalesce("agent", F.lit("")) != "")).alias("with_agent"),
    )
    rate = F.when(F.col("clean") > 0, F.round(F.col("with_real_skill") / F.col("clean"), 3)).otherwise(0.0)
    return counted.withColumn("real_skill_rate", rate).withColumn(
        "attribution_healthy", (F.col("clean") > 0) & (F.col("real_skill_rate") >= ATTRIBUTION_FLOOR)
    )


def weakness_patterns(ratings: DataFrame, top: int = 15) -> DataFrame:
    """Most frequent patterns of low ratings and whether they are addressable."""
    return (
        ratings.where(is_low())
        .select(F.explode("patterns").alias("pattern"))
        .groupBy("pattern")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "pattern")
        .limit(top)
        .withColumn("addressable", (F.col("n") >= 2) & (F.col("pattern") != "other"))
    )


def weakness_skills(ratings: DataFrame, top: int = 10) -> DataFrame:
    return (
        ratings.where(is_low() & (F.col("skill") != ""))
        .groupBy("skill")
        .agg(F.count(F.lit(1)).alias("n_low"))
        .orderBy(F.desc("n_low"), "skill")
        .limit(top)
    )


def proposals(
    patterns: DataFrame, skills: DataFrame, scores: DataFrame, surfaces: DataFrame, limit: int = 25
) -> DataFrame:
    """What may be changed next: unproven lessons, then failing skills, on allowed surfaces only."""
    lessons = (
        patterns.where("addressable")
        .join(scores.select("pattern", "verdict"), "pattern", "left")
        .withColumn("verdict", F.coalesce("verdict", F.lit("pending")))
        .where(F.col("verdict").isin("regressed", "flat", "pending"))
        .select(
            "pattern",
            "verdict",
            F.lit("lesson_autogen").alias("surface"),
            F.lit("evolve_or_reinforce").alias("action"),
            F.lit(0).alias("_kind"),
            F.col("n").alias("_n"),
        )
    )
    skill_rows = skills.select(
        F.concat(F.lit("skill:"), "skill").alias("pattern"),
        F.lit("skill_fail_concentration").alias("verdict"),
        F.lit("skill_guardrails").alias("surface"),
        F.concat(
            F.lit("skill_autofix /"), F.col("skill"), F.lit(" (n_low="), F.col("n_low").cast("string"), F.lit(")")
        ).alias("action"),
        F.lit(1).alias("_kind"),
        F.col("n_low").alias("_n"),
    )
    return (
        lessons.unionByName(skill_rows)
        .join(surfaces.select("surface").distinct(), "surface", "left_semi")
        .orderBy("_kind", F.desc("_n"), "pattern")
        .limit(limit)
        .select("pattern", "verdict", "surface", "action")
    )


def collect_examples(ratings: DataFrame, k: int = 5) -> DataFrame:
    """The k lowest-rated summaries of each pattern, earliest first on a tie."""
    low = ratings.where(is_low()).select(
        F.explode("patterns").alias("pattern"), "rating", "timestamp", "session_id", "sentiment_summary"
    )
    return top_k(
        low, ["pattern"], [F.col("rating"), F.col("timestamp"), F.col("session_id"), F.col("sentiment_summary")], k
    )


def attribution_cube(ratings: DataFrame) -> DataFrame:
    """Rating count, average and low share by agent and skill, with subtotals."""
    return ratings.cube("agent", "skill").agg(
        F.grouping_id().alias("level"),
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("rating"), 4).alias("avg_rating"),
        F.round(F.count_if(is_low()) / F.count(F.lit(1)), 4).alias("low_share"),
    )


def learning_routes(ratings: DataFrame) -> DataFrame:
    """Low ratings become learnings with a category; 3 and below are also failures."""
    context = F.coalesce(F.col("response_preview"), F.lit(""))
    return ratings.where((F.col("rating") < 5) & (strip(context) != "")).select(
        "timestamp",
        "session_id",
        "rating",
        "source",
        learning_category(context, F.coalesce(F.col("sentiment_summary"), F.lit(""))).alias("category"),
        (F.col("rating") <= 3).alias("failure"),
        F.concat(
            F.when(F.col("source") == "explicit", "low-rating-").otherwise("sentiment-rating-"), F.col("rating").cast("string")
        ).alias("label"),
    )


def signal_trends(ratings: DataFrame, as_of: str, agent: str) -> DataFrame:
    """One row: day, week and month averages up to ``as_of`` and the trend they show."""
    age = F.unix_timestamp(F.to_timestamp(F.lit(as_of))) - F.unix_timestamp(F.to_timestamp("timestamp"))
    mean = lambda days: F.round(F.avg(F.when(F.col("_age") < days * 86400, F.col("rating"))), 1)
    row = (
        ratings.where(F.col("rating").isNotNull())
        .select("rating", age.alias("_age"), (F.col("agent") == agent).alias("_mine"))
        .where(F.col("_age") >= 0)
        .agg(
            mean(1).alias("day_avg"),
            mean(7).alias("week_avg"),
            mean(30).alias("month_avg"),
            F.count(F.lit(1)).alias("total"),
            F.count_if("_mine").alias("agent_total"),
        )
    )
    trend = (
        F.when(F.col("week_avg") > F.col("month_avg") + 0.2, "improving")
        .when(F.col("week_avg") < F.col("month_avg") - 0.2, "declining")
        .otherwise("stable")
    )
    return row.withColumn("trend", trend)


def last_n_counts(log: DataFrame, order: list[Column], n: int = 40, top: int = 5) -> DataFrame:
    """Most blocked patterns among the newest n log rows."""
    return (
        log.orderBy(*order)
        .limit(n)
        .where(F.col("blocked") | (F.col("mode") == "block"))
        .groupBy("pattern")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "pattern")
        .limit(top)
    )


def trajectory(ratings: DataFrame) -> DataFrame:
    """Per pattern: is it getting better, worse, coming back, or steady, by month?

    Works on one row per pattern and month.  ``cycling`` means a month without low
    ratings lies between two months with them; otherwise the last month is compared
    with the first.
    """
    month = F.substring("event_date", 1, 7)
    per = (
        ratings.where(is_low())
        .select(F.explode("patterns").alias("pattern"), month.alias("month"))
        .groupBy("pattern", "month")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    w = Window.partitionBy("pattern").orderBy("month")
    index = F.substring("month", 1, 4).cast("int") * 12 + F.substring("month", 6, 2).cast("int")
    gaps = per.withColumn("_i", index).withColumn("_gap", F.col("_i") - F.lag("_i").over(w) > 1)
    return gaps.groupBy("pattern").agg(
        F.count(F.lit(1)).alias("months"),
        F.min_by("n", "month").alias("first_n"),
        F.max_by("n", "month").alias("last_n"),
        F.coalesce(F.bool_or("_gap"), F.lit(False)).alias("_cycled"),
    ).select(
        "pattern",
        "months",
        "first_n",
        "last_n",
        F.when(F.col("_cycled"), "cycling")
        .when(F.col("last_n") < F.col("first_n"), "better")
        .when(F.col("last_n") > F.col("first_n"), "worse")
        .otherwise("stable")
        .alias("trajectory"),
    )


def passing_examples(ratings: DataFrame, k: int = 4) -> DataFrame:
    """What already works: the k best-rated summaries (7 and up) of each skill."""
    text = F.substring(
        strip(F.coalesce(F.when(F.col("sentiment_summary") != "", F.col("sentiment_summary")), F.col("response_preview"), F.lit(""))),
        1,
        160,
    )
    good = ratings.where((F.col("rating") >= 7) & (F.col("skill") != "")).select(
        "skill", "rating", "timestamp", "session_id", text.alias("summary")
    )
    ranked = top_k(
        good, ["skill"], [F.desc("rating"), F.col("timestamp"), F.col("session_id"), F.col("summary")], k
    )
    return ranked.where(F.col("summary") != "")


def recent_corrections(ratings: DataFrame, n: int = 3) -> DataFrame:
    """Newest low ratings with feedback, as short lines."""
    return (
        ratings.where(is_low() & (F.coalesce("sentiment_summary", F.lit("")) != ""))
        .orderBy(F.desc("timestamp"), F.desc("session_id"), "sentiment_summary")
        .limit(n)
        .select(
            "timestamp",
            "session_id",
            F.concat(F.lit("["), F.col("rating").cast("string"), F.lit("/10] "), F.substring("sentiment_summary", 1, 80)).alias("line"),
        )
    )


def recent_failures(names: DataFrame, n: int = 5) -> DataFrame:
    """Newest failure captures by directory name: ``[date] slug``."""
    slug = F.replace(F.regexp_replace("name", r"^\d{4}-\d{2}-\d{2}-\d{6}_", ""), F.lit("-"), F.lit(" "))
    return (
        names.orderBy(F.desc("month"), F.desc("name"))
        .limit(n)
        .select(
            "name",
            F.concat(F.lit("["), F.regexp_extract("name", r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("] "), F.substring(slug, 1, 70)).alias("line"),
        )
    )


def reclass_candidates(ratings: DataFrame, n: int = 40) -> DataFrame:
    """Newest low ratings that are still unclassified."""
    return (
        ratings.where(is_low() & (F.size("patterns") == 1) & (F.element_at("patterns", 1) == "other"))
        .orderBy(F.desc("timestamp"), F.desc("session_id"), F.desc("rating"))
        .limit(n)
    )


def running_cost(runs: DataFrame) -> DataFrame:
    """Cumulative tokens per run, by ``run_at, run_id``; an hour that holds most runs is spread."""
    return prefix_sums(
        runs,
        [],
        ["run_at", "run_id"],
        {"total_input_tokens": F.col("input_tokens"), "total_output_tokens": F.col("output_tokens")},
    )
