"""Health of the loop as an assertion table: check, level, value, fired."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.fixed_values import ATTRIBUTION_FLOOR, GENERAL_SKILL
from feedloom.functions.artifacts import strong_artifact
from feedloom.operators.measure import days_between


def _checks(row: DataFrame, rows: list[tuple[str, str, Column, Column]]) -> DataFrame:
    parts = [
        F.struct(
            F.lit(name).alias("check"), F.lit(level).alias("level"), value.cast("double").alias("value"), fired.alias("fired")
        )
        for name, level, value, fired in rows
    ]
    return row.select(F.inline(F.array(*parts)))


def health_checks(scores: DataFrame, ratings: DataFrame, episodes: DataFrame, as_of: str) -> DataFrame:
    """One aggregate per table; the outcomes are stacked, not joined."""
    verdicts = scores.agg(F.count_if(F.col("verdict") == "pending").alias("p"), F.count_if("injectable").alias("i"))
    rated = ratings.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("skill") != "").alias("k"),
        F.count_if(~F.col("skill").isin("", GENERAL_SKILL)).alias("g"),
        F.max("timestamp").alias("t"),
    )
    pending = episodes.agg(F.count_if(F.col("status") == "pending").alias("n"))
    age = days_between(F.substring("t", 1, 10), F.lit(as_of), on_failure=999)
    share = F.round(F.col("g") / F.col("n"), 3)
    some = F.col("n") > 0
    return reduce(
        DataFrame.unionByName,
        [
            _checks(verdicts, [("effectiveness_stuck", "warning", F.col("p"), (F.col("p") > 20) & (F.col("i") < 5))]),
            _checks(
                rated,
                [
                    ("no_skill_attribution", "warning", F.col("k"), some & (F.col("k") == 0)),
                    ("low_skill_attribution", "warning", share, some & (share < ATTRIBUTION_FLOOR)),
                    ("ratings_aging", "warning", age, some & age.between(3, 5)),
                    ("ratings_flatline", "error", age, some & (age > 5)),
                ],
            ),
            _checks(pending, [("episodes_pending", "warning", F.col("n"), F.col("n") > 10)]),
        ],
    )


def override_checks(overrides: DataFrame, expected: list[str]) -> DataFrame:
    """Patterns that should be in block mode and are not."""
    modes = overrides.select("pattern", "mode")
    wanted = overrides.sparkSession.createDataFrame([(p,) for p in expected], "pattern string")
    return (
        wanted.join(modes, "pattern", "left")
        .where(~F.col("mode").eqNullSafe(F.lit("block")))
        .select(F.concat("pattern", F.lit("_not_block")).alias("check"), F.lit("warning").alias("level"))
    )


def stalled_edit_checks(edits: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    """Active edits without any session since they were applied, past the limit."""
    age = days_between(F.substring("applied", 1, 10), F.lit(as_of), on_failure=-1)
    return edits.where(
        (F.col("status") == "active") & (age > days) & (F.coalesce("post_n", F.lit(0)) == 0)
    ).select("skill", "pattern", age.alias("age_days"))


def probe_is_weak(text: Column) -> Column:
    """Detector probe: a bare-metric completion must not count as strong evidence."""
    return ~strong_artifact(text)
