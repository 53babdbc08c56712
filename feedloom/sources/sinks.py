"""Writers.  Every run owns a partition, so a repeated run replaces its own rows only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.operators.ledger import negative_results
from feedloom.operators.reports import is_junk


def _replace_partition(df: DataFrame, path: str, column: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def append_effectiveness(scores: DataFrame, path: str, measured_at: str) -> None:
    """One row per lesson and run."""
    _replace_partition(scores.withColumn("measured_at", F.lit(measured_at)), path, "measured_at")


def append_run_log(stats: DataFrame, path: str, run_at: str) -> None:
    """Counts and actions per pattern of one run."""
    _replace_partition(stats.withColumn("run_at", F.lit(run_at)), path, "run_at")


def write_snapshot(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Full re-score.  With a partition column only the partitions present are replaced."""
    if partition:
        _replace_partition(df, path, partition)
    else:
        df.write.mode("overwrite").parquet(path)


def write_quarantine(ratings: DataFrame, clean_path: str, junk_path: str) -> None:
    """Clean rows and junk to separate tables; the input stays as it is."""
    flagged = ratings.withColumn("_junk", is_junk())
    flagged.where(~F.col("_junk")).drop("_junk").write.mode("overwrite").parquet(clean_path)
    flagged.where("_junk").drop("_junk").write.mode("overwrite").parquet(junk_path)


def append_negative_results(edits: DataFrame, archive: DataFrame, path: str, run_at: str) -> None:
    """Archive reverted edits that are not there yet."""
    fresh = negative_results(edits, archive)
    _replace_partition(fresh.withColumn("archived_at", F.lit(run_at)), path, "archived_at")


def write_report(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Ordered report rows as parquet or CSV."""
    writer = df.write.mode("overwrite")
    writer.parquet(path) if form == "parquet" else writer.option("header", "true").csv(path)


def append_taxonomy(keywords: DataFrame, path: str) -> None:
    """Add ``pattern, keyword, ord`` rows: a new pattern needs no change of code."""
    keywords.select("pattern", "keyword", "ord").write.mode("append").json(path)
