"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Directory for reliable checkpoints.

    A cluster names a shared folder in ``spark.checkpoint.dir``.  Only a local session
    without one gets a scratch folder of its own.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        named = tempfile.mkdtemp(prefix="feedloom-checkpoint-")
    context.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows as a written table: survives the loss of executors.

    Not ``checkpoint``: it keeps the size estimate of the plan it cuts.  In a loop whose table is joined to
    itself the estimate is squared each round, and its digits fill the driver's memory after some twenty rounds.  Parquet
    is also several times smaller than the uncompressed rows of a checkpoint.
    """
    return written(df, "cut")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write the rows once as Parquet in the shared folder and read them from there."""
    return passing(df, purpose)[0]


def passing(df: DataFrame, purpose: str) -> tuple[DataFrame, Callable[[], None]]:
    """A ``written`` table, and what deletes it once nothing reads it any more."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    df.write.parquet(path)

    def drop() -> None:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)

    return spark.read.schema(df.schema).parquet(path), drop


@contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """Inside, a table that is written leaves no shuffle files behind and is packed tighter; Python gets smaller batches.

    Otherwise shuffle files stay on the executors' disks until the driver happens to collect its garbage, and a job of several
    tables pays for all of them at once.
    """
    values = {
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
        "spark.sql.parquet.compression.codec": "zstd",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    }
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
