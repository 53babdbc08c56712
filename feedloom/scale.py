"""Building blocks that stay balanced when one key holds a large share of the rows.

``latest_by_key`` and ``top_k`` shrink every partition before the shuffle.
``running_total`` splits a key into position buckets, so no task sees a whole hot key;
``prefix_sums`` and ``prefix_lag`` split it by a range sort where no such bucket has a bound.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.session import written


def latest_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Row with the greatest order per key, as a partial aggregate (no per-key sort)."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)]))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per key.  Spark prunes each partition to k rows per key before the
    shuffle (window group limit), so a hot key costs k rows per partition."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[str],
    totals: dict[str, Column],
) -> DataFrame:
    """Running sums per key in ``order``, inclusive of the current row.

    ``bucket`` must not decrease along ``order``.  Rows are sorted within (key, bucket)
    only; a summary with one row per bucket carries the sums forward.
    """
    keyed = df.withColumn("_bucket", bucket)
    sums = keyed.groupBy(*keys, "_bucket").agg(*[F.sum(v).alias(f"_s_{n}") for n, v in totals.items()])
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_bucket").alias("_b"),
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in totals],
    )
    local = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inner = keyed.select("*", *[F.sum(v).over(local).alias(f"_l_{n}") for n, v in totals.items()])
    on = F.col("_bucket").eqNullSafe(F.col("_b"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = inner.join(carried, on)
    return joined.select(
        *df.columns, *[(F.col(f"_l_{n}") + F.col(f"_c_{n}")).alias(n) for n in totals]
    )


def keep_last(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """Newest n rows (``order`` is descending); a top-n per partition, then a merge."""
    return df.orderBy(*order).limit(n)


def previous_value(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str], value: str, name: str
) -> DataFrame:
    """Lag of ``value`` per key in ``order`` without sorting a whole key in one task.

    Inside a bucket it is a plain lag; the first row of a bucket takes the last value of
    the bucket before it from a summary with one row per bucket.
    """
    keyed = df.withColumn("_bucket", bucket)
    last = keyed.groupBy(*keys, "_bucket").agg(
        F.max_by(F.struct(value), F.struct(*order)).alias("_last")
    )
    across = Window.partitionBy(*keys).orderBy("_bucket")
    carried = last.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bucket").alias("_b"), F.lag("_last").over(across).alias("_carry")
    )
    local = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    inner = keyed.withColumn("_n", F.row_number().over(local)).withColumn("_lag", F.lag(value).over(local))
    on = F.col("_bucket").eqNullSafe(F.col("_b"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    found = F.when(F.col("_n") > 1, F.col("_lag")).otherwise(F.col("_carry")[value])
    return inner.join(carried, on).select(*df.columns, found.alias(name))


def _ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """The rows (``row``) with their ``key``, order ``o*``, values ``v*`` and range partition ``part``, as a
    written table.  Whole keys and order ties are cut between partitions too: the row's place in the
    input decides among equal rows."""
    order_names = [f"o{i}" for i in range(len(order))]
    flat = df.select(
        F.struct("*").alias("row"),
        F.struct(*(F.col(k) for k in keys), F.lit(0).alias("_")).alias("key"),
        *[F.col(c).alias(n) for c, n in zip(order, order_names)],
        *[v.alias(f"v{i}") for i, v in enumerate(values.values())],
        F.monotonically_increasing_id().alias("tie"),
    )
    sort = ["key", *order_names, "tie"]
    return written(flat.repartitionByRange(*sort).withColumn("part", F.spark_partition_id()), "ranges")


def prefix_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], totals: dict[str, Column]) -> DataFrame:
    """Running sums per key in ``order`` (ascending, nulls first), inclusive of the current row.

    Rows are range-sorted by key and order, summed within each range partition, and the sums
    of the earlier partitions of the key are carried on: a key that holds most rows, or most
    rows of one order value, is spread over as many partitions as it fills.  ``order`` should
    be total; rows it leaves equal get an arbitrary order among themselves.
    """
    placed = _ranged(df, keys, order, totals)
    names = list(totals)
    inside = Window.partitionBy("part", "key").orderBy(*[f"o{i}" for i in range(len(order))], "tie").rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select("row", "part", "key", *[F.sum(f"v{i}").over(inside).alias(f"l{i}") for i in range(len(names))])
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("part", "key").agg(*[F.sum(f"v{i}").alias(f"s{i}") for i in range(len(names))])
    carried = sums.select("part", "key", *[F.sum(f"s{i}").over(before).alias(f"c{i}") for i in range(len(names))])
    total = [(F.col(f"l{i}") + F.coalesce(f"c{i}", F.lit(0))).alias(n) for i, n in enumerate(names)]
    return local.join(carried, ["part", "key"]).select("row.*", *total)


def prefix_lag(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Value of the row before, per key in ``order``, by the same range partitions."""
    placed = _ranged(df, keys, order, {"value": F.struct(F.col(value).alias("x"))})
    sort = [*[f"o{i}" for i in range(len(order))], "tie"]
    inside = Window.partitionBy("part", "key").orderBy(*sort)
    local = placed.select("row", "part", "key", F.lag("v0").over(inside).alias("near"))
    last = placed.groupBy("part", "key").agg(F.max_by("v0", F.struct(*sort)).alias("last"))
    carried = last.select("part", "key", F.lag("last").over(Window.partitionBy("key").orderBy("part")).alias("far"))
    found = F.coalesce("near", "far")["x"]
    return local.join(carried, ["part", "key"]).select("row.*", found.alias(name))
