"""Mixing sources to target weights: hash-random keys, a range sort within each source, distributed
prefix sums of sizes, and a cut at each source's exact budget; native DataFrame operations only.

``targets`` shares ``share`` times all words out by weight.  A source stops at ``epochs`` times its
own words and what it leaves is shared again by weight.  The fixed point of that is one water level:
target = min(weight * level, cap), and the level is the greatest (budget - caps of the k sources with
the smallest cap per weight) / (weights of the others) over k, so it comes from two prefix sums.

``mix`` orders the documents of a source by a hash of their id and sums their sizes.  Of a budget of
whole words, ``floor(target)``, each document is taken once for every whole epoch; the rest goes to the
first documents of the order, and the document that crosses it gives only its first words.  The order is the
same in every run.  A source is range-partitioned, so one that holds most rows is spread.

A word is a run without ASCII white space; a null or empty text has size 0 and nothing is taken of
it.  Rows that share an id, and equal rows, are documents of their own.  A null source is a source of
its own, as is the empty one; a null id is hashed as such.  An empty table gives no rows.  Other
columns of the input, whatever their names, are not read (``mix``) or kept in ``row`` (``mixed_texts``).
Texts of any length are counted whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.common import table, written
from feedloom.scale import prefix_sums

WORD = r"[^\x20\x09-\x0D]+"
GAPS_AND_WORD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"
SPREAD = 64  # copies of a source's row that its documents are joined to
SEED = "mix"


def size_of(text: Column) -> Column:
    """Words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycled_weights(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Sources (``source``, each once) with ``weight`` repeating along their order by code point, null last."""
    ordered = prefix_sums(sources.withColumn("last", F.col("source").isNull()), [], ["last", "source"], {"place": F.lit(1).cast("long")})
    cycle = F.array(*[F.lit(w) for w in weights])
    return ordered.select("source", F.element_at(cycle, (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int")).alias("weight"))


def targets(sources: DataFrame, share: float = 1.5, epochs: int = 2) -> DataFrame:
    """``target`` (words) of each row of ``sources`` (source, weight > 0, source_size)."""
    capped = sources.withColumn("cap", (F.col("source_size") * epochs).cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    summed = prefix_sums(capped, [], ["ratio", "source"], {"caps": F.col("cap"), "weights": F.col("weight").cast("double")})
    all_of = capped.agg(F.sum("source_size").cast("double").alias("size"), F.sum("weight").cast("double").alias("weight")).first()
    before, others = F.col("caps") - F.col("cap"), F.lit(all_of.weight) - (F.col("weights") - F.col("weight"))
    level = summed.agg(F.max((F.lit((all_of.size or 0.0) * share) - before) / others).alias("level")).first().level
    return sources.withColumn("target", F.least(F.lit(level).cast("double") * F.col("weight"), F.col("source_size") * F.lit(float(epochs))))


def mix(docs: DataFrame, weights: DataFrame | tuple[int, ...], share: float = 1.5, epochs: int = 2) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of each row of ``docs`` (doc_id, text, source).

    ``weights`` is a table (source, weight), which must name every source, or a cycle of weights.
    """
    rows = written(docs.select("doc_id", "source", size_of(F.col("text")).alias("size")), "sizes")
    sizes = written(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    weights = weights if isinstance(weights, DataFrame) else cycled_weights(sizes.select("source"), weights)
    weights = weights.select(F.col("source").alias("of"), "weight")
    planned = targets(sizes.join(weights, F.col("source").eqNullSafe(F.col("of"))).drop("of"), share, epochs)
    budget = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0))
    planned = planned.withColumn("budget", budget).withColumn("whole", whole.cast("long"))
    copies = planned.select(
        F.col("source").alias("of"), "source_size", "target", "whole", (F.col("budget") - F.col("whole") * F.col("source_size")).alias("rest"),
        F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("copy"),
    )
    key = F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    ordered = prefix_sums(rows.withColumn("key", key), ["source"], ["key", "doc_id", "size"], {"upto": F.col("size")})
    joined = ordered.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(SPREAD)).cast("int")).join(
        copies, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("copy"))
    )
    first = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - (F.col("upto") - F.col("size"))))
    return joined.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + first).cast("long").alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(GAPS_AND_WORD), F.lit(0)), 1, n.cast("int")), "")


def mixed_texts(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The texts of the mix: doc_id, epoch (from 0), text, row (the input row), for documents with words taken.

    ``mixed`` comes from ``mix(docs, ...)``; ids must be unique here.  Whole epochs give whole texts, the last one
    the first words.
    """
    rows = docs.select(F.col("doc_id"), F.struct("*").alias("row"))
    chosen = mixed.where("taken > 0").select(F.col("doc_id").alias("of"), "size", "taken")
    copies = F.sequence(F.lit(0), F.expr("CAST((taken - 1) div size AS INT)"))
    spread = rows.join(chosen, F.col("doc_id").eqNullSafe(F.col("of"))).withColumn("epoch", F.explode(copies))
    left = F.col("taken") - F.col("epoch") * F.col("size")
    text = F.when(left >= F.col("size"), F.col("row.text")).otherwise(first_words(F.col("row.text"), left))
    return spread.select("doc_id", "epoch", text.alias("text"), "row")


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by weights 3, 1, 2 to 150 % of their words, at most two epochs."""
    return mix(table(spark, sf_dir, "documents"), (3, 1, 2)).select("doc_id", "size", "source_size", "target", "taken")


OP13_SQL = rf"""
WITH r AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight FROM r GROUP BY source
), c AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap FROM s
), p AS (
  SELECT *, coalesce(sum(cap) OVER before, 0) AS caps, coalesce(sum(weight) OVER before, 0) AS weights, sum(weight) OVER () AS all_weights, sum(source_size) OVER () AS all_sizes
  FROM c WINDOW before AS (ORDER BY cap / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT max((1.5::DOUBLE * all_sizes - caps) / (all_weights - weights)) AS level FROM p
), t AS (
  SELECT source, source_size, least(level * weight, cap) AS target, CAST(floor(least(level * weight, cap)) AS BIGINT) AS budget FROM c, l
), u AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS whole FROM t
), o AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS before FROM r
)
SELECT doc_id, size, source_size, target,
  CAST(whole * size + greatest(0, least(size, budget - whole * source_size - before)) AS BIGINT) AS taken
FROM o JOIN u ON o.source IS NOT DISTINCT FROM u.source
"""
