"""Exact top-k by inner product through a pivot-distance index.

Vectors are turned into integers, floor(scale * x), and get one more coordinate, sqrt(M^2 - |x|^2)
with M the greatest norm, so all lie on a sphere of radius M.  For a query of norm M on the same
sphere's plane, |q - x|^2 = 2 M^2 - 2 q.x, so the nearest vectors are those of the highest scores.

Index: every vector is keyed by its nearest pivot and its distance to that pivot.  Distances are cut
into ``RINGS`` annuli; a cell is an annulus of a pivot, stored with its true least and greatest
distance and split into chunks of about ``CHUNK`` vectors by a hash of the id, so a cell that holds
many copies is spread.  Pivots are at most ``PIVOTS`` vectors, the lowest by a hash of the id; they
decide speed alone, never results.

Search: a query first reads the annuli nearest to it until they hold ``FIRST`` vectors.  The k-th
best score so far is its threshold; by the triangle inequality |d(q, p) - d(x, p)| <= d(q, x) an
annulus whose bound on the score is below the threshold can't hold a better vector, and the search
stops there.  All other annuli are read.  Queries that visit a chunk of an annulus are dealt to blocks of about
``BLOCK`` by id; a group is one chunk and one block, so it does not grow with the table.  A visit row holds up to ``QUERIES``
queries of one chunk and block, as packed integers of the smallest width that fits; rows are given out in batches of about
``OUT_BYTES``.

Vectors that are null, hold null or non-finite components or have no id take no part.  Of rows that
share an id the smallest vector counts.  Shorter vectors, empty ones too, are extended by zeros.  Equal scores go to the
smaller id.  Scores are exact; one beyond 64 bits raises an error.  Without queries or vectors the
result is empty.  Only vec_id and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedloom.llm.common import table, written

PIVOTS, RINGS = 1024, 64
CHUNK, QUERIES, BLOCK, FIRST = 2048, 256, 4096, 512
OUT_BYTES = 1 << 23
SLACK = 1e-9
_EXACT = float(1 << 53)


def integers(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id and floor(scale * x) of the vectors that take part, one row per id."""
    x = F.col("embedding")
    usable = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (
        vectors.where(F.col("vec_id").isNotNull() & F.coalesce(usable, F.lit(False)))
        .select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("v"))
        .groupBy("vec_id")
        .agg(F.min("v").alias("v"))
    )


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as an int64 matrix, padded by zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(column.value_lengths())
    flat = np.asarray(column.flatten(), dtype=np.int64)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of q and x."""
    most = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(x.astype(float)).max(initial=0)) * q.shape[1]
    if most < _EXACT:
        return (q.astype(float) @ x.astype(float).T).astype(np.int64)
    if most < float(1 << 62):
        return q @ x.T
    exact = q.astype(object) @ x.astype(object).T
    if exact.size and max(abs(exact.max()), abs(exact.min())) >= 1 << 63:
        raise OverflowError("a score does not fit 64 bits")
    return exact.astype(np.int64)


class Sphere:
    """Pivots and distances after the extra coordinate."""

    def __init__(self, pivots: np.ndarray, radius: float):
        self.radius = radius
        self.pivots = pivots.astype(float)
        self.last = np.sqrt(np.maximum(radius**2 - (self.pivots**2).sum(axis=1), 0))

    def distances(self, x: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of rows of x on the sphere to each pivot."""
        inner = x @ self.pivots.T + last[:, None] * self.last[None, :]
        return np.sqrt(np.maximum(2 * self.radius**2 - 2 * inner, 0))

    def stored(self, v: np.ndarray) -> np.ndarray:
        x = v.astype(float)
        return self.distances(x, np.sqrt(np.maximum(self.radius**2 - (x**2).sum(axis=1), 0)))

    def asked(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances of queries stretched to the sphere, and the factors."""
        norm = np.sqrt((v.astype(float) ** 2).sum(axis=1))
        factor = np.where(norm > 0, self.radius / np.maximum(norm, 1e-300), 0.0)
        return self.distances(v * factor[:, None], np.zeros(len(v))), factor


def search(vectors: DataFrame, is_query, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other vectors for each vector that meets ``is_query``."""
    spark = vectors.sparkSession
    base = written(integers(vectors, scale), "vectors")
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    largest = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: F.greatest(a, F.abs(x)))
    total, norm2, width, largest = base.agg(F.count("*"), F.max(norm2), F.greatest(F.max(F.size("v")), F.lit(1)), F.max(largest)).first()
    result = "query_id long, rank int, vec_id long, score long"
    if not total:
        return spark.createDataFrame([], result)
    packed = next((t for t in ("<i2", "<i4") if largest <= np.iinfo(t).max), "<i8")
    n_pivots = int(min(PIVOTS, max(16, total**0.5 / 2)))
    chosen = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_pivots).select("v").collect()
    pivots = np.array([r.v + [0] * (width - len(r.v)) for r in chosen], dtype=np.int64)
    sphere = Sphere(pivots, max(norm2, 1.0) ** 0.5)
    ring = 2 * sphere.radius / RINGS

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = sphere.stored(matrix(batch.column(1), width))
                near = d.argmin(axis=1)
                dist = d[np.arange(len(d)), near]
                cell = near * (RINGS + 1) + np.minimum(dist / ring, RINGS).astype(np.int64)
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(cell.astype(np.int64)), pa.array(dist)], ["vec_id", "v", "cell", "dist"])

    index = written(base.mapInArrow(key, "vec_id long, v array<long>, cell long, dist double"), "index")
    found = written(index.groupBy("cell").agg(F.count("*").alias("n"), F.min("dist").alias("low"), F.max("dist").alias("high")), "cells")
    cells = found.orderBy("cell").collect()  # at most pivots x rings rows, whatever the table
    number = np.array([c.cell for c in cells])
    count = np.array([c.n for c in cells])
    low, high = (np.array([c[x] for c in cells]) for x in ("low", "high"))
    pivot = number // (RINGS + 1)
    chunks = np.maximum(1, -(-count // CHUNK))

    def bounds(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least distance of each query to each cell, and the greatest score a vector there can have."""
        d, factor = sphere.asked(v)
        d = d[:, pivot]
        least = np.maximum(np.maximum(d - high, low - d), 0)
        best = sphere.radius**2 - least**2 / 2
        best = best + SLACK * sphere.radius**2 + 1e-6 * sphere.radius
        with np.errstate(divide="ignore", invalid="ignore"):
            return least, np.where(factor[:, None] > 0, best / factor[:, None], np.inf) + 1

    def nearest(order: np.ndarray) -> np.ndarray:
        """How many cells of each row's order hold FIRST vectors."""
        return np.minimum((count[order].cumsum(axis=1) < FIRST).sum(axis=1) + 1, len(cells))

    def taken(batch: pa.RecordBatch, first: bool) -> np.ndarray:
        """Which cells each query visits."""
        v = matrix(batch.column(1), width)
        least, best = bounds(v)
        order = np.argsort(least, axis=1, kind="stable")
        seen = np.zeros(least.shape, dtype=bool)
        np.put_along_axis(seen, order, np.arange(len(cells))[None, :] < nearest(order)[:, None], axis=1)
        floor = np.full(len(v), -np.inf) if first else np.asarray(batch.column(2).fill_null(-(1 << 62)), dtype=float)
        return seen if first else ~seen & (best >= floor[:, None])

    def visited(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros(len(cells), dtype=np.int64)
            for whole in batches:
                for at in range(0, whole.num_rows, QUERIES):
                    n += taken(whole.slice(at, QUERIES), first).sum(axis=0)
            yield pa.record_batch([pa.array(number), pa.array(n)], ["cell", "n"])

        return run

    def visits(first: bool, blocks: np.ndarray):
        names = ["cell", "chunk", "block", "ids", "floors", "vectors"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows, size = [], 0
            for whole in batches:
                for at in range(0, whole.num_rows, QUERIES):
                    batch = whole.slice(at, QUERIES)
                    seen = taken(batch, first)
                    ids, floors, deal = (np.asarray(batch.column(k), dtype="<i8") for k in (0, 2, 3))
                    vectors = matrix(batch.column(1), width).astype(packed)
                    for c in np.flatnonzero(seen.any(axis=0)).tolist():
                        own = np.flatnonzero(seen[:, c])
                        of = deal[own] % blocks[c]
                        for block in np.unique(of).tolist():
                            part = own[of == block]
                            held = ids[part].tobytes(), floors[part].tobytes(), vectors[part].tobytes()
                            for chunk in range(int(chunks[c])):
                                rows.append((int(number[c]), chunk, block, *held))
                                size += sum(map(len, held))
                                if size >= OUT_BYTES:
                                    yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)
                                    rows, size = [], 0
            if rows:
                yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

        return run

    parts = found.select("cell", F.ceil(F.col("n") / CHUNK).alias("parts"))
    stored = index.join(parts, "cell").select("cell", F.pmod(F.xxhash64("vec_id"), "parts").cast("long").alias("chunk"), "vec_id", "v")

    def score(queries: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        names = ("query_id", "vec_id", "score")
        out = {n: [np.zeros(0, dtype=np.int64)] for n in names}
        if len(queries) and len(own):
            x = np.stack([np.pad(v, (0, width - len(v))) for v in own["v"]]).astype(np.int64)
            ids = own["vec_id"].to_numpy()
            for asking, least, vectors in zip(queries["ids"], queries["floors"], queries["vectors"]):
                asking, least = np.frombuffer(asking, "<i8"), np.frombuffer(least, "<i8")
                q = np.frombuffer(vectors, packed).reshape(-1, width).astype(np.int64)
                scores = products(q, x)
                for qid, floor, s in zip(asking.tolist(), least.tolist(), scores):
                    ok = (ids != qid) & (s >= floor)
                    rows, s = ids[ok], s[ok]
                    by = np.lexsort((rows, -s))[:k]
                    for n, values in zip(names, (np.full(len(by), qid), rows[by], s[by])):
                        out[n].append(values)
        return pd.DataFrame({n: np.concatenate(values) for n, values in out.items()})

    def scored(asked: DataFrame, first: bool) -> DataFrame:
        """Queries meet the chunks of the cells they visit, about BLOCK of them at a time; a chunk is copied for each block."""
        blocks, copies = np.ones(len(cells), dtype=np.int64), stored.withColumn("block", F.lit(0).cast("long"))
        asked = asked.withColumn("deal", F.pmod(F.xxhash64("query_id"), F.lit(1 << 40)))
        if asked_for > BLOCK:
            met = asked.mapInArrow(visited(first), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
            n = {r.cell: r.n for r in met}
            blocks = np.array([max(1, -(-n.get(c, 0) // BLOCK)) for c in number.tolist()], dtype=np.int64)
            many = spark.createDataFrame(list(zip(number.tolist(), blocks.tolist())), "cell long, blocks long")
            copies = stored.join(many, "cell").select("cell", "chunk", "vec_id", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
        pairs = asked.mapInArrow(visits(first, blocks), "cell long, chunk long, block long, ids binary, floors binary, vectors binary")
        right = copies.select("cell", "chunk", "block", "vec_id", "v").toDF("cell", "chunk", "block", "vec_id", "v")
        keys = ("cell", "chunk", "block")
        return pairs.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(score, "query_id long, vec_id long, score long")

    place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = lambda rows: rows.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    none = F.lit(-(1 << 62)).cast("long")
    queries = base.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    asked_for = queries.count()
    early = written(best(scored(queries.withColumn("floor", none), True)), "first")
    floors = early.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    asked = queries.join(floors, "query_id", "left").select("query_id", "q", F.coalesce("floor", none).alias("floor"))
    late = scored(asked, False)
    rows = best(early.drop("rank").select("query_id", "vec_id", "score").union(late))
    return rows.select("query_id", "rank", "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all embeddings for each one whose id is divisible by 100."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id % 100 = 0 AND x.vec_id <> q.vec_id
), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
