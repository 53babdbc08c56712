"""Near-duplicate documents: MinHash with banding, signature verification, exact verification on
whole shingle sets, and connected components by alternating large-star and small-star.

A document's set holds its distinct shingles of ``words`` words (ASCII letters in lower case, words
between ASCII white space); a shorter text is one shingle; a text without words has the empty set
and no links.  Two documents are linked where ``100 * |A & B| >= threshold * |A | B|``.

1. One pass hashes the shingles to 64 bits and takes ``HASHES`` universal hash minima.  Documents
   with equal sets collapse to one node, the smallest id.
2. ``BANDS`` bands of ``ROWS`` minima give buckets.  A pair at the threshold of 0.8 shares no bucket
   with probability (1 - 0.8^7)^56 = 2e-6, a pair at 0.1 shares one with probability 6e-6.
3. Only components are asked for, so members are compared with hubs first: each with the smallest id
   it shares a bucket with, then with a pseudo-random member of another component.  Pairs alone in a bucket are
   compared at once.  Buckets whose members then lie in one component are done.  The others are gathered
   by the component that most of their members belong to, and all members outside it are compared with
   all gathered members in blocks of about ``BLOCK``; no pair is left out, no group meets in one task, and
   at most one link for a node and another component is given out.
4. A pair stays if the first ``BRIEF`` minima and then all of them agree as often as five standard
   deviations below 0.8 ask for, and the full sets meet the threshold.

Null and empty texts give rows of their own with an empty set.  Repeated rows give repeated results.
A row without id is linked but never the kept one.  Rows that share an id are one node.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.common import longs, table, texts_of, written
from feedloom.llm.components import components
from feedloom.llm.tokens import Remembered

ROWS, BANDS = 7, 56
HASHES = ROWS * BANDS
BRIEF = 64
BLOCK = 256
_SEED = np.random.Generator(np.random.PCG64(20260101))
_A = _SEED.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _SEED.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_PLACE = _SEED.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)

_words = Remembered(xxhash.xxh3_64_intdigest, limit=50_000)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x = x ^ (x >> np.uint64(33))
    x = x * _M2
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    hashes = np.array(_words.all(text.encode("utf-8", "surrogatepass").lower().split()), dtype=np.uint64)
    if not len(hashes):
        return hashes
    n = min(words, len(hashes))
    count = len(hashes) - n + 1
    total = np.full(count, n, dtype=np.uint64)
    for k in range(n):
        total += hashes[k : k + count] * _PLACE[k % 64]
    return np.unique(mixed(total))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima of each non-empty set under every hash, a row per set."""
    x = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((HASHES, len(sets)), dtype=np.uint32)
    v = np.empty_like(x)
    for k in range(HASHES):
        np.multiply(x, _A[k], out=v)
        np.add(v, _B[k], out=v)
        out[k] = np.minimum.reduceat(v, starts) >> np.uint64(32)
    return np.ascontiguousarray(out.T)


def bucket_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    parts = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)[None, :]
    for k in range(ROWS):
        key = mixed(key * _PLACE[k] + parts[:, :, k] + np.uint64(1))
    return key.view(np.int64)


def floor(hashes: int, threshold: int) -> float:
    """Share of agreeing minima below which a pair at the threshold lies with probability under 3e-7."""
    t = threshold / 100
    return t - 5 * (t * (1 - t) / hashes) ** 0.5


def _prints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sets = [shingle_set(t, words) for t in texts_of(batch.column(1))]
                filled = [k for k, s in enumerate(sets) if len(s)]
                own: list = [None] * len(sets)
                bands: list = [None] * len(sets)
                if filled:
                    keys = bucket_keys(signatures([sets[k] for k in filled]))
                    for row, k in enumerate(filled):
                        own[k], bands[k] = xxhash.xxh3_128_digest(sets[k].tobytes()), keys[row]
                yield pa.record_batch(
                    [batch.column(0), longs([len(s) for s in sets]), pa.array(own, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "set_key", "bands"],
                )
        _words.clear()  # workers outlive the stage

    return run


def _facts(words: int):
    """Signature (16 bits of each minimum), its first part and the whole set of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sets = [shingle_set(t, words) for t in texts_of(batch.column(1))]
                batch = batch.filter(pa.array([len(x) > 0 for x in sets], pa.bool_()))
                sets = [x for x in sets if len(x)]
                if not sets:
                    continue
                short = signatures(sets).astype(np.uint16)
                columns = ([r[:BRIEF].tobytes() for r in short], [r.tobytes() for r in short], [x.tobytes() for x in sets])
                yield pa.record_batch([batch.column(0), *(pa.array(c, pa.binary()) for c in columns)], ["node", "brief", "signature", "shingles"])
        _words.clear()  # workers outlive the stage

    return run


def _agree(least: float):
    """Signature verification of rows a, b, left, right."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for k in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((left == right).mean(axis=1) >= least if batch.num_rows else [], pa.bool_()))

    return run


def linked(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    """Whether two sets meet the threshold."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= threshold * (len(x) + len(y) - common)


def _confirmed(threshold: int):
    """Full signatures, then full sets, of rows a, b, left (signature, shingles), right."""
    least = floor(HASHES, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                same = (np.frombuffer(x["signature"], np.uint16) == np.frombuffer(y["signature"], np.uint16)).mean()
                keep.append(same >= least and linked(np.frombuffer(x["shingles"], np.uint64), np.frombuffer(y["shingles"], np.uint64), threshold))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _both(pairs: DataFrame, values: DataFrame, value: Column) -> DataFrame:
    """a, b and the value of each."""
    left = values.select(F.col("node").alias("a"), value.alias("left"))
    right = values.select(F.col("node").alias("b"), value.alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")


def _across(threshold: int):
    """Verified links of two blocks whose ends lie in different components, one for a node and a component."""
    least = floor(HASHES, threshold)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            x, y = (np.frombuffer(b"".join(d["signature"]), np.uint16).reshape(-1, HASHES) for d in (left, right))
            labels, nodes, sets = right["label"].to_numpy(), right["node"].to_numpy(), right["shingles"].to_numpy()
            for k in range(len(left)):
                same = (y == x[k]).mean(axis=1)
                near = np.flatnonzero((same >= least) & (labels != left["label"].iat[k]))
                own, met = np.frombuffer(left["shingles"].iat[k], np.uint64), set()
                for j in near[np.argsort(-same[near], kind="stable")].tolist():
                    if labels[j] not in met and linked(own, np.frombuffer(sets[j], np.uint64), threshold):
                        met.add(labels[j])
                        found.append((left["node"].iat[k], nodes[j]))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def near_duplicates(docs: DataFrame, words: int = 5, threshold: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = written(docs.mapInArrow(_prints(words), "doc_id long, n_shingles long, set_key binary, bands array<long>"), "prints")
    nodes = prints.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("node"))
    reps = prints.join(nodes.where("node IS NOT NULL").select(F.col("node").alias("doc_id"), "set_key"), ["doc_id", "set_key"], "left_semi")
    entries = reps.select(F.col("doc_id").alias("node"), F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("first"), F.max("node").alias("last"))
    members = written(entries.join(shared.where("first < last"), "bucket"), "buckets")
    asked = members.select(F.col("node").alias("doc_id")).distinct()
    facts = docs.join(asked, "doc_id", "left_semi").where("text IS NOT NULL").mapInArrow(_facts(words), "node long, brief binary, signature binary, shingles binary")
    facts = written(facts, "facts")
    whole = F.struct("signature", "shingles")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
        agreed = _both(pairs, facts, F.col("brief")).mapInArrow(_agree(floor(BRIEF, threshold)), "a long, b long")
        return written(_both(agreed, facts, whole).mapInArrow(_confirmed(threshold), "a long, b long"), "links")

    def open_buckets(links: list[DataFrame]) -> DataFrame:
        """Members, with labels, of buckets of three and more that reach over several components."""
        labels = components(reduce(DataFrame.union, links))
        now = members.where("size > 2").join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
        ends = now.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"))
        return written(now.join(ends.where("low < high").select("bucket"), "bucket", "left_semi"), "open")

    nearest = members.groupBy("node").agg(F.min("first").alias("b")).select(F.col("node").alias("a"), "b")
    alone = members.where("size = 2").select(F.col("first").alias("a"), F.col("last").alias("b"))
    links = [verified(nearest.union(alone))]
    still = open_buckets(links)
    hubs = still.groupBy("bucket").agg(F.min_by(F.struct("node", "label"), F.xxhash64("node")).alias("hub"))
    other = still.join(hubs, "bucket").where("label <> hub.label")
    links.append(verified(other.groupBy(F.col("node").alias("a")).agg(F.min_by("hub.node", F.xxhash64("hub.node")).alias("b"))))
    still = open_buckets(links)
    by_label = still.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    most = by_label.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("most"))
    gathered = written(still.join(most, "bucket").select("most", "node", "label").distinct(), "gathered")
    sizes = gathered.groupBy("most").agg(F.count("*").alias("every"), F.count_if(F.col("label") != F.col("most")).alias("rest"))
    spread = gathered.join(sizes, "most").join(facts.select("node", "signature", "shingles"), "node")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    block = lambda n: F.pmod(F.xxhash64("node", F.lit(n)), blocks(n)).cast("int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    rest = spread.where("label <> most").withColumn("i", block("rest")).withColumn("j", numbers("every"))
    every = spread.withColumn("j", block("every")).withColumn("i", numbers("rest"))
    keys = ["most", "i", "j"]
    columns = [*keys, "node", "label", "signature", "shingles"]
    rest, every = (side.select(*columns).toDF(*columns).groupBy(*keys) for side in (rest, every))
    links.append(written(rest.cogroup(every).applyInPandas(_across(threshold), "a long, b long"), "links"))
    labels = components(reduce(DataFrame.union, links))

    found = prints.select("doc_id", "n_shingles", "set_key").join(nodes, "set_key", "left").join(labels, "node", "left")
    return found.select("doc_id", "n_shingles", F.coalesce("label", "node", "doc_id").alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents on 2-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN CAST([] AS UBIGINT[]) WHEN len(ws) = 1 THEN [hash(ws[1])] ELSE list_transform(range(1, len(ws)), lambda i: hash(ws[i] || ' ' || ws[i + 1])) END) AS sh FROM w
), n AS (SELECT doc_id, sh, len(sh) AS k FROM s),
e AS (SELECT doc_id, k, unnest(sh) AS h FROM n), f AS (SELECT h, count(*) AS df FROM e GROUP BY 1),
p AS (SELECT doc_id, k, h FROM (SELECT doc_id, k, h, row_number() OVER (PARTITION BY doc_id ORDER BY df, h) AS place FROM e JOIN f USING (h)) WHERE place <= k - (4 * k + 4) // 5 + 1),
near AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM p a JOIN p b ON a.h = b.h AND a.doc_id < b.doc_id AND 100 * least(a.k, b.k) >= 80 * greatest(a.k, b.k)),
pairs AS (
  SELECT x, y FROM near JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 180 * len(list_intersect(a.sh, b.sh)) >= 80 * (a.k + b.k)
), links AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.r)
SELECT n.doc_id, CAST(n.k AS BIGINT) AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept
FROM n JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1) c ON c.doc_id = n.doc_id
"""
