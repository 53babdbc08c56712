"""Conversation prefix trie: one node for each distinct sequence of first turns, its members, and totals of every
subtree by parallel tree contraction.

Turns are ordered by ``turn`` (null first), then role, then the hash of the turn; null role and text count as
empty.  A turn is known by the SHA-256 of its role and text.  A node is known by its depth and the sums of six 32-bit parts
of the hashes of (place, turn), each modulo 2^32, so a conversation's nodes are prefix sums: conversations of
any length are cut into buckets of places and no task holds one whole.

Contraction (``subtree_totals``): every node carries its own values and, on the link to its parent, what contracted nodes
between them held.  A round rakes all leaves (a leaf's total is known; it goes to the parent as a sum) and then
compresses unary chains: a chain node goes into the next node below and leaves its values on that node's link.
Chains are found along spines (a node's spine is its deepest member, so a chain keeps its spine) within
windows of depth that widen from round to round; where a chain passes from one spine to another, one half of
the spines, drawn anew in each round, takes over the label of the node below.  The loop ends when all nodes are gone.
Then the rounds are run backwards: a compressed node's total is that of the node it went into plus what lay between.

The root has depth 0, no text and all conversations, also such as have no turns.  Rows without conversation id are left
out.  Equal rows are turns of their own.  An empty table has no nodes.  Other columns are not read.  Texts of any length
are hashed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedloom.llm.common import table, written
from feedloom.llm.mixing import size_of
from feedloom.scale import prefix_sums

PARTS = 6
BUCKET = 1024  # places of a conversation that are summed together
IDS = 4096  # conversation ids of one block of the list that is hashed
SPREAD = 256
WIDTH = 6  # bits of the first window of depth; each round adds three


def keyed_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), key, words of the turns of ``conversations`` (conv_id, turn, role, text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), key.alias("key"), size_of(text).alias("words")
    )
    placed = prefix_sums(turns, ["conv_id"], ["turn", "role", "key"], {"place": F.lit(1).cast("long")})
    return placed.select("conv_id", "place", "key", "words")


def _parts() -> list[Column]:
    """Parts of the hash of a place and its turn."""
    both = F.sha2(F.concat(F.col("place").cast("string").cast("binary"), F.lit(":").cast("binary"), F.col("key")), 256)
    return [F.conv(F.substring(both, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k}") for k in range(PARTS)]


def _node(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat_ws(",", depth.cast("string"), *[F.pmod(s, F.lit(1 << 32)).cast("string") for s in sums]), 256))


def paths(turns: DataFrame, members: DataFrame) -> DataFrame:
    """conv_id, depth, node, parent, words (of the last turn), length (of the conversation) of every prefix.

    ``turns``: conv_id, place (1, 2, ... without gaps), key, words; ``members``: conv_id of every conversation.
    """
    start = members.select("conv_id", F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("words"), *[F.lit(0).cast("long").alias(f"h{k}") for k in range(PARTS)])
    steps = start.unionByName(turns.select("conv_id", "place", "words", *_parts())).withColumn("bucket", F.floor(F.col("place") / BUCKET))
    inside = Window.partitionBy("conv_id", "bucket").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    local = steps.select("*", *[F.sum(f"h{k}").over(inside).alias(f"l{k}") for k in range(PARTS)])
    before = Window.partitionBy("conv_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = steps.groupBy("conv_id", "bucket").agg(F.max("place").alias("last"), *[F.sum(f"h{k}").alias(f"s{k}") for k in range(PARTS)])
    carried = buckets.select(
        "conv_id", "bucket", F.max("last").over(Window.partitionBy("conv_id")).alias("length"),
        *[F.coalesce(F.sum(F.pmod(f"s{k}", F.lit(1 << 32))).over(before), F.lit(0)).alias(f"c{k}") for k in range(PARTS)],
    )
    sums = [F.col(f"l{k}") + F.col(f"c{k}") for k in range(PARTS)]
    above = [s - F.col(f"h{k}") for k, s in enumerate(sums)]
    return local.join(carried, ["conv_id", "bucket"]).select(
        "conv_id",
        F.col("place").alias("depth"),
        _node(F.col("place"), sums).alias("node"),
        F.when(F.col("place") > 0, _node(F.col("place") - 1, above)).alias("parent"),
        "words",
        "length",
    )


def _id_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows node, conv_id to lists of up to ``IDS`` decimal ids: node, first, ids."""
    rows = (row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns)))
    out: list[tuple] = []

    def given() -> pa.RecordBatch:
        columns = zip(*out)
        return pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.string()))], ["node", "first", "ids"])

    for node, group in groupby(rows, lambda r: r[0]):
        block: list[int] = []
        for _, conv in group:
            block.append(conv)
            if len(block) == IDS:
                out.append((node, block[0], ",".join(map(str, block))))
                block = []
        if block:
            out.append((node, block[0], ",".join(map(str, block))))
        if len(out) >= IDS:
            yield given()
            out.clear()
    if out:
        yield given()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows node, ids in order of the first id to node, ends_sha256; a block of ids is held at a time."""
    rows = (row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns)))
    nodes, digests = [], []
    for node, group in groupby(rows, lambda r: r[0]):
        digest = hashlib.sha256()
        for k, (_, ids) in enumerate(group):
            digest.update(f",{ids}".encode() if k else ids.encode())
        nodes.append(node)
        digests.append(digest.hexdigest())
        if len(nodes) >= IDS:
            yield pa.record_batch([pa.array(nodes, pa.binary()), pa.array(digests)], ["node", "ends_sha256"])
            nodes, digests = [], []
    if nodes:
        yield pa.record_batch([pa.array(nodes, pa.binary()), pa.array(digests)], ["node", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """node, ends_sha256 of rows (node, conv_id): a range sort, lists of ids per range, one hash over the lists of a node."""
    blocks = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_id_blocks, "node binary, first long, ids string")
    ordered = blocks.repartition("node").sortWithinPartitions("node", "first").select("node", "ids")
    return ordered.mapInArrow(_hashed, "node binary, ends_sha256 string")


def subtree_totals(nodes: DataFrame, values: list[str]) -> DataFrame:
    """node and the sums of ``values`` over its subtree, itself included.

    ``nodes``: node, parent (null: a root), depth, spine (equal for a node and its only child), n_children, values.
    """
    total = lambda c: f"t_{c}"
    state = nodes.select(
        "node", "parent", "depth", F.col("spine").alias("label"), F.col("n_children").alias("open"), *[F.col(c).cast("long").alias(f"w_{c}") for c in values],
        *[F.lit(0).cast("long").alias(f"e_{c}") for c in values],
    )
    raked, compressed = [], []
    window = WIDTH
    while not state.isEmpty():
        # rake
        leaf = F.col("open") == 0
        raked.append(state.where(leaf).select("node", *[F.col(f"w_{c}").alias(total(c)) for c in values]))
        below = state.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(
            F.count_if(~leaf).alias("inner"),
            F.max(F.when(~leaf, F.col("label"))).alias("below"),
            *[F.sum(F.when(leaf, F.col(f"w_{c}") + F.col(f"e_{c}")).otherwise(0)).alias(f"r_{c}") for c in values],
        )
        # a node with one child left may take over that child's label
        seed = F.lit(len(raked))
        drawn = (F.pmod(F.xxhash64("label", seed), F.lit(2)) == 0) & (F.pmod(F.xxhash64("below", seed), F.lit(2)) == 1)
        label = F.when((F.col("inner") == 1) & (F.col("below") != F.col("label")) & drawn, F.col("below")).otherwise(F.col("label"))
        inner = state.where(~leaf).join(below, "node").select(
            "node", "parent", "depth", label.alias("label"), F.col("inner").alias("open"),
            (F.col("inner").eqNullSafe(1) & (F.col("below") == label)).alias("unary"),
            *[(F.col(f"w_{c}") + F.col(f"r_{c}")).alias(f"w_{c}") for c in values], *[f"e_{c}" for c in values],
        )
        # compress: a unary node goes into the next node of its label in the window of depth
        span = Window.partitionBy("label", F.shiftright("depth", window)).orderBy("depth")
        chained = inner.withColumn("goes", F.col("unary") & F.lead("node").over(span).isNotNull())
        upto = span.rowsBetween(Window.unboundedPreceding, -1)
        chained = chained.withColumns(
            {
                "run": F.coalesce(F.sum(F.when(F.col("goes"), 0).otherwise(1)).over(upto), F.lit(0)),
                **{f"p_{c}": F.coalesce(F.sum(F.col(f"w_{c}") + F.col(f"e_{c}")).over(upto), F.lit(0)) for c in values},
            }
        )
        run = Window.partitionBy("label", F.shiftright("depth", window), "run").orderBy("depth")
        whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        chained = chained.withColumns(
            {
                "top": F.first("parent").over(whole),
                "into": F.last("node").over(whole),
                **{f"a_{c}": F.col(f"p_{c}") - F.first(f"p_{c}").over(whole) for c in values},  # of the run above the node
                **{f"b_{c}": F.last(f"p_{c}").over(whole) - F.col(f"p_{c}") + F.last(f"e_{c}").over(whole) - F.col(f"e_{c}") for c in values},
            }
        )
        chained = written(chained, "chains")
        compressed.append(chained.where("goes").select("node", "into", *[f"b_{c}" for c in values]))
        state = chained.where("NOT goes").select(
            "node", F.col("top").alias("parent"), "depth", "label", "open", *[f"w_{c}" for c in values], *[(F.col(f"e_{c}") + F.col(f"a_{c}")).alias(f"e_{c}") for c in values]
        )
        window = min(window + 3, 62)
    named = ["node", *[total(c) for c in values]]
    if not raked:
        return nodes.select("node", *[F.col(c).cast("long").alias(total(c)) for c in values])
    known = raked
    for k in reversed(range(len(compressed))):  # a node of round k went into one that was raked or compressed later
        into = reduce(DataFrame.union, known[k + 1 :]).withColumnRenamed("node", "into") if known[k + 1 :] else None
        if into is not None:
            found = compressed[k].join(into, "into").select("node", *[(F.col(total(c)) + F.col(f"b_{c}")).alias(total(c)) for c in values])
            known = [*known, written(found.select(*named), "totals")]
    return reduce(DataFrame.union, known)


def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, node, parent of every node.

    ``turns`` and ``members`` as for ``paths``.
    """
    rows = written(paths(turns, members), "paths")
    named = rows.groupBy("node", "parent", "depth", "words").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max_by("conv_id", F.struct("length", "conv_id")).alias("spine")
    )
    nodes = written(named, "nodes")
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("words"))
    nodes = written(nodes, "nodes")
    totals = subtree_totals(nodes, ["leaf", "saved"])
    copy = F.pmod(F.xxhash64("node"), F.lit(SPREAD)).alias("copy")
    above = nodes.where("parent IS NOT NULL").select("parent", copy).distinct()
    above = above.join(nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent")
    ends = end_digests(rows.where("depth = length").select("node", "conv_id"))
    return (
        nodes.withColumn("copy", copy)
        .join(above, ["parent", "copy"], "left")
        .join(totals, "node")
        .join(ends, "node", "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("t_leaf").alias("n_leaves"), F.col("t_saved").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"), "node", "parent",
        )
    )


def rebuilt(turns: DataFrame, members: DataFrame) -> DataFrame:
    """Every conversation c with the first h = crc32(c) % 4 turns of conversation c - c % 20 in place of its own first h."""
    base = F.col("conv_id") - F.col("conv_id") % 20
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    taken = members.select("conv_id", base.alias("base"), h.alias("h"))
    heads = turns.where("place <= 3 AND conv_id % 20 = 0").select(F.col("conv_id").alias("base"), "place", "key", "words")
    given = taken.join(heads, "base").where("place <= h").select("conv_id", "place", "key", "words")
    lengths = heads.groupBy("base").agg(F.max("place").alias("head"))
    own = turns.withColumn("h", h).withColumn("base", base).where("place > h").withColumn("bucket", F.floor(F.col("place") / BUCKET))
    moved = own.join(own.select("base", "bucket").distinct().join(lengths, "base"), ["base", "bucket"], "left")
    shifted = F.col("place") - F.col("h") + F.least("h", F.coalesce("head", F.lit(0)))
    return given.union(moved.select("conv_id", shifted.alias("place"), "key", "words"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of all conversations, rebuilt so that they share first turns."""
    turns = written(keyed_turns(table(spark, sf_dir, "conversations")), "turns")
    members = turns.select("conv_id").distinct()
    found = prefix_trie(rebuilt(turns, members), members)
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


OP11_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place,
    sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL
), m AS (
  SELECT c, c - c % 20 AS base, xor(list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda v, x: list_reduce(range(8), lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END, xor(v, x)), 4294967295), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT c FROM t)
), r AS (
  SELECT m.c, t.place, key, words FROM m JOIN t ON t.c = m.base AND t.place <= m.h
  UNION ALL
  SELECT m.c, t.place - h + least(h, (SELECT count(*) FROM t b WHERE b.c = m.base)), key, words FROM m JOIN t ON t.c = m.c AND t.place > m.h
), l AS (
  SELECT m.c, coalesce(list(key ORDER BY place) FILTER (key IS NOT NULL), []) AS ks, coalesce(list(words ORDER BY place) FILTER (key IS NOT NULL), []) AS ws FROM m LEFT JOIN r ON r.c = m.c GROUP BY m.c
), p AS (
  SELECT c, d, array_to_string(ks[1:d], ',') AS id, CASE WHEN d > 0 THEN array_to_string(ks[1:d - 1], ',') END AS parent, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS words, d = len(ks) AS ends
  FROM (SELECT *, unnest(range(len(ks) + 1)) AS d FROM l)
), n AS (
  SELECT id, d, parent, min(c) AS c, count(*) AS n_convs, (count(*) - 1) * max(words) AS saved, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '') AS ids FROM p GROUP BY id, d, parent
), k AS (SELECT parent, count(*) AS n_children FROM n GROUP BY 1),
f AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON k.parent = n.id),
s AS (SELECT a.id, count(*) FILTER (f.n_children = 0) AS n_leaves, sum(f.saved) AS saved FROM f JOIN p a ON a.c = f.c AND a.d <= f.d GROUP BY 1)
SELECT f.c AS conv_id, CAST(f.d AS BIGINT) AS depth, u.c AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(f.ids) AS ends_sha256
FROM f JOIN s ON s.id = f.id LEFT JOIN f u ON u.id = f.parent
"""
