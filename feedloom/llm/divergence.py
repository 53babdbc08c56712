"""Source divergence audit: which terms set a source apart from its language, and how far two sources of a
language lie apart, over the terms that enough documents of the language hold.

A term is a maximal run of ASCII letters and non-ASCII characters, A-Z in lower case.

Kept terms come by iceberg prefix refinement.  One pass turns each block of texts (about ``BLOCK_BYTES``) into a
table of its terms: occurrences by source, and for byte prefixes of 6, 12, 24, ... bytes the number of documents of the
block that hold a longer term with that prefix (a union, given with the first term of the prefix).  The sums over blocks
are then refined level by level: terms left are cut to the level's prefix, the distinct documents of each prefix
are summed, and terms whose prefix has fewer than ``support`` go.  A term no longer than the level is complete and its
count is its own; it is kept or gone.  The loop ends when no longer term is left, so its length is the logarithm of
the longest term that passes.  No document meets another one.

For a source's term, ``count`` is its occurrences there, N their sum over kept terms, V the number of kept terms:
p = 1 + floor(10^9 (count + 2) / (N + 2 V)), and q likewise for the other side; value = floor((p - q)^2 / (p + q)).
All arithmetic is on whole numbers.  Part ``pair`` compares two sources over all kept terms of the language,
part ``term`` a source with its whole language.  Sums over terms meet in blocks of about ``TERMS`` terms and
``SOURCES`` sources; terms that two blocks of sources both lack are added by their number.

Each row is a document, also where an id repeats.  Null text, language or source counts as ''.  Texts without
terms still give their source a group.  Where nothing is kept, V is 0, pairs have value 0 and there is no part
``term``.  An empty table gives no rows.  Only text, lang and source are read.  Texts and terms of any length are
taken whole; ties go to the lesser item by UTF-8 bytes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedloom.llm.common import table, written
from feedloom.scale import prefix_sums

SUPPORT, TOP = 10, 10
BLOCK_BYTES = 1 << 25
FIRST_LEVEL = 6
TERMS, SOURCES = 4096, 64
SPREAD = 32
OUT = 20_000  # rows of an Arrow batch given out
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text in order."""
    return text.translate(_LETTERS).split()


class _Block:
    """Texts of one language: term numbers of every text, and its source."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.found: list[np.ndarray] = []
        self.sources: list[str] = []

    def add(self, text: bytes, source: str) -> None:
        terms = terms_of(text)
        if terms:
            self.found.append(np.fromiter(map(self.number.__getitem__, terms), np.int64, len(terms)))
            self.sources.append(source)

    def rows(self, lang: str) -> Iterator[pa.RecordBatch]:
        """One row per term, in order of the terms' bytes."""
        if not self.found:
            return
        terms = sorted(self.number)
        rank = np.empty(len(terms), np.int64)
        rank[[self.number[t] for t in terms]] = np.arange(len(terms))
        n = len(self.found)
        lengths = [len(x) for x in self.found]
        key, count = np.unique(rank[np.concatenate(self.found)] * n + np.repeat(np.arange(n), lengths), return_counts=True)
        term, doc = key // n, key % n
        names, of = np.unique(np.array(self.sources, dtype=object), return_inverse=True)
        pair, back = np.unique(term * len(names) + of[doc], return_inverse=True)
        totals = np.bincount(back, weights=count).astype(np.int64)
        numbers, at_number = documents_of_prefixes(terms, term, doc, n)
        pair_at = np.searchsorted(pair // len(names), np.arange(len(terms) + 1))
        name = pa.array(names, pa.string()).take(pa.array(pair % len(names)))
        held = pa.StructArray.from_arrays([name, pa.array(totals)], ["source", "n"])
        for at in range(0, len(terms), OUT):
            end = min(at + OUT, len(terms))
            lists = [
                pa.ListArray.from_arrays(pa.array(offsets[at : end + 1] - offsets[at], pa.int32()), values.slice(offsets[at], offsets[end] - offsets[at]))
                for values, offsets in ((pa.array(numbers), at_number), (held, pair_at))
            ]
            yield pa.record_batch([pa.array([lang] * (end - at), pa.string()), pa.array(terms[at:end], pa.binary()), *lists], ["lang", "term", "numbers", "sources"])


def documents_of_prefixes(terms: list[bytes], term: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists of each term, flat and with their offsets: for every level below its length the documents of its prefix
    (0 unless it is the first longer term of that prefix), then its own documents.

    ``term`` and ``doc`` are the distinct pairs of a sorted term and one of n documents.
    """
    lengths = np.array([len(t) for t in terms])
    levels = [FIRST_LEVEL]
    while levels[-1] < lengths.max():
        levels.append(levels[-1] * 2)
    complete = np.searchsorted(levels, lengths)
    offsets = np.concatenate([[0], np.cumsum(complete + 1)])
    out = np.zeros(offsets[-1], np.int64)
    out[offsets[:-1] + complete] = np.bincount(term, minlength=len(terms))
    for k, level in enumerate(levels[:-1]):
        longer = np.flatnonzero(lengths > level)
        cut = [terms[r][:level] for r in longer.tolist()]
        opens = np.array([True, *(a != b for a, b in zip(cut, cut[1:]))])
        prefix = np.full(len(terms), -1)
        prefix[longer] = np.cumsum(opens) - 1
        own = prefix[term]
        key = np.unique(own[own >= 0] * n + doc[own >= 0])
        out[offsets[longer[opens]] + k] = np.bincount(key // n)
    return out, offsets


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows text (binary), lang, source to the terms of blocks."""
    size, blocks = 0, defaultdict(_Block)

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, block in blocks.items():
            yield from block.rows(lang)

    for batch in batches:
        for text, lang, source in zip(*(column.to_pylist() for column in batch.columns)):
            blocks[lang].add(text, source)
            size += len(text)
            if size >= BLOCK_BYTES:
                yield from flush()
                size, blocks = 0, defaultdict(_Block)
    yield from flush()


def kept_terms(docs: DataFrame, support: int = SUPPORT) -> DataFrame:
    """lang, source, term (binary), n (occurrences) of the terms that at least ``support`` documents of a language hold.

    ``docs`` has text, lang and source without nulls.
    """
    read = docs.select(F.col("text").cast("binary"), "lang", "source")
    schema = "lang string, term binary, numbers array<long>, sources array<struct<source: string, n: long>>"
    blocks = written(read.mapInArrow(_inverted, schema), "terms")
    levels = blocks.agg(F.max(F.size("numbers"))).first()[0] or 1
    sums = [F.sum(F.get("numbers", F.lit(k))).alias(f"n{k}") for k in range(levels)]
    left = written(blocks.groupBy("lang", "term").agg(*sums), "term-documents")
    kept = []
    for k in range(levels):
        length = FIRST_LEVEL << k
        cut = left.withColumns({"prefix": F.substring("term", 1, length), "done": F.octet_length("term") <= length})
        frequent = cut.groupBy("lang", "prefix", "done").agg(F.sum(f"n{k}").alias("n")).where(F.col("n") >= support)
        left = written(cut.join(frequent, ["lang", "prefix", "done"], "left_semi").drop("prefix", f"n{k}"), "term-documents")
        kept.append(left.where("done").select("lang", "term"))
        left = left.where("NOT done").drop("done")
        if left.isEmpty():
            break
    every = blocks.join(reduce(DataFrame.union, kept), ["lang", "term"]).select("lang", "term", F.explode("sources").alias("s"))
    return every.groupBy("lang", F.col("s.source").alias("source"), "term").agg(F.sum("s.n").alias("n"))


def share(count: str, total: str) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 kept)) of columns; null where nothing is kept."""
    above, below = f"CAST({count} + 2 AS DECIMAL(19, 0)) * 1000000000", f"CAST({total} + 2 * kept AS DECIMAL(19, 0))"
    return F.expr(f"CASE WHEN kept > 0 THEN 1 + CAST({above} div {below} AS BIGINT) END")


def _sums(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sums over the terms of one group for each pair of a source of block ``low`` and a later one of block ``high``.

    Rows without term name the sources (``own``: block) with their share of a term they lack.
    """
    held = pdf["term"].notna()
    groups = pdf[~held].sort_values("idx")
    codes, terms = pd.factorize(pdf.loc[held, "term"])
    p = np.repeat(groups["p"].to_numpy(np.int64)[:, None], len(terms) + 1, axis=1)  # the last column: a term that both lack
    place = {idx: k for k, idx in enumerate(groups["idx"])}
    p[[place[idx] for idx in pdf.loc[held, "idx"]], codes] = pdf.loc[held, "p"].to_numpy(np.int64)
    names, own = groups["source"].to_numpy(), groups["own"].to_numpy()
    low, high = pdf["low"].iat[0], pdf["high"].iat[0]
    second = np.flatnonzero(own == high)
    out = []
    for a in np.flatnonzero(own == low):
        others = second[second > a]
        step = p[others] - p[a]
        value = step * step // np.maximum(p[others] + p[a], 1)
        out += zip([names[a]] * len(others), names[others], value[:, :-1].sum(axis=1).tolist(), value[:, -1].tolist())
    found = pd.DataFrame(out, columns=["source", "item", "value", "rest"])
    return found.assign(lang=pdf["lang"].iat[0], n=len(terms), kept=groups["kept"].iat[0])[["lang", "source", "item", "value", "rest", "n", "kept"]]


def pair_values(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value of all ordered pairs of sources.

    ``shares``: lang, idx, term, p; ``groups``: lang, source, idx, p (of a term it lacks), kept, sources (of the language).
    """
    parts = F.greatest(F.lit(1), F.ceil(F.col("kept") / TERMS)).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.ceil(F.col("sources") / SOURCES).cast("int") - 1))
    own = F.floor(F.col("idx") / SOURCES).cast("int")
    columns = ["lang", "part", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "idx", "source", "term", "p", "kept"]
    held = shares.withColumn("part", F.pmod(F.xxhash64("term"), parts).cast("int"))
    named = groups.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("term", F.lit(None).cast("binary"))
    rows = held.unionByName(named, allowMissingColumns=True).withColumn("own", own).withColumn("other", others).select(*columns)
    schema = "lang string, source string, item string, value long, rest long, n long, kept long"
    sums = rows.groupBy("lang", "part", "low", "high").applyInPandas(_sums, schema).groupBy("lang", "source", "item")
    total = (F.sum("value") + F.max("rest") * (F.max("kept") - F.sum("n"))).alias("value")
    pairs = sums.agg(total)
    return pairs.select("lang", "source", "item", "value").union(pairs.select("lang", "item", "source", "value"))


def audit(docs: DataFrame, support: int = SUPPORT, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank of ``docs`` (text, lang, source)."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    counts = written(kept_terms(docs, support), "term-counts")
    of_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    langs = of_lang.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = prefix_sums(docs.select("lang", "source").distinct(), ["lang"], ["source"], {"place": F.lit(1).cast("long")})
    sizes = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    groups = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang").join(langs, "lang", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    groups = written(groups.select("lang", "source", (F.col("place") - 1).alias("idx"), "sources", *[zero(c) for c in ("total", "kept", "lang_total")]), "groups")

    copies = groups.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    spread = counts.withColumn("copy", F.pmod(F.xxhash64("term"), F.lit(SPREAD)).cast("int"))
    shares = spread.join(copies, ["lang", "source", "copy"]).withColumn("p", share("n", "total")).drop("copy")
    q = share("lang_n", "lang_total")
    above = shares.join(of_lang, ["lang", "term"]).withColumn("q", q).where("p > q")
    terms = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    lacking = F.coalesce(share("0", "total"), F.lit(0))
    named = groups.select("lang", "source", "idx", lacking.alias("p"), "kept", "sources")
    pairs = pair_values(shares.select("lang", "idx", "term", "p", "kept", "sources"), named)
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    best = terms.withColumn("rank", rank).where(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).union(best)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: sources against each other and against their language, terms of at least ten documents."""
    return audit(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
), o AS (SELECT k, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT k) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT l.lang, count(kept.term) AS v FROM (SELECT DISTINCT lang FROM g) l LEFT JOIN kept ON kept.lang = l.lang GROUP BY 1),
t AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
a AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (t.total + 2 * v.v) AS p
  FROM g JOIN kept ON kept.lang = g.lang JOIN v ON v.lang = g.lang JOIN t ON t.lang = g.lang AND t.source = g.source
    LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
), w AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 2)) // (sum(sum(n)) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)) AS q FROM a GROUP BY lang, term
), pair AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(sum(((px.p - py.p) * (px.p - py.p)) // (px.p + py.p)), 0) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
    LEFT JOIN a px ON px.lang = x.lang AND px.source = x.source LEFT JOIN a py ON py.lang = y.lang AND py.source = y.source AND py.term = px.term
  GROUP BY ALL
), term AS (
  SELECT a.lang, a.source, 'term' AS part, a.term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM a JOIN w ON w.lang = a.lang AND w.term = a.term WHERE n > 0 AND p > q
), r AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM r WHERE part = 'pair' OR rank <= 10
"""
