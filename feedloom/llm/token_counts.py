"""Token counts of whole texts by a map-side two-tier lookup.

First tier: a compact table of frequent chunks (text between white space, lower-cased) and their
token counts, broadcast to the workers.  It holds at most ``TABLE`` entries whatever the corpus and
is counted over all documents: each task keeps a bounded count and hands on only the chunks whose share
of its own could put them into the table.  It only decides how fast a count is found, never its value.  Second tier: a chunk that is not in the table is encoded by the tokenizer's BPE model once
per worker and remembered in a bounded cache.  Pre-tokens of the texts are never shuffled.

Null texts count as empty texts (0 bytes, 0 tokens).  Rows are never merged, so repeated rows give
repeated results and an empty table an empty result; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.common import longs, table, texts_of
from feedloom.llm.tokens import PLAIN, WordCounts

TABLE = 16_384
HELD = 16 * TABLE
LIMIT = 2048

_WORKER: dict = {}


def frequent_chunks(texts: DataFrame, size: int = TABLE, held: int = HELD) -> list[str]:
    """The most frequent chunks of all texts, most frequent first.

    A task's count holds at most ``held`` chunks and those of one batch.  A chunk with a share of 1 in 4 ``size`` of
    the corpus has that share in some task, so the others are left where they are.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        total = 0
        for batch in batches:
            for text in texts_of(batch.column(0)):
                if PLAIN.fullmatch(text):
                    words = text.lower().split()
                    total += len(words)
                    seen.update(words)
            if len(seen) > held:
                seen = Counter(dict(seen.most_common(held // 4)))
        best = [(c, n) for c, n in seen.most_common(size) if n > 1 and 4 * size * n >= total]
        yield pa.record_batch([pa.array([c for c, _ in best], pa.string()), longs([n for _, n in best])], ["chunk", "n"])

    counted = texts.select("text").mapInArrow(count, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))
    return [r["chunk"] for r in counted.orderBy(F.desc("n"), "chunk").limit(size).collect()]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    chunks = frequent_chunks(docs)
    counts = WordCounts(tokenizer)
    packed = spark.sparkContext.broadcast(("\n".join(chunks), bytes(min(counts.chunks[c], 255) for c in chunks)))

    name = uuid.uuid4().hex

    def worker() -> WordCounts:
        key = (name, tokenizer)
        if _WORKER.get("key") != key:
            joined, lengths = packed.value
            known = {c: n for c, n in zip(joined.split("\n"), lengths) if 0 < n < 255}
            _WORKER.update(key=key, counts=WordCounts(tokenizer, known))
        return _WORKER["counts"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker()
        for batch in batches:
            texts = texts_of(batch.column(1))
            n = longs([own.count(t) for t in texts])
            size = longs([len(t.encode()) for t in texts])
            yield pa.record_batch([batch.column(0), size, n], ["doc_id", "n_bytes", "n_tokens"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return count_tokens(table(spark, sf_dir, "documents"), "word_bpe_49k.json")
