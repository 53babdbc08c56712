"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are folded: letters and digits in lower case, every run of anything else one space.  A passage
of m characters may differ from a stretch of a document by k = ``rate`` * m edits, less where the
passage is too short for the filter.  An occurrence within k edits keeps at least m + 1 - q (k + 1)
of the passage's q-grams, and their diagonals (place in the document less place in the passage) lie
within k of each other.  So shared q-grams are counted in diagonal bands that are twice as wide as
their step and overlap by half; a band below the bound can't hold an occurrence, and every other one
is verified by an alignment within the band.  Passages shorter than q + 1 are searched as they are.

A document is worked on where it lies; nothing but what is found is shuffled.  The distinct passages are broadcast in blocks of
about ``BLOCK_CHARS`` characters, as many blocks as the benchmark needs.  A document is scanned in
overlapping segments and slices of shared q-grams, so memory does not grow with the batch, the text or its repeats.

One row per document row and passage found in it.  Null and empty texts hold nothing, null or empty
passages are found nowhere, a repeated passage row adds rows of its own, a repeated document row repeats its rows,
and empty tables give an empty result.  Of several occurrences the one with the fewest edits, then the first, is given.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.common import table, texts_of, written
from feedloom.scale import prefix_sums

Q = 9
RATE = 0.08
BLOCK_CHARS = 2_000_000
SEGMENT = 1 << 20
HITS = 1 << 20
FOUND = "doc_id long, passage string, start long, end long, edits long"
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93))
_BITS = 22


@cache
def folded_codes() -> np.ndarray:
    """Code point of the lower case of a letter or digit, a space for anything else."""
    codes = np.full(0x110000, 32, dtype=np.uint32)
    for k in range(0x110000):
        c = chr(k)
        if c.isalnum():
            low = c.lower()
            codes[k] = ord(low) if len(low) == 1 else k
    return codes


def folded(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points and the place in the text of each."""
    codes = folded_codes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    space = codes == 32
    keep = ~space
    keep[1:] |= ~space[:-1]
    if len(keep) and space[0]:
        keep[0] = False
    at = np.flatnonzero(keep)
    if len(at) and space[at[-1]]:
        at = at[:-1]
    return codes[at], at


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """64-bit hashes of all q-grams; doubling makes it a few passes over the codes."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, width = codes.astype(np.uint64) + np.uint64(1), 1
    out, done, step = np.zeros(n, np.uint64), 0, 0
    while True:
        if q & width:
            out = (out ^ (out >> np.uint64(29))) * _ODD[0] + power[done : done + n]
            done += width
        if done == q:
            return out ^ (out >> np.uint64(32))
        head = power[: len(power) - width]
        power = (head ^ (head >> np.uint64(31))) * _ODD[1 + step % 3] + power[width:]
        width, step = width * 2, step + 1


def budget(m: int, q: int, rate: float) -> int:
    """Edits allowed for a passage of m characters; at least one q-gram must be sure to stay."""
    return max(0, min(int(rate * m), m // q - 1))


class Passages:
    """The q-grams of a block of passages."""

    def __init__(self, items: list[tuple], q: int = Q, rate: float = RATE):
        self.q = q
        kept = [(i, folded(t)[0]) for i, t in items if t]
        kept = [(i, c) for i, c in kept if len(c)]
        self.ids, self.codes = [i for i, _ in kept], [c for _, c in kept]
        self.edits = np.array([budget(len(c), q, rate) for c in self.codes], dtype=np.int64)
        self.short = [k for k, c in enumerate(self.codes) if len(c) <= q]
        long = [k for k, c in enumerate(self.codes) if len(c) > q]
        hashes = [gram_hashes(self.codes[k], q) for k in long]
        owner = np.repeat(np.array(long, dtype=np.int64), [len(h) for h in hashes]) if long else np.zeros(0, np.int64)
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if long else np.zeros(0, np.int64)
        grams = np.concatenate(hashes) if long else np.zeros(0, np.uint64)
        by = np.argsort(grams, kind="stable")
        self.grams, self.owner, self.place = grams[by], owner[by], place[by]
        self.bound = np.array([max(1, len(c) + 1 - q * (e + 1)) for c, e in zip(self.codes, self.edits)], dtype=np.int64)
        self.bits = np.zeros(1 << _BITS, dtype=bool)
        self.bits[(self.grams * _ODD[0]) >> np.uint64(64 - _BITS)] = True
        self.reach = 2 * max((len(c) + e for c, e in zip(self.codes, self.edits)), default=0) + q

    def bands(self, codes: np.ndarray) -> list[tuple[int, int, int]]:
        """Passage and range of diagonals of every band that meets the bound, by passage and place.

        Shared q-grams are counted in slices of about ``HITS``, so a text that repeats itself needs no more memory.
        """
        h = gram_hashes(codes, self.q)
        at = np.flatnonzero(self.bits[(h * _ODD[0]) >> np.uint64(64 - _BITS)])
        first, last = np.searchsorted(self.grams, h[at], "left"), np.searchsorted(self.grams, h[at], "right")
        times = last - first
        at, first, times = at[times > 0], first[times > 0], times[times > 0]
        if not len(at):
            return []
        shift, span = -len(codes) - 2 * self.reach - 2, 2 * len(codes) + 4 * self.reach + 4  # bands lie in shift .. shift + span
        known, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends = np.cumsum(times)
        low = 0
        while low < len(at):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + HITS, "right")))
            n = times[low:high]
            entry = np.repeat(first[low:high] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            owner, diagonal = self.owner[entry], np.repeat(at[low:high], n) - self.place[entry]
            band = diagonal // (self.edits[owner] + 1)
            keys, new = np.unique(owner * span + band - shift, return_counts=True)
            keys, new = np.concatenate([known, keys, keys - 1]), np.concatenate([counts, new, new])  # a band and the half of the one before
            known, back = np.unique(keys, return_inverse=True)
            counts = np.bincount(back, weights=new, minlength=len(known)).astype(np.int64)
            low = high
        owner, band = known // span, known % span + shift
        keep = counts >= self.bound[owner]
        step = self.edits[owner] + 1
        return list(zip(owner[keep].tolist(), (band * step)[keep].tolist(), ((band + 2) * step - 1)[keep].tolist()))

    def within(self, codes: np.ndarray) -> dict[int, tuple[int, int, int]]:
        """Best (edits, start, end) of each passage that occurs in the folded text."""
        found: dict[int, tuple[int, int, int]] = {}

        def add(k: int, hit: tuple[int, int, int] | None) -> None:
            if hit is not None and (k not in found or hit < found[k]):
                found[k] = hit

        for low in range(0, max(1, len(codes)), SEGMENT):
            part = codes[low : low + SEGMENT + self.reach]
            for k, a, b in self.bands(part):
                if k in found and found[k][0] == 0:
                    continue  # bands come by place: no better occurrence can follow
                hit = aligned(self.codes[k], part, a, b, int(self.edits[k]))
                add(k, hit and (hit[0], low + hit[1], low + hit[2]))
        if self.short:
            whole = " " + "".join(map(chr, codes.tolist())) + " "
            for k in self.short:
                at = whole.find(" " + "".join(map(chr, self.codes[k].tolist())) + " ")
                add(k, None if at < 0 else (0, at, at + len(self.codes[k])))
        return found


def last_row(item: np.ndarray, text: np.ndarray, low: int, high: int, free: bool) -> np.ndarray:
    """Edits of the whole item against text ending at each place i = len(item) + low .. high; the start
    is free, or must be the text's own start.  Only diagonals low..high are looked at."""
    width = high - low + 1
    steps = np.arange(width)
    far = len(item) + len(text) + 1
    places = low + steps  # text characters used before the first of the item
    row = np.where((places >= 0) & (places <= len(text)), 0 if free else places, far)
    padded = np.full(len(item) + width + 2, -1, dtype=np.int64)
    source = np.arange(low, low + len(padded))
    inside = (source >= 0) & (source < len(text))
    padded[inside] = text[source[inside]]
    for i, c in enumerate(item):
        valid = (places + i + 1 >= 0) & (places + i + 1 <= len(text))
        same = padded[i : i + width] != c
        down = np.append(row[1:], far) + 1
        best = np.where(valid, np.minimum(row + same, down), far)
        row = np.minimum.accumulate(best - steps) + steps
        row = np.where(valid, row, far)
    return row


def aligned(item: np.ndarray, text: np.ndarray, low: int, high: int, edits: int) -> tuple[int, int, int] | None:
    """Best (edits, start, end) of the item in text on diagonals low - edits .. high + edits."""
    m = len(item)
    for start in range(max(0, low), min(high, len(text) - m) + 1):
        if text[start] == item[0] and (text[start : start + m] == item).all():
            return 0, start, start + m
    low, high = low - edits, high + edits
    row = last_row(item, text, low, high, True)
    best = int(row.min())
    if best > edits:
        return None
    end = m + low + int(row.argmin())
    back = text[max(0, end - m - edits) : end][::-1]
    row = last_row(item[::-1], back, -edits, edits, False)
    return best, end - (m - edits + int(row.argmin())), end


def passage_blocks(items: DataFrame, q: int, rate: float) -> Iterator:
    """Broadcast passages, one block after the other.  A passage is known by the digest of its text, copies count once, and
    a block holds distinct texts of about ``BLOCK_CHARS`` characters in total (one passage more at most)."""
    texts = items.where("text IS NOT NULL").select("text", F.md5("text").alias("passage")).dropDuplicates(["passage"])
    numbered = prefix_sums(texts.withColumn("n", F.length("text").cast("long")), [], ["passage"], {"upto": F.col("n")})
    numbered = written(numbered.select("passage", "text", F.floor((F.col("upto") - F.col("n")) / BLOCK_CHARS).alias("block")), "passages")
    for block in range((numbered.agg(F.max("block")).first()[0] or 0) + 1):
        own = numbered.where(F.col("block") == block).select("passage", "text").orderBy("passage").collect()
        yield items.sparkSession.sparkContext.broadcast(Passages([tuple(r) for r in own], q, rate))


def contaminated(docs: DataFrame, items: DataFrame, q: int = Q, rate: float = RATE) -> DataFrame:
    """doc_id, item_id, start, end (code points), edits of the passages found in docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def searched(passages) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = passages.value
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                    codes, places = folded(text)
                    for k, (edits, a, b) in known.within(codes).items():
                        rows.append((doc_id, known.ids[k], int(places[a]), int(places[b - 1]) + 1, edits))
                kinds = [pa.int64(), pa.string(), *[pa.int64()] * 3]
                columns = list(zip(*rows)) or [[]] * 5
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "passage", "start", "end", "edits"])

        return docs.mapInArrow(run, FOUND)

    named = items.select(F.col("item_id").cast("long").alias("item_id"), F.md5("text").alias("passage"))
    found = reduce(DataFrame.union, map(searched, passage_blocks(items, q, rate)))
    return found.join(named, "passage").select("doc_id", "item_id", "start", "end", "edits")


def _clean(passages):
    """Whether a text holds none of the broadcast passages."""

    def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = passages.value
        for texts in columns:
            yield pd.Series([not known.within(folded(t)[0]) for t in texts], dtype=bool)

    return F.pandas_udf(run, "boolean")


def uncontaminated(docs: DataFrame, items: DataFrame, q: int = Q, rate: float = RATE) -> DataFrame:
    """The rows of docs in which no passage is found.  Only the text goes to Python, and only the answer comes back."""
    for passages in passage_blocks(items, q, rate):
        docs = docs.where(_clean(passages)(F.coalesce("text", F.lit(""))))
    return docs


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of the benchmark in all documents."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
