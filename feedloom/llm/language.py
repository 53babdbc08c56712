"""Language identification by hyperdimensional letter n-gram profiles.

Each letter has a pseudo-random vector of +1 and -1.  An n-gram's vector binds its letters: each
letter's vector is rotated by its place and the vectors are multiplied.  A text's vector bundles
(adds) the vectors of its n-grams, a language's prototype bundles the unit vectors of its labelled
texts, and a text gets the language whose prototype has the greatest cosine with it.

Letters are lower-cased; everything else counts as one space between words, so hot words, digits and
punctuation carry no weight.  The prototypes are summed on the executors from a bounded sample of
labelled rows: about ``FIT_ROWS`` rows chosen by a hash of the id.  What the prototypes share (their
mean) is taken off before texts are compared.

``score`` is the cosine, cut to 0 to 1.  A text that is null or has no letter gets ``und`` and score 0,
and so does every text where nothing could be learned.  Ties go to the first language by name.  Rows
are never merged; repeated rows get the same answer; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from feedloom.llm.common import table, texts_of

DIMENSIONS = 2048
GRAM = 3
FIT_ROWS = 12_000
PART = 512  # n-grams whose vectors are multiplied at once; the C library keeps freed blocks of the largest size met
UNKNOWN = "und"
_CODES = 0x110000


@cache
def folded_codes() -> np.ndarray:
    """Code of each code point: itself for a letter, 0 for anything else."""
    return np.fromiter((k if chr(k).isalpha() else 0 for k in range(_CODES)), dtype=np.int32, count=_CODES)


@cache
def letter_vector(code: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(code + 7)).integers(0, 2, DIMENSIONS, dtype=np.int8) * np.int8(2) - np.int8(1)


class Grams:
    """Vectors of the n-grams met so far; at most ``limit`` are kept."""

    def __init__(self, limit: int = 20_000):
        self.limit, self.known, self.rows = limit, {}, np.empty((limit, DIMENSIONS), dtype=np.int8)

    def vector(self, code: int) -> np.ndarray:
        out = np.ones(DIMENSIONS, dtype=np.int8)
        for place in range(GRAM):
            out = out * np.roll(letter_vector(code & 0x1FFFFF), place)
            code >>= 21
        return out

    def of(self, codes: np.ndarray) -> np.ndarray:
        """A row for each code."""
        if len(self.known) + len(codes) > self.limit:
            self.known = {}
        for c in codes.tolist():
            if c not in self.known:
                self.rows[len(self.known)] = self.vector(c)
                self.known[c] = len(self.known)
        return self.rows[[self.known[c] for c in codes.tolist()]].astype(np.float32)


@cache
def grams() -> Grams:
    return Grams()


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct letter n-grams of a text and how often each occurs."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    codes = folded_codes()[points].astype(np.int64)
    codes = np.concatenate([[0], codes, [0]])
    codes = codes[(codes != 0) | np.concatenate([[True], codes[:-1] != 0])]
    if len(codes) < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    packed = np.zeros(len(codes) - GRAM + 1, dtype=np.int64)
    for place in range(GRAM):
        packed |= codes[place : place + len(packed)] << (21 * place)
    return np.unique(packed, return_counts=True)


def text_vectors(texts: list[str]) -> np.ndarray:
    """Bundled unit vectors, a row per text; a text without letters has the zero row."""
    out = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
    counted = [gram_counts(t) for t in texts]
    for at in range(0, len(texts), 64):
        own = counted[at : at + 64]
        codes = np.unique(np.concatenate([c for c, _ in own])) if own else np.zeros(0, np.int64)
        for low in range(0, len(codes), PART):
            part = codes[low : low + PART]
            weights = np.zeros((len(own), len(part)), dtype=np.float32)
            for row, (c, n) in enumerate(own):
                inside = slice(*np.searchsorted(c, [part[0], part[-1] + 1]))
                weights[row, np.searchsorted(part, c[inside])] = n[inside]
            out[at : at + len(own)] += weights @ grams().of(part)
    norm = np.sqrt((out.astype(np.float64) ** 2).sum(axis=1))
    return (out / np.where(norm > 0, norm, 1)[:, None]).astype(np.float32)


def fit(docs: DataFrame, labelled: Column, rows: int = FIT_ROWS) -> dict[str, np.ndarray]:
    """Prototype of each language from about ``rows`` rows of docs (doc_id, text, lang) that meet ``labelled``."""
    usable = docs.where(labelled & F.col("lang").isNotNull() & F.col("text").isNotNull())
    total = usable.select("doc_id").count()
    if total > rows:
        usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * rows / total) + 1)

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist())
            vectors = text_vectors(texts_of(batch.column(0)))
            for lang in np.unique(langs):
                sums[lang] = sums.get(lang, 0) + vectors[langs == lang].sum(axis=0, dtype=np.float64)
        grams.cache_clear()  # workers outlive the stage
        yield pa.record_batch([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "v"])

    sums = usable.select("text", "lang").mapInArrow(bundle, "lang string, v array<double>")
    places = sums.select("lang", F.posexplode("v").alias("place", "x")).groupBy("lang", "place").agg(F.sum("x").alias("x"))
    found: dict[str, np.ndarray] = {}
    for r in places.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "x"))).alias("v")).collect():
        v = np.array([x.x for x in r.v])
        found[r.lang] = v / (np.sqrt((v**2).sum()) or 1.0)
    return found


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], row: str | None = None) -> DataFrame:
    """The rows of ``docs`` with lang_pred and score.  The text is column ``text``, or that field of the struct column ``row``."""
    names = sorted(prototypes)
    held = np.array([prototypes[n] for n in names], dtype=np.float32).reshape(len(names), DIMENSIONS)
    shared = held.mean(axis=0) if len(names) > 1 else np.zeros(DIMENSIONS, dtype=np.float32)
    apart = held - shared
    apart = apart / np.maximum(np.sqrt((apart**2).sum(axis=1)), 1e-12)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                column = batch.column(batch.schema.get_field_index(row or "text"))
                vectors = text_vectors(texts_of(pc.struct_field(column, "text") if row else column))
                if names:
                    best = (vectors @ apart.T).argmax(axis=1)
                    score = np.clip((vectors * held[best]).sum(axis=1, dtype=np.float64), 0, 1)
                else:
                    best, score = np.zeros(len(vectors), int), np.zeros(len(vectors))
                empty = ~vectors.any(axis=1) if names else np.ones(len(vectors), bool)
                pred = [UNKNOWN if e else names[b] for e, b in zip(empty, best)]
                out = batch.append_column("lang_pred", pa.array(pred, pa.string()))
                yield out.append_column("score", pa.array(np.where(empty, 0.0, score), pa.float64()))
        grams.cache_clear()  # workers outlive the stage

    kept = docs.drop("lang_pred", "score")
    schema = StructType([*kept.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return kept.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def identified(docs: DataFrame) -> DataFrame:
    """Learn from the labelled rows that are not held out and predict all rows."""
    part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    prototypes = fit(part, ~held_out())
    return predict(part.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text"), prototypes).drop("text")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents."""
    return identified(table(spark, sf_dir, "documents"))
