"""Secret scan: fixed patterns and a battery of randomness tests.

Patterns (``assign``, ``access``, ``hex``) give the base spans.  The battery adds ``random`` spans: every
run of at least ``SHORTEST`` characters of base64 or url-safe base64 that holds a letter and a digit gets
an inferred encoding (hex, base32, lower-case letters and digits, letters and digits, base64) and three
tests of H0 "symbols drawn at random": chi-squared uniformity over the alphabet, runs above and below
its middle, and serial correlation.  Fisher's method combines them; a run that is random keeps H0.

A run that mixes ``+`` or ``/`` with ``-`` or ``_`` (a path with a token) fits no alphabet; its longest parts without the
one and without the other pair are tested instead, each of ``SHORTEST`` characters at least.  Parts that
overlap and are both random give one span.

That alone would flag short words, so each run is also tested against H1 "ordinary text", the share
of each symbol in the whole corpus, by a chi-squared test whose power grows with length.  The false
discovery rate over all runs of the corpus is held at ``RATE`` by the Benjamini-Hochberg rule, apart in
each length stratum, so that many short runs don't pay for few long ones or the reverse.  The rule needs
only a histogram of p-values per stratum, which has a fixed size.

A random span that overlaps a base span is left out.  Null texts count as empty texts; repeated rows
get the same spans (and count as often in the corpus); an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.arrays import bound, running
from feedloom.llm.common import longs, table, texts_of, written

ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
HINTS = ("passw", "secret", "token", "api_key", "apikey")
KINDS = ("assign", "access", "hex", "random")
SHORTEST = 16
RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
PARTS = re.compile(r"[A-Za-z0-9+/]{16,}={0,2}"), re.compile(r"[A-Za-z0-9_-]{16,}={0,2}")
STRATA = (24, 32, 48, 64)
RATE, ALPHA = 0.01, 1e-3
PER_DECADE, BINS = 4, 1280
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("hex", DIGITS + "abcdef"),
    ("hex", DIGITS + "ABCDEF"),
    ("base32", UPPER + "234567"),
    ("lower", DIGITS + LOWER),
    ("alnum", DIGITS + UPPER + LOWER),
    ("base64", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", UPPER + LOWER + DIGITS + "-_"),
)
_TABLES = [(name, letters, frozenset(letters), {c: k for k, c in enumerate(letters)}) for name, letters in ENCODINGS]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns."""
    out = []
    if len(text) >= 6:
        low = text.lower()
        if any(h in low for h in HINTS):
            out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
        if "AKIA" in text:
            out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def upper_tail(x: float, df: int) -> float:
    """log10 of the chi-squared tail (Wilson and Hilferty's normal form, with the normal tail's own asymptote)."""
    if x <= 0:
        return 0.0
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    if z < 30:
        return math.log10(max(0.5 * math.erfc(z / math.sqrt(2)), 1e-320))
    return (-z * z / 2 - math.log(z * math.sqrt(2 * math.pi))) / math.log(10)


def two_sided(z: float) -> float:
    return max(math.erfc(abs(z) / math.sqrt(2)), 1e-300)


def encoding_of(run: str):
    """The smallest alphabet that holds all symbols, with the run less its padding."""
    body = run.rstrip("=")
    letters = set(body)
    for name, alphabet, members, number in _TABLES:
        if letters <= members:
            return name, alphabet, body, [number[c] for c in body]
    return None


def parts_of(run: str) -> list[tuple[int, int]]:
    """(start, end) of what is tested of a run: the whole if it fits an alphabet, else its longest base64 and url-safe parts."""
    if encoding_of(run):
        return [(0, len(run))]
    return list(dict.fromkeys(m.span() for part in PARTS for m in part.finditer(run)))


def grouped(alphabet: int, n: int) -> tuple[int, np.ndarray]:
    """Number of groups that leaves about five symbols of n in each, and the group of every symbol."""
    groups = max(2, min(alphabet, n // 5))
    return groups, np.arange(alphabet) * groups // alphabet


def battery(symbols: list[int], alphabet: int) -> float:
    """Combined p-value of uniformity, runs and serial correlation under randomness."""
    x = np.array(symbols, dtype=float)
    n = len(x)
    groups, of = grouped(alphabet, n)
    seen = np.bincount(of[np.array(symbols)], minlength=groups)
    want = np.bincount(of, minlength=groups) * n / alphabet
    uniform = 10 ** upper_tail(float(((seen - want) ** 2 / want).sum()), groups - 1)
    above = x > (alphabet - 1) / 2
    n1 = int(above.sum())
    n0 = n - n1
    if n0 and n1:
        mean = 2 * n0 * n1 / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs = two_sided((1 + int((above[1:] != above[:-1]).sum()) - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        runs = 2.0 ** (1 - n)
    spread = x - x.mean()
    power = float((spread**2).sum())
    serial = two_sided((float((spread[1:] * spread[:-1]).sum()) / power + 1 / n) * math.sqrt(n)) if power else 1e-300
    fisher = -2 * sum(math.log(max(p, 1e-300)) for p in (uniform, runs, serial))
    return 10 ** upper_tail(fisher, 6)


def against_text(symbols: list[int], shares: np.ndarray) -> float:
    """-log10 p of the symbols under the corpus' own shares."""
    n = len(symbols)
    groups, of = grouped(len(shares), n)
    seen = np.bincount(of[np.array(symbols)], minlength=groups)
    want = np.maximum(np.bincount(of, weights=shares, minlength=groups) * n, 1e-3)
    return -upper_tail(float(((seen - want) ** 2 / want).sum()), groups - 1)


def stratum(n: int) -> int:
    return sum(n >= s for s in STRATA)


def corpus_symbols(docs: DataFrame) -> np.ndarray:
    """How often each ASCII character occurs in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, dtype=np.int64)
        for batch in batches:
            for text in texts_of(batch.column(0)):
                raw = text.encode()
                for at in range(0, len(raw), 1 << 22):
                    total += np.bincount(np.frombuffer(raw[at : at + (1 << 22)], dtype=np.uint8), minlength=256)
        yield pa.record_batch([longs(np.arange(256)), longs(total)], ["code", "n"])

    rows = docs.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    out = np.ones(256)
    for r in rows:
        out[r.code] += r.n
    return out[:128]


def thresholds(counts: dict[tuple[int, int], int], rate: float = RATE) -> list[int]:
    """Benjamini-Hochberg per stratum: the least bin of -log10 p that counts as a discovery."""
    out = []
    for s in range(len(STRATA) + 1):
        own = {b: n for (k, b), n in counts.items() if k == s}
        total, above, least = sum(own.values()), 0, BINS + 1
        for b in sorted(own, reverse=True):
            above += own[b]
            if 10 ** (-b / PER_DECADE) * total <= rate * above:
                least = b
        out.append(least)
    return out


def apart(runs: Column) -> Column:
    """(start, end) of runs; those that overlap, parts of one mixed run, as one."""
    state = lambda opens, start, end: F.struct(opens.alias("opens"), start.alias("start"), end.alias("end"))

    def step(last: Column, r: Column) -> Column:
        wider = state(F.lit(False), last["start"], F.greatest(last["end"], r["end"]))
        return F.when(r["start"] < last["end"], wider).otherwise(state(F.lit(True), r["start"], r["end"]))

    nothing = state(F.lit(False), F.lit(0).cast("long"), F.lit(0).cast("long"))
    ended = lambda all_: F.filter(all_, lambda x, i: F.coalesce(F.get(all_, i + 1)["opens"], F.lit(True)))
    done = bound(running(F.array_sort(runs), nothing, step), ended)
    return F.transform(done, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_random of docs (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    symbols = corpus_symbols(docs)
    shares = {alphabet: (w := symbols[[ord(c) for c in alphabet]]) / w.sum() for _, alphabet in ENCODINGS}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, found = [], []
            for text in texts_of(batch.column(1)):
                spans = base_spans(text)
                own = []
                for start, part in ((m.start() + a, m[0][a:e]) for m in RUN.finditer(text) for a, e in parts_of(m[0])):
                    if any(c.isdigit() for c in part) and any(c.isalpha() for c in part) and (kind := encoding_of(part)):
                        end = start + len(part)
                        p = min(BINS, int(against_text(kind[3], shares[kind[1]]) * PER_DECADE))
                        free = all(e <= start or s >= end for s, _, e in spans)
                        random = free and battery(kind[3], len(kind[1])) > ALPHA
                        own.append({"start": start, "end": end, "stratum": stratum(len(kind[2])), "bin": p, "random": random})
                base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
                found.append(own)
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array(base, pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int64()), ("end", pa.int64())]))),
                    pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("stratum", pa.int64()), ("bin", pa.int64()), ("random", pa.bool_())]))),
                ],
                ["doc_id", "base", "runs"],
            )

    schema = "doc_id long, base array<struct<start:long,kind:long,end:long>>, runs array<struct<start:long,end:long,stratum:long,bin:long,random:boolean>>"
    rows = written(docs.mapInArrow(run, schema), "secrets")
    tested = rows.select(F.explode("runs").alias("r")).groupBy("r.stratum", "r.bin").agg(F.count("*").alias("n")).collect()
    least = F.array(*[F.lit(x) for x in thresholds({(r["stratum"], r["bin"]): r["n"] for r in tested})])
    kinds = F.array(*[F.lit(k) for k in KINDS])
    chosen = F.filter("runs", lambda r: r["random"] & (r["bin"] >= F.get(least, r["stratum"].cast("int"))))
    chosen = apart(chosen)
    extra = F.transform(chosen, lambda r: F.struct(r["start"].alias("start"), F.lit(3).cast("long").alias("kind"), r["end"].alias("end")))
    said = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"].cast("int")), s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return rows.select(
        "doc_id",
        number(0).alias("n_assign"),
        number(1).alias("n_access"),
        number(2).alias("n_hex"),
        F.sha2(said(F.col("base")), 256).alias("base_sha256"),
        said(F.array_sort(F.concat("base", extra))).alias("spans"),
        F.size(chosen).cast("long").alias("n_random"),
    )


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return scan(table(spark, sf_dir, "documents"))
