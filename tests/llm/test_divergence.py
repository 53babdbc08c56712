"""The source divergence audit against a direct count."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from feedloom.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "text string, lang string, source string, term string, block long, p long, copy int"


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def direct(docs, support=10, top=10):
    docs = [(terms(t), lang or "", source or "") for t, lang, source in docs]
    out = []
    for lang in {d[1] for d in docs}:
        own = [d for d in docs if d[1] == lang]
        held = Counter(t for d in own for t in set(d[0]))
        kept = sorted((t for t, n in held.items() if n >= support), key=str.encode)
        counts = {s: Counter() for s in {d[2] for d in own}}
        for ts, _, s in own:
            counts[s].update(t for t in ts if held[t] >= support)
        every = sum(counts.values(), Counter())
        share = lambda c: [1 + 1000000000 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept]
        q = share(every)
        for s, c in counts.items():
            p = share(c)
            pairs = [(o, sum((x - y) ** 2 // (x + y) for x, y in zip(p, share(counts[o])))) for o in counts if o != s]
            above = [(t, (x - y) ** 2 // (x + y)) for t, x, y in zip(kept, p, q) if c[t] and x > y]
            for part, found in (("pair", pairs), ("term", above)):
                ranked = sorted(found, key=lambda r: (-r[1], r[0].encode()))[: None if part == "pair" else top]
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def frame(spark, docs):
    return spark.createDataFrame([(*d, "t", 1, 2, 3) for d in docs], SCHEMA)


def audited(spark, docs, **options):
    return sorted(tuple(r) for r in divergence.audit(frame(spark, docs), **options).collect())


def some(n, seed):
    rng = random.Random(seed)
    words = ["a", "The", "ab", "abcd", "abcde", "abcdefgh", "abcdefghi", "ÄÖ", "日本語日本語日本語", "x1y", "it's", "q" * 40, "q" * 39 + "r", *[f"w{'z' * k}v" for k in range(12)]]
    return [
        (None if k % 29 == 0 else " ".join(rng.choice(words[: rng.randrange(1, len(words))]) for _ in range(rng.randrange(25))), rng.choice(["en", "en", "de", None, ""]), rng.choice(["s0", "s0", "s1", "é", "Z", None]))
        for k in range(n)
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_direct_count(spark, seed):
    docs = some(250, seed)
    assert audited(spark, docs) == direct(docs)


def test_blocks_sources_and_terms_in_parts(spark, monkeypatch):
    for name, value in (("BLOCK_BYTES", 300), ("TERMS", 5), ("SOURCES", 2), ("OUT", 7)):
        monkeypatch.setattr(divergence, name, value)
    docs = some(200, 4)
    assert audited(spark, docs, support=4, top=3) == direct(docs, 4, 3)


@pytest.mark.parametrize("docs", [[], [(None, None, None)], [("", "en", "a"), ("1 2", "en", "b"), ("x", "de", "c")], [("same words Same", "en", "a")] * 9 + [("same", "en", "b"), ("same", "de", "b")], [("tie eit " * 30000, "en", s) for s in "abcdefghijkl"]])
def test_odd_rows(spark, docs):
    assert audited(spark, docs) == direct(docs)


def test_prefixes_of_rare_terms_go_level_by_level(spark, monkeypatch):
    """Terms that share a prefix only within few documents do not make the prefix frequent."""
    seen = []
    real = divergence.written
    monkeypatch.setattr(divergence, "written", lambda df, purpose: (seen.append(purpose), real(df, purpose))[1])
    rare = [(" ".join(f"prefix{chr(97 + k)}{chr(97 + j)}suffixsuffix" for j in range(20)), "en", "a") for k in range(9)]
    docs = [*rare, *[("common commonlong", "en", "a")] * 12]
    got = divergence.kept_terms(frame(spark, docs))
    assert sorted((bytes(r.term), r.n) for r in got.collect()) == [(b"common", 12), (b"commonlong", 12)]
    assert seen.count("term-documents") == 3  # the sums, 6 and 12 bytes; nothing is left for 24
    assert audited(spark, docs) == direct(docs)


def test_documents_of_prefixes():
    terms = [b"a", b"abcdef", b"abcdefg", b"abcdefh" + b"x" * 20, b"b" * 13]
    pairs = [(0, 0), (1, 0), (1, 1), (2, 1), (3, 1), (3, 2), (4, 2)]
    flat, at = divergence.documents_of_prefixes(terms, *(np.array(x) for x in zip(*pairs)), 3)
    assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == [[1], [2], [2, 1], [0, 2, 2, 2], [1, 1, 1]]
