"""Mixing sources to target weights against a direct loop."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from feedloom.llm import mixing

DOCS = "doc_id long, text string, source string, _part long, key string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def reshared(sizes, weights, share, epochs):
    """Targets by resharing what is over the cap until nothing is."""
    target = dict.fromkeys(sizes, 0.0)
    open_, left = set(sizes), share * sum(sizes.values())
    while open_ and left > 1e-9:
        total = sum(weights[s] for s in open_)
        for s in open_:
            target[s] += left * weights[s] / total
        left = sum(max(0.0, target[s] - epochs * sizes[s]) for s in open_)
        full = {s for s in open_ if target[s] >= epochs * sizes[s]}
        target.update({s: float(epochs * sizes[s]) for s in full})
        open_ -= full
    return target


def direct(docs, cycle=(3, 1, 2), share=1.5, epochs=2):
    size = [len(WORDS.findall(d[1] or "")) for d in docs]
    names = sorted({d[2] for d in docs}, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: cycle[k % len(cycle)] for k, s in enumerate(names)}
    sizes = {s: sum(n for n, d in zip(size, docs) if d[2] == s) for s in names}
    target = reshared(sizes, weights, share, epochs)
    out = []
    for s in names:
        budget, total = int(target[s] + 1e-6), sizes[s]
        key = lambda k: (hashlib.md5(f"mix:{'null' if docs[k][0] is None else docs[k][0]}".encode()).hexdigest(), docs[k][0] is not None, docs[k][0] or 0, size[k])
        whole = budget // total if total else 0
        rest = budget - whole * total
        for k in sorted((k for k in range(len(docs)) if docs[k][2] == s), key=key):
            first = min(size[k], rest)
            rest -= first
            out.append((docs[k][0], size[k], total, round(target[s], 5), whole * size[k] + first))
    return sorted(out, key=str)


def table_of(spark, docs):
    return spark.createDataFrame([(*d, 7, "x") for d in docs], DOCS)


def got(df):
    return sorted(((r.doc_id, r.size, r.source_size, round(r.target, 5), r.taken) for r in df.collect()), key=str)


def some(n, seed):
    rng = random.Random(seed)
    names = ["hot", "hot", "hot", "a", "b", "é", "Z", "", None, "tiny"]
    return [(k, " ".join(["wörd x"] * rng.randrange(40)), rng.choice(names)) for k in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_loop(spark, seed):
    docs = [*some(300, seed), (300, "one", "tiny2"), (301, None, "none"), (302, "", "none")]
    assert got(mixing.mix(table_of(spark, docs), (3, 1, 2))) == direct(docs)


def test_budgets_are_met_and_reruns_agree(spark):
    docs = table_of(spark, some(400, 5))
    first, again = mixing.mix(docs, (3, 1, 2)).collect(), mixing.mix(docs.repartition(5), (3, 1, 2)).collect()
    assert sorted(map(str, first)) == sorted(map(str, again))
    taken = {}
    for r in first:
        assert 0 <= r.taken <= 2 * r.size
        taken.setdefault((r.source, r.target), []).append(r.taken)
    assert all(sum(t) == int(target + 1e-6) for (_, target), t in taken.items())


@pytest.mark.parametrize("docs", [[], [(None, None, None)], [(1, "a b", "s")] * 3, [(None, "a b c", "s"), (None, "a", "s"), (2, "b " * 30000, None)]])
def test_odd_rows(spark, docs):
    assert got(mixing.mix(table_of(spark, docs), (3, 1, 2))) == direct(docs)


def test_given_weights_and_texts(spark):
    docs = table_of(spark, [(k, f" a{k}  b\tc\nd ", "p" if k % 2 else None) for k in range(20)])
    weights = spark.createDataFrame([("p", 5), (None, 1)], "source string, weight int")
    mixed = mixing.mix(docs, weights, share=1.1, epochs=3).cache()
    texts = mixing.mixed_texts(docs, mixed)
    words = dict(texts.groupBy("doc_id").agg(F.sum(mixing.size_of(F.col("text")))).collect())
    assert words == {r.doc_id: r.taken for r in mixed.collect() if r.taken}
    assert {r.text for r in texts.collect() if r.doc_id == 3} <= {" a3  b\tc\nd ", " a3", " a3  b", " a3  b\tc", " a3  b\tc\nd"}
    assert [r.row.key for r in texts.limit(1).collect()] == ["x"]
