"""The prefix trie against a direct walk."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from feedloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth long, _x long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def turn_key(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def rebuilt(rows):
    """Ordered and rebuilt conversations."""
    own = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), turn_key(r[2] or "", r[3] or ""))):
        if c is not None:
            own.setdefault(c, []).append((role or "", text or ""))
    out = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, int(c - (abs(c) % 20) * (1 if c >= 0 else -1))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def direct(convs):
    """Nodes by a recursive walk over all prefixes."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = children.get(path, [])
        words = len(WORDS.findall(path[-1][1])) if path else 0
        leaves[path] = sum(leaves[x] for x in below) if below else 1
        saved[path] = (len(members[path]) - 1) * words + sum(saved[x] for x in below)
    return sorted(
        (
            min(m), len(path), -99 if not path else min(members[path[:-1]]), len(m), len(children.get(path, [])), leaves[path], saved[path],
            hashlib.sha256(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(path)).encode()).hexdigest(),
        )
        for path, m in members.items()
    )


def nodes(df):
    return sorted((r.conv_id, r.depth, -99 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, "n", 5, 6) for r in rows], SCHEMA)


def trie_of(spark, rows, rebuild=True):
    turns = prefix_trie.keyed_turns(frame(spark, rows))
    members = turns.select("conv_id").distinct()
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(turns, members) if rebuild else turns, members)


def some(n, seed):
    rng = random.Random(seed)
    return [
        (rng.choice([c, c, -c]), rng.choice([k, k, k, None]), rng.choice(["user", "assistant", None, ""]), rng.choice(["a b", "c", "", None, "é  f\ng"]))
        for c in range(n) for k in range(rng.randrange(7))
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_walk(spark, seed):
    rows = [*some(60, seed), (None, 1, "user", "lost")]
    assert nodes(trie_of(spark, rows)) == direct(rebuilt(rows))


def test_turnless_and_tables_without_rows(spark):
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    assert nodes(trie_of(spark, [(c, 0, "user", "only")])) == [(c, 0, -99, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    assert trie_of(spark, []).count() == 0


def test_same_words_in_other_turns_are_other_nodes(spark):
    rows = [(20, 0, "user", "a"), (20, 1, "user", "b"), (40, 0, "user", "ab"), (60, 0, "usera", ""), (80, 0, "user", "b"), (80, 1, "user", "a"), (100, 0, "user", "long " * 50000)]
    assert nodes(trie_of(spark, rows)) == direct(rebuilt(rows))


def comb(depth, seed):
    """Conversations that each leave the longest one somewhere, so that chains change their deepest member again and again."""
    rng = random.Random(seed)
    spine = [("user", f"w{k}") for k in range(depth)]
    convs = {20 * k + 20: [*spine[: rng.randrange(depth)], *[("user", f"x{k} {j}") for j in range(rng.randrange(depth))]] for k in range(40)}
    convs[0] = spine
    return convs


@pytest.mark.parametrize("kind", ["comb", "nested", "copies"])
def test_long_and_odd_shapes(spark, kind):
    if kind == "comb":
        convs = comb(60, 3)
    elif kind == "nested":  # each conversation is a prefix of the next one
        convs = {20 * k: [("user", "t")] * (k + 1) for k in range(70)}
    else:
        convs = {20 * k: [("user", "a"), ("assistant", "b b")] for k in range(9000)}
    rows = [(c, k, *t) for c, turns in convs.items() for k, t in enumerate(turns)]
    convs = {c: turns for c, turns in convs.items() if turns}
    assert nodes(trie_of(spark, rows, rebuild=False)) == direct(convs)


def test_one_long_conversation_over_buckets(spark):
    n = 3000
    rows = [(0, k, "user", f"t{k % 7} x") for k in range(n)] + [(20, k, "user", f"t{k % 7} x") for k in range(n - 500)]
    got = trie_of(spark, rows, rebuild=False).orderBy("depth").collect()
    assert [r.n_convs for r in got] == [2] * (n - 499) + [1] * 500
    assert [r.saved_tokens for r in got] == [2 * (n - 500)] + [2 * (n - 500 - d + 1) for d in range(1, n - 499)] + [0] * 500
    assert {r.n_leaves for r in got} == {1}


def test_contraction_rounds_grow_with_the_logarithm(spark, monkeypatch):
    rounds = []
    real = prefix_trie.written
    monkeypatch.setattr(prefix_trie, "written", lambda df, purpose: (rounds.append(purpose), real(df, purpose))[1])
    n = 5000
    chain = spark.range(n).select(
        F.sha2(F.col("id").cast("string"), 256).alias("node"),
        F.when(F.col("id") > 0, F.sha2((F.col("id") - 1).cast("string"), 256)).alias("parent"),
        F.col("id").alias("depth"), F.lit(1).alias("spine"), (F.col("id") < n - 1).cast("long").alias("n_children"), F.lit(1).alias("v"),
    )
    got = prefix_trie.subtree_totals(chain, ["v"]).join(chain, "node").select("depth", "t_v").collect()
    assert {r.depth: r.t_v for r in got} == {k: n - k for k in range(n)}
    assert rounds.count("chains") <= 8


def test_chains_over_many_spines_shrink(spark):
    """Every node has a spine of its own."""
    n = 40
    chain = spark.range(n).select(
        F.col("id").cast("string").alias("node"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent"),
        F.col("id").alias("depth"), F.col("id").alias("spine"), (F.col("id") < n - 1).cast("long").alias("n_children"), (F.col("id") * F.col("id")).alias("v"),
    )
    got = prefix_trie.subtree_totals(chain, ["v"]).collect()
    assert {int(r.node): r.t_v for r in got} == {k: sum(j * j for j in range(k, n)) for k in range(n)}
