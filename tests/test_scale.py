"""Distributed building blocks against direct computation, and plan shapes."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from feedloom.operators import graph, ledger, measure, ratelimit, similarity
from feedloom.plans import catalog
from feedloom.scale import latest_by_key, prefix_lag, prefix_sums, previous_value, running_total, top_k


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", i, rng.randrange(9)) for i in range(3000)]
    return spark.createDataFrame(data, "k string, pos long, v long")


def test_running_total(rows):
    got = running_total(rows, ["k"], F.floor(F.col("pos") / 64), ["pos"], {"total": F.col("v")})
    want = rows.withColumn("total", F.sum("v").over(Window.partitionBy("k").orderBy("pos")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_previous_value(rows):
    got = previous_value(rows, ["k"], F.floor(F.col("pos") / 64), ["pos"], "v", "prev")
    want = rows.withColumn("prev", F.lag("v").over(Window.partitionBy("k").orderBy("pos")))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_latest_and_top_k(rows):
    got = {r["k"]: r["pos"] for r in latest_by_key(rows, ["k"], [F.col("pos")]).collect()}
    want = {r["k"]: r["m"] for r in rows.groupBy("k").agg(F.max("pos").alias("m")).collect()}
    assert got == want
    plan = top_k(rows, ["k"], [F.desc("pos")], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # once before the shuffle, once after


@pytest.mark.parametrize("seed,spacing,bucket", [(1, 3, 20), (2, 1, 10), (3, 15, 50), (4, 40, 30)])
def test_rate_limit_matches_a_direct_loop(spark, seed, spacing, bucket):
    rng = random.Random(seed)
    events, t = [], 0
    for i in range(600):
        t += rng.randrange(spacing + 1)
        events.append(("hot" if rng.random() < 0.7 else "cold", t, i))
    last, want = {}, {}
    for key, at, i in events:
        ok = key not in last or at - last[key] >= 10
        if ok:
            last[key] = at
        want[i] = ok
    df = spark.createDataFrame(events, "k string, t long, id long")
    got = {r["id"]: r["allowed"] for r in ratelimit.rate_limited(df, "k", "t", "id", 10, bucket).collect()}
    assert got == want


def test_rate_limit_boundaries(spark):
    df = spark.createDataFrame([("a", t, i) for i, t in enumerate([0, 5, 10, 14, 20])], "k string, t long, id long")
    got = [r["allowed"] for r in ratelimit.rate_limited(df, "k", "t", "id", 10, 10).orderBy("id").collect()]
    assert got == [True, False, True, False, True]


@pytest.mark.parametrize("threshold", [0.3, 0.55, 0.75, 0.8, 1.0])
def test_similar_pairs_match_all_pairs(spark, threshold):
    rng = random.Random(int(threshold * 100))
    words = [f"w{i}" for i in range(14)]
    sets = [(i, sorted(rng.sample(words, rng.randrange(1, 9)))) for i in range(120)]
    sets += [(200 + i, sets[0][1]) for i in range(5)]
    got = {(r["a"], r["b"]): round(r["score"], 6) for r in similarity.similar_pairs(spark.createDataFrame(sets, "id long, tokens array<string>"), threshold).collect()}
    rep = {}
    for i, t in sets:
        rep.setdefault(tuple(t), i)
    reps = {i: set(t) for t, i in rep.items()}
    want = {}
    for a in reps:
        for b in reps:
            j = len(reps[a] & reps[b]) / len(reps[a] | reps[b])
            if a < b and j >= threshold:
                want[(a, b)] = round(j, 6)
    for i, t in sets:
        if rep[tuple(t)] != i:
            want[(rep[tuple(t)], i)] = 1.0
    assert got == want


def test_greedy_survivors_match_a_direct_loop(spark):
    rng = random.Random(9)
    ids = list(range(150))
    rank = {i: r for r, i in enumerate(rng.sample(ids, len(ids)))}
    edges = {tuple(sorted(rng.sample(ids, 2))) for _ in range(300)}
    near = {i: set() for i in ids}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    kept, want = [], {}
    for i in sorted(ids, key=rank.get):
        hit = next((k for k in kept if k in near[i]), None)
        want[i] = i if hit is None else hit
        if hit is None:
            kept.append(i)
    ranked = spark.createDataFrame([(i, rank[i]) for i in ids], "id long, rank long")
    got = similarity.greedy_survivors(ranked, spark.createDataFrame(list(edges), "a long, b long"))
    assert {r["id"]: r["survivor"] for r in got.collect()} == want


def test_components_and_labels_match_direct_loops(spark):
    rng = random.Random(4)
    ids = [f"n{i:03d}" for i in range(120)]
    pairs = [tuple(rng.sample(ids, 2)) for _ in range(70)] + [(ids[i], ids[i + 1]) for i in range(40, 80)]
    nodes = spark.createDataFrame([(i,) for i in ids], "id string")
    edges = spark.createDataFrame(pairs, "source string, target string")
    near = {i: set() for i in ids}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for start in ids:
        if start in want:
            continue
        todo, seen = [start], {start}
        while todo:
            for n in near[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        want.update({n: min(seen) for n in seen})
    assert {r["id"]: r["component"] for r in graph.components(nodes, edges).collect()} == want

    label = {r["id"]: r["community"] for r in graph.communities(nodes, edges).collect()}
    assert settled(label, near)


def settled(label, near):
    """Every node's label is as frequent among its neighbours as any, and named by its lowest member."""
    for i, around in near.items():
        votes = [label[n] for n in around]
        if votes and votes.count(label[i]) < max(map(votes.count, votes)):
            return False
    members = {}
    for i, c in label.items():
        members.setdefault(c, []).append(i)
    return all(c == min(own) for c, own in members.items())


def test_communities_settle_on_stars_two_sided_graphs_and_cliques(spark):
    star = [("hub", f"leaf{k}") for k in range(8)]
    sides = [(f"left{i}", f"right{j}") for i in range(4) for j in range(4)]
    cliques = [(f"{c}{i}", f"{c}{j}") for c in "pq" for i in range(5) for j in range(i)] + [("p0", "q0")]
    pairs = star + sides + cliques
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    nodes = spark.createDataFrame([(i,) for i in [*near, "alone"]], "id string")
    label = {r["id"]: r["community"] for r in graph.communities(nodes, spark.createDataFrame(pairs, "source string, target string")).collect()}
    assert label["alone"] == "alone"
    assert settled(label, near)
    assert {label[f"p{i}"] for i in range(5)} == {"p0"}
    assert {label[f"q{i}"] for i in range(5)} == {"q0"}
    assert {label[f"leaf{k}"] for k in range(8)} == {"hub"}


def test_merges_are_resolved_along_chains(spark):
    chain = [(f"l{k:02d}", f"l{k + 1:02d}", 0.9, 50 - k) for k in range(20)]
    rows = [*chain, ("l05", "x", 0.5, 45), ("y", "x", 0.7, 60), ("z", "x", 0.7, 40)]
    got = ledger.resolve_merges(spark.createDataFrame(rows, "survivor string, loser string, score double, survivor_n int"))
    want = {f"l{k:02d}": "l00" for k in range(1, 21)} | {"x": "y"}
    assert {r["loser"]: r["survivor"] for r in got.collect()} == want
    lessons = spark.createDataFrame([("a", 5, "r"), ("b", 2, "s"), ("c", 1, "t")], "pattern string, occurrence_count long, rule string")
    twice = spark.createDataFrame([("a", "c"), ("b", "c")], "survivor string, loser string")
    assert {(r["pattern"], r["occurrence_count"]) for r in ledger.apply_merges(lessons, twice).collect()} == {("a", 6), ("b", 2)}


def test_shortest_path(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d"), ("d", "c"), ("c", "e"), ("x", "y")], "source string, target string")
    got = [r["id"] for r in graph.shortest_path(edges, "a", "e").orderBy("hop").collect()]
    assert got == ["a", "b", "c", "e"]
    assert graph.shortest_path(edges, "a", "x").count() == 0
    assert [r["id"] for r in graph.shortest_path(edges, "a", "a").collect()] == ["a"]


def test_shortest_path_has_no_hop_limit(spark):
    chain = spark.createDataFrame([(f"n{k:03d}", f"n{k + 1:03d}") for k in range(60)], "source string, target string")
    got = [(r["hop"], r["id"]) for r in graph.shortest_path(chain, "n000", "n057").orderBy("hop").collect()]
    assert got == [(k, f"n{k:03d}") for k in range(58)]
    nodes = chain.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    assert {r["component"] for r in graph.components(nodes, chain).collect()} == {"n000"}


@pytest.mark.parametrize("patterns", [40, 9])
def test_deduped_bullets_match_a_direct_loop(spark, patterns):
    from feedloom.fixed_values import STOPWORDS_PLAYBOOK
    from feedloom.operators import playbook
    import re

    rng = random.Random(3)
    words = ["alpha", "bravo", "delta", "gamma", "omega", "sigma", "theta", "kappa", "lambda"]
    rows = []
    for i in range(40):
        family = rng.choice(["tone", "stateless", "abc"])
        family = family if patterns == 40 else ["tone", "stateless", "abc"][i % patterns % 3]
        rows.append((f"{family}_{i % patterns:02d}", " ".join(rng.sample(words, rng.randrange(3, 8))), rng.randrange(5), rng.randrange(5), rng.randrange(3), rng.randrange(9), "flat" if i % 4 == 0 else "working", i % 13 == 0))
    schema = "pattern string, description string, quality int, helpful long, harmful long, priority int, verdict string, seed boolean"
    toks = lambda d: {w for w in re.findall("[a-z]{4,}", d) if w not in STOPWORDS_PLAYBOOK}
    signal = lambda r: r[2] * 10 + r[3] + r[4] + r[5] + (50 if r[7] else 0) + (20 if r[6] == "flat" else 0)
    # Of one pattern, a bullet that is no seed gives way to the first; a better one hands over its fields.
    order = sorted(rows, key=lambda r: (-signal(r), r[0], r[1]))
    single = []
    for r in order:
        held = next((x for x in single if x["row"][0] == r[0]), None)
        if held is None or r[7]:
            single.append({"row": r, "gone": 0})
            continue
        held["gone"] += 1
        if r[2] > held["row"][2] and not held["row"][7]:
            held["row"] = r
    kept = []
    for r, gone in ((x["row"], x["gone"]) for x in single):
        for k in kept:
            fa, fb = r[0].split("_")[0], k["row"][0].split("_")[0]
            bar = 0.55 if fa == fb and len(fa) >= 4 and r[0] != k["row"][0] else 0.65
            a, b = toks(r[1]), toks(k["row"][1])
            if len(a & b) / len(a | b) >= bar - 1e-12:
                k["helpful"] += r[3]
                k["harmful"] += r[4]
                k["merged"] += 1 + gone
                if r[2] > k["quality"] and not k["row"][7]:
                    k["quality"], k["text"] = r[2], r[1]
                break
        else:
            kept.append({"row": r, "helpful": r[3], "harmful": r[4], "merged": gone, "quality": r[2], "text": r[1]})
    got = playbook.dedupe_bullets(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["pattern"], r["helpful"], r["harmful"], r["merged"], r["quality"], r["description"]) for r in got) == sorted(
        (k["row"][0], k["helpful"], k["harmful"], k["merged"], k["quality"], k["text"]) for k in kept
    )


def test_ratings_are_scanned_once_per_cube(spark):
    ratings = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr(
        "CAST(CAST(ts AS DATE) AS STRING) AS event_date", "CAST(event_id % 10 AS INT) AS rating", "array(event_type) AS patterns"
    )
    plan = measure.daily_low_hits(ratings)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "value" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize("name", [
    "effectiveness_verdicts", "held_out_regression", "pattern_stats", "near_duplicates", "lesson_retrieval", "judge_quorum", "turns",
])
def test_no_cartesian_product(spark, name):
    df = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert "CartesianProduct" not in df._jdf.queryExecution().executedPlan().toString()


def test_prefix_sums_and_lag_over_range_partitions(spark):
    data = [("hot", k // 7 if k % 3 else None, k, float(k % 5)) for k in range(900)] + [(None, 1, 901, 2.0), ("one", 1, 902, 3.0)]
    df = spark.createDataFrame(data, "k string, at long, id long, row double").repartition(6)
    want_sum, want_lag, sums, last = {}, {}, {}, {}
    for k, at, i, v in sorted(data, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        sums[k] = sums.get(k, 0) + v
        want_sum[i], want_lag[i] = sums[k], last.get(k)
        last[k] = v
    got = prefix_sums(df, ["k"], ["at", "id"], {"total": F.col("row")}).collect()
    assert {r.id: r.total for r in got} == want_sum and len(got) == len(data)
    got = prefix_lag(df, ["k"], ["at", "id"], "row", "before").collect()
    assert {r.id: r.before for r in got} == want_lag


def test_prefix_sums_spread_one_key_and_equal_rows(spark):
    same = spark.range(4000).select(F.lit("a").alias("k"), F.lit(1).alias("at"))
    got = prefix_sums(same, ["k"], ["at"], {"place": F.lit(1).cast("long")})
    assert sorted(r.place for r in got.collect()) == list(range(1, 4001))
    assert prefix_sums(same.where("false"), ["k"], ["at"], {"place": F.lit(1).cast("long")}).count() == 0
    assert prefix_sums(same, [], ["at"], {"place": F.lit(1).cast("long")}).agg(F.max("place")).first()[0] == 4000


def test_size_estimates_do_not_grow_along_rounds(spark):
    """A table joined to itself round by round: its estimate follows the data, not the squares of the rounds before."""
    from feedloom.session import cut_lineage

    table = cut_lineage(spark.range(50).selectExpr("id", "id % 7 AS label"))
    for _ in range(6):
        table = cut_lineage(table.join(table.withColumnRenamed("label", "other"), "id").groupBy("id").agg(F.min("label").alias("label")))
    estimate = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert table.count() == 50 and estimate < 10**6


def test_joins_of_similar_sets_carry_numbers(spark, monkeypatch):
    """Long ids are not repeated in the rows that are shuffled per token and per candidate."""
    types, real = [], similarity._rare_first
    monkeypatch.setattr(similarity, "_rare_first", lambda sets: types.append(dict(sets.dtypes)["rep"]) or real(sets))
    long_id = lambda k: f"{39 - k:03d}" + "x" * 200
    sets = [(long_id(k), [f"{c}{k // 2}" for c in "abcdefghi"] + [f"own{k}"]) for k in range(40)]
    got = similarity.similar_pairs(spark.createDataFrame(sets, "id string, tokens array<string>"), 0.8)
    assert sorted((r.a, r.b) for r in got.collect()) == sorted((long_id(k + 1), long_id(k)) for k in range(0, 40, 2))
    assert types == ["bigint"]


@pytest.mark.parametrize(("threshold", "rare"), [(0.5, 3), (0.55, 0), (0.75, 3), (0.8, 0), (0.8, 16), (1.0, 0)])
def test_similar_pairs_of_common_words_in_several_slices(spark, monkeypatch, threshold, rare):
    """Pairs of words as keys, sets that meet a few sizes at a time: each pair once, none lost."""
    monkeypatch.setattr(similarity.setkeys, "RARE", rare)
    monkeypatch.setattr(similarity, "SLICE_TOKENS", 1)
    rng = random.Random(int(threshold * 100) + rare)
    words = [f"w{i}" for i in range(400)]
    sets = []
    for _ in range(40):
        base = rng.sample(words, rng.choice([2, 5, 9, 15, 17, 33, 60, 64, 120]))
        for _ in range(5):
            kept = [w for w in base if rng.random() > 0.12] or base
            sets.append((len(sets), sorted({*kept, *rng.sample(words, rng.randrange(1 + len(base) // 5))})))
    frame = spark.createDataFrame(sets, "id long, tokens array<string>")
    got = [(r["a"], r["b"], round(r["score"], 6)) for r in similarity.similar_pairs(frame, threshold).collect()]
    rep = {}
    for i, t in sets:
        rep.setdefault(tuple(t), i)
    want = [(rep[tuple(t)], i, 1.0) for i, t in sets if rep[tuple(t)] != i]
    for t, a in rep.items():
        for u, b in rep.items():
            j = len(set(t) & set(u)) / len(set(t) | set(u))
            if a < b and j >= threshold:
                want.append((a, b, round(j, 6)))
    assert sorted(got) == sorted(want) and len(want) > 10


def test_similar_pairs_leave_no_shuffle_files_of_their_steps(spark, tmp_path):
    """Shuffle files of a step go when its table is written, not when the driver happens to collect its garbage."""
    from pathlib import Path

    local = Path(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    held = lambda: {p for p in local.rglob("shuffle_*") if p.suffix == ".data"}
    sets = spark.createDataFrame([(k, [f"{c}{k // 2}" for c in "abcdefghi"] + [f"own{k}"]) for k in range(400)], "id long, tokens array<string>")
    before = held()
    pairs = similarity.similar_pairs(sets, 0.8)
    assert sum(p.stat().st_size for p in held() - before) < 20_000
    assert pairs.count() == 200


def test_texts_of_a_key_are_scored_once_with_the_same_failures(spark):
    from feedloom.functions import checks
    from feedloom.operators import measure

    done, fine = "All work is done and the fix is deployed.", "Here is a plan for tomorrow."
    rows = [("t1", f"s{k}", done) for k in range(50)] + [("t1", "s1", fine), ("", "s1", done), ("", "s2", done), (None, "s1", done), (None, None, None), ("t2", "s3", fine)]
    df = spark.createDataFrame(rows, "timestamp string, session_id string, response_preview string")
    texts = measure.texts_by_key(df)
    assert texts.count() == 7
    scored = [measure.failed_checks(checks.score(x, "response_preview", ["timestamp", "session_id"])) for x in (df, texts)]
    want, got = (sorted(map(tuple, x.collect())) for x in scored)
    assert got == want and want


def test_bullet_ranks_hold_no_texts(spark):
    """Ranks go through each join and round of the greedy merge; the place in the pattern stands for the description."""
    from feedloom.operators import playbook

    schema = "pattern string, description string, quality int, helpful long, harmful long, priority int, verdict string, seed boolean"
    rows = [("tone_1", f"{c} text", 2, 1, 1, 1, "working", seed) for c, seed in (("b", True), ("a", True), ("d", False), ("c", False))]
    rows += [("tone_2", "seen", 4, 1, 1, 1, "flat", False), ("tone_2", "best", 5, 1, 1, 1, "working", False), ("tone_2", "kept", 1, 0, 0, 0, "working", True)]
    got = playbook.one_per_pattern(spark.createDataFrame(rows, schema))
    assert [f.name for f in got.schema["_rank"].dataType.fields] == ["s", "p", "n"]
    order = [(r.pattern, r.description, r.seed, r._merged) for r in got.orderBy("_rank").collect()]
    assert order == [("tone_1", "a text", True, 2), ("tone_1", "b text", True, 0), ("tone_2", "best", False, 1), ("tone_2", "kept", True, 0)]


def test_diversity_check_keeps_no_shuffle_files_and_finds_the_top_pairs(spark):
    from pathlib import Path

    local = Path(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    held = lambda: {p for p in local.rglob("shuffle_*") if p.suffix == ".data"}
    word = lambda k: "".join(chr(97 + int(c)) for c in f"{k:05d}")
    rules = [(f"p{k:03d}", " ".join(word(x) for x in [*range(20 * (k // 2), 20 * (k // 2) + 20), *range(9000 + k, 9000 + k + k % 2 * 3)])) for k in range(300)]
    lessons = spark.createDataFrame(rules, "pattern string, rule string")
    before = held()
    top = similarity.diversity_check(lessons)
    assert sum(p.stat().st_size for p in held() - before) < 20_000
    assert [(r.a, r.b, r.jaccard) for r in top.collect()] == [(f"p{2 * k:03d}", f"p{2 * k + 1:03d}", 0.87) for k in range(20)]
