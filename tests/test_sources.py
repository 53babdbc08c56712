"""Readers and writers on files made by the tests."""

import json

import pytest
from pyspark.sql import functions as F

from feedloom.operators import turns
from feedloom.plans import adapters, session_end
from feedloom.plans import queries_ledger, queries_measure
from feedloom.sources import readers, sinks


def put(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
    return str(path)


def test_read_ratings(spark, tmp_path):
    path = put(tmp_path / "r.jsonl", [
        {"timestamp": "2024-01-01T00:00:00", "rating": 7, "session_id": "a", "tools_used": ["Bash"]},
        {"timestamp": "2024-01-02", "rating": None, "session_id": "b"},
        {"rating": "3", "eval_results": {"x": {"passed": False, "pattern": "p"}}, "comment": None},
    ])
    rows = {r["session_id"]: r for r in readers.read_ratings(spark, path).collect()}
    assert set(rows) == {"a", ""}
    assert rows["a"]["rating"] == 7 and rows["a"]["tools_used"] == ["Bash"] and rows["a"]["event_date"] == "2024-01-01"
    assert rows[""]["rating"] == 3 and rows[""]["comment"] == "" and rows[""]["eval_results"]["x"]["passed"] is False


def test_malformed_ratings_raise_and_logs_skip(spark, tmp_path):
    path = put(tmp_path / "r.jsonl", [{"rating": 1}, "{broken"])
    with pytest.raises(Exception, match="Malformed|MALFORMED"):
        readers.read_ratings(spark, path).collect()
    assert readers.read_ratings(spark, path, malformed="skip").count() == 1


LESSON = """---
name: x
description: y
metadata:
  pattern: blind_retry
  occurrence_count: 12
  avg_rating: 3.5
  first_seen: 2024-01-03
  last_updated: 2024-02-01
---

Stop and read the error before trying again.

**Root cause:** nobody read the log
**Where it happens:** repos: core (×3)

- [2] forbade this
- [3] second line
"""


def test_read_lessons(spark, tmp_path):
    put(tmp_path / "lesson_autogen_blind_retry.md", [LESSON])
    put(tmp_path / "lesson_autogen_other_one.md", ["---\nbaseline_date: 2024-01-01\n---\n**Bold**\nRule here.\n"])
    rows = {r["pattern"]: r for r in readers.read_lessons(spark, str(tmp_path)).collect()}
    r = rows["blind_retry"]
    assert r["rule"] == "Stop and read the error before trying again." and r["occurrence_count"] == 12
    assert r["baseline_date"] == "2024-01-03" and r["evidence"] == ["forbade this", "second line"]
    assert r["root_cause"] == "nobody read the log" and r["where_"] == "repos: core (×3)" and r["avg_rating"] == 3.5
    assert rows["other_one"]["rule"] == "Rule here." and rows["other_one"]["baseline_date"] == "2024-01-01"


def test_read_failures(spark, tmp_path):
    put(tmp_path / "2024-01" / "2024-01-05-101112_review-was-stale" / "CONTEXT.md",
        ["Rating: 2", "Summary: quoted an old diff", "", "## What Happened", "", "It quoted an old diff.", "---", "x"])
    put(tmp_path / "2024-01" / "2024-01-06-101112_dag-broke" / "CONTEXT.md", ["nothing"])
    rows = {r["session_id"]: r for r in readers.read_failures(spark, str(tmp_path)).collect()}
    a = rows["2024-01-05-101112_review-was-stale"]
    assert (a["rating"], a["sentiment_summary"], a["response_preview"]) == (2, "quoted an old diff", "It quoted an old diff.")
    b = rows["2024-01-06-101112_dag-broke"]
    assert (b["rating"], b["sentiment_summary"]) == (3, "ag broke")
    assert readers.read_failures(spark, str(tmp_path), "pr_review").count() == 1
    assert readers.read_failures(spark, str(tmp_path), "dag").count() == 1


def test_read_transcripts(spark, tmp_path):
    path = put(tmp_path / "s1.jsonl", [
        {"type": "user", "message": {"role": "user", "content": "please look"}},
        {"type": "assistant", "message": {"content": [
            {"type": "text", "text": "looking"}, {"type": "tool_use", "name": "Grep", "input": {"pattern": "x"}},
            {"type": "tool_use", "name": "Bash", "input": {"command": "ls"}}]}},
        {"type": "user", "message": {"content": [{"type": "tool_result", "content": "three files"}]}},
        {"type": "assistant", "message": {"content": [{"type": "text", "text": "found"}]}},
        "{broken",
        {"type": "user", "message": {"content": [{"type": "text", "text": "thanks"}]}},
    ])
    t = readers.read_transcripts(spark, path)
    got = [(r["type"], r["text"], r["tools"]) for r in t.orderBy("seq").collect()]
    assert got == [
        ("user", "please look", []), ("assistant", "looking", ["Grep", "Bash"]), ("tool_result", "three files", []),
        ("assistant", "found", []), ("user", "thanks", []),
    ]
    numbered = turns.number_turns(t)
    assert [r["turn_no"] for r in numbered.orderBy("seq").collect()] == [1, 1, 1, 1, 2]
    summary = turns.summarize_turns(numbered).first()
    assert (summary["response"], summary["n_tools"], summary["n_research"]) == ("found", 2, 1)
    assert turns.turn_evidence(numbered).first()["evidence"] == "three files"
    assert readers.transcript_blocks(t).where("type = 'tool_use'").count() == 2


def test_cases_scenarios_and_graph(spark, tmp_path):
    case = {"split": "in", "cases": [{"id": "c1", "domain": "d", "pattern": "p", "response": "All done.",
            "expect": {"completion_without_artifact": {"applied": True, "passed": False}}}]}
    path = put(tmp_path / "cases.json", [json.dumps(case, indent=1)])
    from feedloom.operators import ledger

    assert ledger.expectation_errors(readers.read_cases(spark, path)).first()["ok"] is True
    scenario = {"scenarios": [{"id": "s", "split": "out", "must_not_match": ["never"], "eval_expect": {}}]}
    s = readers.read_scenarios(spark, put(tmp_path / "sc.json", [json.dumps(scenario)])).first()
    assert s["must_not_match"] == ["never"] and s["must_match_any"] == []
    g = {"nodes": [{"id": "a", "label": "A"}], "links": [{"source": "a", "target": "b", "relation": "calls"}],
         "hyperedges": [{"id": "h", "nodes": ["a", "b"]}]}
    nodes, edges, hyper = readers.read_graph(spark, put(tmp_path / "g.json", [json.dumps(g)]))
    assert nodes.first()["label"] == "A" and edges.first()["relation"] == "calls" and hyper.first()["members"] == ["a", "b"]


def test_corpus_and_csv(spark, tmp_path):
    put(tmp_path / "c" / "a" / "x.py", ["one two", "three"])
    put(tmp_path / "c" / "b" / "y.md", ["four five six"])
    (tmp_path / "c" / "b" / "z.png").write_bytes(b"\x89PNG")
    inv = {r["kind"]: (r["files"], r["words"]) for r in readers.corpus_inventory(spark, str(tmp_path / "c")).collect()}
    assert inv == {"code": (1, 3), "docs": (1, 3), "images": (1, 0)}
    assert readers.corpus_warning(readers.corpus_inventory(spark, str(tmp_path / "c"))).first()["too_large"] is False
    assert readers.largest_subfolders(spark, str(tmp_path / "c")).first()["files"] == 2
    csv = put(tmp_path / "t.csv", ["category,value", "a,1", "a,2", "b,5"])
    profile = readers.csv_profile(spark, csv, "category", "value")
    assert tuple(profile["shape"].first()) == (3, 2)
    assert {tuple(r) for r in profile["group_sums"].collect()} == {("a", 3), ("b", 5)}


def test_latest_session(spark, tmp_path):
    import os

    for name, size, age in [("old", 60_000, 100), ("new", 60_000, 10), ("tiny", 3_000, 1)]:
        p = tmp_path / f"{name}.jsonl"
        p.write_bytes(b"x" * size)
        os.utime(p, (1_700_000_000 - age, 1_700_000_000 - age))
    assert readers.latest_session(spark, str(tmp_path)).first()["path"].endswith("new.jsonl")


def test_configuration(spark, tmp_path):
    rows = [{"pattern": "b", "keyword": "k1", "ord": 1}, {"pattern": "a", "keyword": "k0", "ord": 0}]
    path = put(tmp_path / "tax.jsonl", rows)
    assert sorted(map(tuple, readers.read_taxonomy(spark, path).collect())) == [("a", "k0", 0), ("b", "k1", 1)]
    more = str(tmp_path / "tax")
    for keyword in ("one", "two"):
        sinks.append_taxonomy(spark.createDataFrame([("new", keyword, 1)], "pattern string, keyword string, ord int"), more)
    assert sorted(r["keyword"] for r in readers.read_taxonomy(spark, more).collect()) == ["one", "two"]
    commands, paths = readers.read_policy(json.dumps({"bash": {"blocked": [{"pattern": "rm", "reason": "no"}]}, "paths": {"noDelete": ["~/m"]}}))
    assert commands[0].tier == "blocked" and paths[0].pattern == "~/m"


def test_writers_replace_their_own_run(spark, tmp_path):
    df = spark.createDataFrame([("p", 1)], "pattern string, n int")
    path = str(tmp_path / "log")
    for run in ("2024-01-01", "2024-01-02", "2024-01-02"):
        sinks.append_effectiveness(df, path, run)
    assert spark.read.parquet(path).count() == 2
    sinks.write_report(df, str(tmp_path / "csv"), "csv")
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first()["pattern"] == "p"
    edits = spark.createDataFrame([("s", "p", "d", "reverted"), ("s", "q", "d", "active")], "skill string, pattern string, applied string, status string")
    none = edits.limit(0)
    sinks.append_negative_results(edits, none, str(tmp_path / "neg"), "r1")
    assert spark.read.parquet(str(tmp_path / "neg")).count() == 1


def test_session_end(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    ratings = adapters.view(spark, sf, adapters.RATINGS).withColumn("tools_used", F.array("tool")).withColumn(
        "skill_candidates", F.array("skill")
    ).withColumn("eval_results", F.create_map().cast("map<string, struct<passed: boolean, pattern: string>>"))
    queue = adapters.view(spark, sf, adapters.QUEUE)
    prior = spark.sql("SELECT 'x' AS pattern, 'flat' AS verdict")
    lessons = queries_measure.lessons(spark, sf).withColumns(
        {
            "rule": F.when(F.col("pattern").isin("blind_retry", "tool_misuse"), "Read the failing log before you retry any command at all").otherwise(F.regexp_replace(F.translate(F.sha2("pattern", 256), "0123456789", "ghijklmnop"), "(.{6})", "$1 ")),
            "occurrence_count": F.length("pattern"),
        }
    )
    paths = session_end.run(
        session_end.Inputs(
            ratings, lessons, queries_measure.judged(spark, sf), queue, prior, queries_ledger.edits(spark, sf), adapters.TAXONOMY,
            labels=queries_ledger._unique_labels(spark, sf),
            enforcement_log=adapters.view(spark, sf, adapters.ENFORCEMENT),
            enforceable=spark.sql("SELECT * FROM VALUES ('click'), ('view') AS t(pattern)"),
            overrides=spark.sql("SELECT * FROM VALUES ('click', 'block'), ('view', 'warn') AS t(pattern, mode)"),
            variants=adapters.view(spark, sf, queries_ledger._VARIANTS),
            cases=queries_ledger.cases(spark, sf),
            baseline=spark.sql(queries_ledger._BASE),
            audit=adapters.view(spark, sf, queries_ledger._AUDIT),
            snapshots=adapters.view(spark, sf, queries_ledger._CHRONIC_SNAPS),
        ),
        str(tmp_path / "out"), queries_measure.AS_OF,
    )
    read = lambda name: spark.read.parquet(paths[name])
    merged = {tuple(r) for r in read("merges").select("survivor", "loser").collect()}
    assert merged == {("blind_retry", "tool_misuse")} or merged == {("tool_misuse", "blind_retry")}
    (survivor, loser), = merged
    kept = {r.pattern: r.occurrence_count for r in read("lessons").collect()}
    assert loser not in kept and kept[survivor] == len("blind_retry") + len("tool_misuse") and len(kept) == lessons.count() - 1
    new = read("queue_new").collect()
    assert {r.source for r in new} >= {"lesson_dedup"} and len({r.record_id for r in new}) == len(new)
    after = read("queue")
    assert after.count() == queue.count() + len(new)
    assert after.where("status = 'pending' AND source = 'lesson_dedup'").count() == 0
    moved = queue.unionByName(read("queue_new"), allowMissingColumns=True).where("status = 'pending'").count() - after.where("status = 'pending'").count()
    assert read("queue_audit").count() == moved > 0
    assert read("ratings_clean").count() + read("ratings_junk").count() == ratings.count()
    assert read("suite_gate").where("split = 'gate'").count() == 1
    assert read("playbook").count() <= read("bullets").count() <= len(kept)
    for name in ("promotion_candidates", "enforcement_candidates", "evolve_eligible", "retired_lessons", "chronic_failures", "burn_in", "hygiene"):
        assert name in paths and read(name).columns
    got = {tuple(r) for r in spark.read.parquet(paths["effectiveness"]).select("pattern", "verdict", "obj_verdict").collect()}
    want = {tuple(r) for r in queries_measure.scores(spark, sf).select("pattern", "verdict", "obj_verdict").collect()}
    assert got == want
    assert spark.read.parquet(paths["health"]).count() == 6


def test_line_numbers_do_not_depend_on_splits(spark, tmp_path):
    rng_lines = [json.dumps({"type": "user", "cwd": f"/{k}", "message": {"content": "x" * (k * 37 % 400)}}) if k % 11 else "{odd" for k in range(900)]
    (tmp_path / "a.jsonl").write_text("\n".join(rng_lines) + "\n")
    (tmp_path / "b.jsonl").write_text("\n".join(rng_lines[:50]))
    seen = []
    for size in ("4k", "64k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        rows = readers.read_transcripts(spark, str(tmp_path)).select("session", "seq", "cwd").collect()
        odd = readers.transcript_quarantine(spark, str(tmp_path)).select("session", "seq", "value").collect()
        seen.append((sorted(rows), sorted(odd)))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert seen[0] == seen[1] == seen[2]
    rows, odd = seen[0]
    assert [tuple(r) for r in rows if r.session == "a"] == [("a", k, f"/{k}") for k in range(900) if k % 11]
    assert [tuple(r) for r in odd if r.session == "b"] == [("b", k, "{odd") for k in range(50) if k % 11 == 0]
