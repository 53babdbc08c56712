"""Boundaries of verdicts, ratings, lessons and policies."""

import pytest
from pyspark.sql import functions as F

from feedloom.functions import capture, lessons, text
from feedloom.operators import classify, ledger, measure, policy, reports


def col(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_verdict_boundaries(spark):
    cases = [
        (0.2, 0.1, 4, 13, "pending"),
        (0.2, 0.1, 4, 14, "stale-pending"),
        (0.2, 0.1, 5, 14, "working"),
        (0.0, 0.1, 5, 0, "no-baseline"),
        (0.2, 0.0, 5, 0, "resolved"),
        (0.2, 0.1001, 5, 0, "improving"),
        (0.2, 0.2, 5, 0, "flat"),
        (0.5, 0.6, 5, 0, "flat"),
        (0.5, 0.6001, 5, 0, "regressed"),
    ]
    df = spark.createDataFrame(cases, "b double, a double, n int, d int, want string")
    got = df.select(measure.verdict(F.col("b"), F.col("a"), F.col("n"), 5, F.col("d")).alias("v"), "want").collect()
    assert [r["v"] for r in got] == [r["want"] for r in got]


def test_days_between(spark):
    rows = [("2024-01-01", "2024-01-15"), ("bad", "2024-01-15"), ("", "2024-01-15")]
    got = col(spark, rows, "a string, b string", measure.days_between(F.col("a"), F.col("b")))
    assert got == [(14,), (999,), (999,)]


def test_review_expiry(spark):
    rows = [("p", "2024-01-01", "pending", None, None), ("q", "2023-12-31", "pending", None, None)]
    q = spark.createDataFrame(rows, "pattern string, detected_at string, status string, reviewed_at string, reviewer string")
    got = {r["pattern"]: r["status"] for r in measure.expire_reviews(q, "2024-01-15").collect()}
    assert got == {"p": "pending", "q": "auto-escalated"}


def test_side_effect_thresholds(spark):
    """From 20 of 100 low sessions, 31 flags and 29 does not (ratio under 1.5)."""
    def history(after_low):
        rows = [("2024-01-01", 1 if i < 20 else 9, ["q"]) for i in range(100)]
        return rows + [("2024-01-10", 1 if i < after_low else 9, ["q"]) for i in range(100)]

    lesson = spark.createDataFrame([("p", "2024-01-05")], "pattern string, baseline_date string")
    schema = "event_date string, rating int, patterns array<string>"
    for after_low, flagged in [(31, 1), (29, 0)]:
        out = measure.side_effects(spark.createDataFrame(history(after_low), schema), lesson)
        assert out.count() == flagged


def test_empty_timestamp_is_before_any_date(spark):
    ratings = spark.createDataFrame(
        [("", 1, ["p"]), ("2024-01-09", 9, ["other"])], "event_date string, rating int, patterns array<string>"
    )
    lesson = spark.createDataFrame([("p", "2024-01-05")], "pattern string, baseline_date string")
    row = measure.totals_around(measure.daily_low_hits(ratings), lesson).first()
    assert (row["before_n"], row["after_n"]) == (1, 1)


def test_undated_lesson(spark):
    ratings = spark.createDataFrame(
        [("2024-01-09T00:00:00", "2024-01-09", 1, ["p"])], "timestamp string, event_date string, rating int, patterns array<string>"
    )
    lesson = spark.createDataFrame([("p", "")], "pattern string, baseline_date string")
    none = spark.createDataFrame([], "timestamp string, session_id string, pattern string, passed boolean")
    row = measure.effectiveness(ratings, lesson, none, none, [], "2024-02-01").first()
    assert (row["verdict"], row["injectable"]) == ("undated", False)


RATINGS = [
    ("7", (7, None)), ("8 - good work", (8, "good work")), ("6: needs work", (6, "needs work")), ("9 excellent", (9, "excellent")),
    ("10!", (10, "!")), ("10", (10, None)), ("10/10", None), ("3.5", None), ("7th thing", None), ("5x", None), ("3 items", None),
    ("4 of them", None), ("0", None), ("great", None), ("2 minutes late", None), ("1-bad", (1, "bad")), ("7\nsecond line", None),
]


@pytest.mark.parametrize("prompt,want", RATINGS)
def test_explicit_rating(spark, prompt, want):
    got = spark.createDataFrame([(prompt,)], "p string").select(capture.explicit_rating(F.col("p")).alias("r")).first()["r"]
    assert (tuple(got) if got else None) == want


def test_praise_and_system_text(spark):
    rows = [("Great job!",), ("perfect awesome",), ("looks good to me",), ("<system-reminder> x",), ("ok",)]
    got = col(spark, rows, "p string", capture.praise_rating(F.col("p")), capture.is_system_text(F.col("p")), capture.is_too_short(F.col("p")))
    assert got == [(8, False, False), (8, False, False), (None, False, False), (None, True, False), (None, False, True)]


def test_implicit_route(spark):
    long = "x" * 200
    rows = [(5, 0.5, ""), (5, 0.4, long), (None, 0.9, long), (None, 0.9, "short")]
    got = col(spark, rows, "r int, c double, t string", capture.implicit_route(F.col("r"), F.col("c"), F.col("t")))
    assert [g[0] for g in got] == ["keep", "judge", "judge", "drop"]


def test_junk(spark):
    rows = [
        ("explicit", None, 0.0, "", ""), ("explicit", 3, 0.0, "", ""), ("implicit", None, 0.9, "x" * 60, ""),
        ("implicit", 5, 0.9, "x" * 38, ""), ("implicit", 5, 0.9, "x" * 40, ""), ("implicit", 5, 0.0, "INFERENCE_FAILED " * 4, ""),
        ("implicit", 5, 0.9, '{"summaries" : [' + "x" * 60, ""),
    ]
    schema = "source string, rating int, confidence double, response_preview string, sentiment_summary string"
    got = [g[0] for g in col(spark, rows, schema, reports.is_junk())]
    assert got == [False, False, True, True, False, True, True]


def test_rule_quality(spark):
    rows = [
        ("Avoid missed context — verify before acting.", True, 0),
        ("Never claim done without fenced CLI output and exit codes.", False, 4),
        ("Never claim done without fenced CLI output; run tests before saying complete.", False, 4),
        ("", True, 0),
        ("The word count here is long as it has to be for text", False, 1),
    ]
    got = col(spark, rows, "r string, w boolean, q int", lessons.weak_rule(F.col("r")), "w", lessons.rule_quality(F.col("r")), "q")
    assert all(g[0] == g[1] for g in got)
    assert [g[2] for g in got] == [g[3] for g in got]


def test_reflector_order(spark):
    schema = "pattern string, rule string, evidence array<string>, root_cause string, where_ string"
    rows = [
        ("good", "Never claim done without fenced CLI output; run tests before saying complete.", [], "", ""),
        ("banked", "short", [], "", ""),
        ("seen", "short", ["user forbade this and it was posted anyway"], "", ""),
        ("caused", "short", [], "Check the schema with bq show before any change lands", ""),
        ("missed_thing", "short", [], "", "repos: a"),
    ]
    bank = spark.createDataFrame(
        [("banked", "pitfall", "Before merging, run `bq show` and never skip the schema check of a table.")],
        "pattern string, section string, description string",
    )
    hints = [("forbade|without permission", "Draft, show, ask, wait, then post. Never post without approval of the owner.")]
    plain = [(".*", "When {phrase} risk appears: stop, gather tool evidence, then act on what it shows.")]
    out = {r["pattern"]: r for r in lessons.reflect(spark.createDataFrame(rows, schema), bank, hints, plain).collect()}
    assert {p: r["source"] for p, r in out.items()} == {
        "good": "passthrough", "banked": "bank", "seen": "evidence", "caused": "evidence", "missed_thing": "heuristic",
    }
    assert out["banked"]["section"] == "pitfall"
    assert out["missed_thing"]["description"].startswith("When missed thing risk appears")
    assert out["missed_thing"]["description"].endswith("Hotspots: repos: a.")
    assert not out["good"]["weak_input"] and out["seen"]["weak_input"]


def test_lesson_format(spark):
    good = "---\nname: a\ndescription: b\nmetadata:\n---\nrule\n```x```\n"
    rows = [(good,), (good + "```",), ("no markers",), ("---\nname: a\n---\nx",)]
    assert [g[0] for g in col(spark, rows, "c string", lessons.lesson_format_ok(F.col("c")))] == [True, False, False, False]


def test_compress_is_a_greedy_fold(spark):
    import re

    from feedloom.fixed_values import SEED_DURABLE

    paragraphs = ["decided " * n + "x" * size for n, size in [(1, 50), (5, 300), (3, 10), (4, 90), (2, 200), (0, 40)]]
    body = "\n\n".join(paragraphs)

    def direct(limit):
        scored = [(len(re.findall(SEED_DURABLE, p.strip(), re.I)), p.strip()) for p in re.split(r"\n{2,}", body)]
        out, n = [], 0
        for score, p in sorted([s for s in scored if s[0]], key=lambda s: -s[0]):
            if n + len(p) > limit:
                continue
            out.append(p)
            n += len(p)
            if n >= limit * 0.7:
                break
        return "\n\n".join(out)[:limit] if out else body[-limit:]

    for limit in (60, 150, 320, 500, 3500):
        got = spark.createDataFrame([(body,)], "t string").select(text.compress_episode(F.col("t"), limit).alias("x")).first()["x"]
        assert got == direct(limit)


def test_policy_first_rule_wins(spark):
    rules = [policy.Rule("confirm", "git push", "second"), policy.Rule("blocked", "--force", "first"), policy.Rule("trusted", "^git status")]
    rows = [("X=1 git push --force",), ("git push",), ("git status --force",), ("make [",)]
    got = [tuple(r) for r in policy.policy_verdict(spark.createDataFrame(rows, "command string"), rules + [policy.Rule("alert", "make [", "bad regex")]).collect()]
    assert [(g[1], g[2]) for g in got] == [("block", "first"), ("confirm", "second"), ("allow", None), ("alert", "bad regex")]


def test_globs():
    import re

    assert re.match(policy.path_regex("~/a/*.md", "/h").replace(r"\z", r"\Z"), "/h/a/x.md")
    assert not re.match(policy.path_regex("~/a/*.md", "/h").replace(r"\z", r"\Z"), "/h/a/b/x.md")
    assert re.match(policy.path_regex("/a/**/x", "/h").replace(r"\z", r"\Z"), "/a/b/c/x")
    assert re.match(policy.path_regex("/a", "/h").replace(r"\z", r"\Z"), "/a/b")
    assert not re.match(policy.path_regex("/a", "/h").replace(r"\z", r"\Z"), "/ab")
    assert re.match(policy.glob_regex("/a/*.md", "/h").replace(r"\z", r"\Z"), "/a/b/c.md")


def test_registry_reconcile(spark):
    code = spark.createDataFrame([("a", 1), ("b", 2), ("c", 1), ("d", 1)], "eval_id string, version int")
    reg = spark.createDataFrame(
        [("b", 1, "active"), ("c", 1, "retired"), ("d", 1, "orphaned"), ("e", 1, "active")], "eval_id string, version int, status string"
    )
    got = {r["eval_id"]: (r["status"], r["changes"]) for r in ledger.reconcile_registry(code, reg).collect()}
    assert got == {
        "a": ("active", ["added"]), "b": ("active", ["version"]), "c": ("active", ["reactivated"]),
        "d": ("active", ["un-orphaned"]), "e": ("orphaned", ["orphaned"]),
    }


def test_taxonomies_are_literal(spark):
    df = spark.createDataFrame([("claimed it was approved",), ("the claimed.*approved thing",)], "sentiment_summary string")
    got = [r["patterns"] for r in classify.classify_for_source(df, "pr_review", {}).collect()]
    assert got == [["other"], ["approved_without_verification"]]


def test_stall_ages(spark):
    edits = spark.createDataFrame(
        [("a", "p", "2024-01-01", "active"), ("b", "p", "2024-01-02", "active")], "skill string, pattern string, applied string, status string"
    )
    ratings = spark.createDataFrame([("zzz", None, "2024-01-01T00", 1)], "skill string, skill_candidates array<string>, timestamp string, rating int")
    got = {r["skill"]: r["new_status"] for r in ledger.stall(edits, ratings, "2024-01-16").collect()}
    assert got == {"a": "stalled", "b": "active"}


def test_quorum_sizes(spark):
    votes = spark.createDataFrame(
        [("t", "s", 0, "p", True, "e0"), ("t", "s", 1, "p", True, "e1"), ("t", "s", 2, "p", False, "")],
        "timestamp string, session_id string, pass_no int, pattern string, flagged boolean, evidence string",
    )
    got = {q: ledger.judge_quorum(votes, ["p", "z"], q).where("pattern = 'p'").first() for q in (1, 2, 3)}
    assert {q: (r["passed"], r["evidence"]) for q, r in got.items()} == {1: (False, "e0"), 2: (False, "e0"), 3: (False, "e0")}
    only_one = votes.where("pass_no <> 1")
    assert ledger.judge_quorum(only_one, ["p"], 3).first()["passed"] is True


def test_health_helpers(spark):
    from feedloom.operators import graph, health

    modes = spark.createDataFrame([("a", "block"), ("b", "warn")], "pattern string, mode string")
    assert {r["check"] for r in health.override_checks(modes, ["a", "b", "c"]).collect()} == {"b_not_block", "c_not_block"}
    edits = spark.createDataFrame(
        [("s", "p", "2024-01-01", "active", 0), ("t", "p", "2024-01-01", "active", 2), ("u", "p", "2024-01-10", "active", 0)],
        "skill string, pattern string, applied string, status string, post_n int",
    )
    assert [r["skill"] for r in health.stalled_edit_checks(edits, "2024-01-20").collect()] == ["s"]
    probe = spark.createDataFrame([("Done. The table has 5000 rows and everything is complete.",)], "t string")
    assert probe.select(health.probe_is_weak(F.col("t")).alias("ok")).first()["ok"] is True
    files = spark.createDataFrame([("a.py", "new", True), ("b.md", "deleted", False)], "path string, status string, is_code boolean")
    assert tuple(graph.code_only(files).first()) == (1, True)


def test_prior_failed_and_negative_results(spark):
    edits = spark.createDataFrame(
        [("s", f"p{i}", f"2024-01-0{i}", "reverted") for i in range(1, 8)] + [("s", "q", "2024-02-01", "active")],
        "skill string, pattern string, applied string, status string",
    )
    assert sorted(r["pattern"] for r in ledger.prior_failed(edits).collect()) == ["p3", "p4", "p5", "p6", "p7"]
    archived = edits.where("pattern IN ('p1', 'p2')")
    assert ledger.negative_results(edits, archived).count() == 5


def test_tool_event_flags(spark):
    rows = [
        ("git push origin feature", "", "", "Bash"), ("git -C x push origin uat", "", "", "Bash"), ("git log --grep push", "", "", "Bash"),
        ("", "/r/.github/workflows/ci.yml", "notify_teams_channel: BigBrother", "Write"), ("gh pr review 3 --approve", "", "", "Bash"),
    ]
    out = policy.tool_event_flags(spark.createDataFrame(rows, "command string, file_path string, content string, tool_name string")).collect()
    assert [r["push_blocked"] for r in out] == [True, False, False, False, False]
    assert [r["workflow_blocked"] for r in out] == [False, False, False, True, False]
    assert [r["is_approval"] for r in out] == [False, False, False, False, True]
    assert [r["verify_reminder"] for r in out] == [False, False, False, True, False]
