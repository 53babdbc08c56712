"""Golden cases for the response checks: what fires and whether it passes."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis.strategies import from_regex
from pyspark.sql import functions as F

from feedloom.fixed_values import CHECK_PATTERNS
from feedloom.functions import checks
from feedloom.functions.gates import WordGates, tree_regex
from feedloom.plans.adapters import PHRASES
from feedloom.plans.queries_ledger import GOLDEN

# (text, check, passed); None means the check must not fire.
CASES = [
    ("I ran `bq query 'select 1'` fine", "sql_without_dry_run", False),
    ("bq query --dry_run ok", "sql_without_dry_run", True),
    ("works fine from here", "premature_certainty_without_trace", False),
    ("works fine, I checked the log", "premature_certainty_without_trace", True),
    ("called mcp__jira-context__get", "jira_mcp_used", False),
    ("I used the wrong tool", "wrong_tool_admission", False),
    ("wrong tool; switched to gh", "wrong_tool_admission", True),
    ("Left a review and posted it", "review_post_without_fresh_diff", False),
    ("Left a review and posted it after gh pr diff", "review_post_without_fresh_diff", True),
    ("based on the earlier diff this holds", "stale_analysis_continued", False),
    ("based on the earlier diff, now re-fetched", "stale_analysis_continued", True),
    ("the bug is fixed", "fix_claim_without_regression_check", False),
    ("the bug is fixed and the regression test runs", "fix_claim_without_regression_check", True),
    ("you should also consider caching", "extra_rec_without_scope_label", False),
    ("you should also consider caching, out of scope", "extra_rec_without_scope_label", True),
    ("VERIFY: all good", "verify_badge_without_evidence", False),
    ("VERIFY: see https://x.org/1", "verify_badge_without_evidence", True),
    ("I patched the loader", "change_badge_without_proof", False),
    ("I hotfixed it", "change_badge_without_proof", False),
    ("I patched the loader ```out``` done", "change_badge_without_proof", True),
    ("I was wrong, the table is empty", "correction_without_reverify", False),
    ("I was wrong, the table is empty, probably", "correction_without_reverify", None),
    ("you said not to push, pushing", "explicit_instruction_ignored", False),
    ("you said not to push; stopping as you requested", "explicit_instruction_ignored", True),
    ("package installed", "setup_claim_without_dep_resolve", False),
    ("package installed, import works", "setup_claim_without_dep_resolve", True),
    ("clearing; retry the task", "airflow_retry_without_upstream_check", False),
    ("retry the task after reading the task logs", "airflow_retry_without_upstream_check", True),
    # A text that fires through the trigger rule always passes.
    ("check the trigger_rule", "airflow_retry_without_upstream_check", True),
    ("you're right, that will work, see src/a.py", "confident_agreement_without_verification", True),
    ("approved the PR, gh pr view says CLEAN", "pr_approve_without_status", True),
    ("replaced all of them; scoped to only this file", "global_scope_without_confirm", True),
    ("àdone", "completion_without_artifact", None),
    # The dotless i folds to i under case-insensitive Unicode matching.
    ("fıxed", "completion_without_artifact", False),
]


@pytest.fixture(scope="module")
def fired(spark):
    texts = sorted({c[0] for c in CASES} | set(PHRASES))
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = checks.score(df, "text", ["text"]).collect()
    return {(r["text"], r["eval_id"]): r["passed"] for r in rows}


@pytest.mark.parametrize("text,check,passed", CASES)
def test_case(fired, text, check, passed):
    assert fired.get((text, check)) is passed


def test_phrases_fire_exactly_the_golden_checks(fired):
    want = {(PHRASES[n], check): passed for n, check, passed in GOLDEN}
    got = {k: v for k, v in fired.items() if k[0] in PHRASES}
    assert got == want


def test_every_check_has_a_case():
    seen = {c[1] for c in CASES} | {g[1] for g in GOLDEN}
    assert {c.eval_id for c in checks.CHECKS} <= seen


def test_full_matrix_and_map_agree(spark):
    df = spark.createDataFrame([(t,) for t in PHRASES], "text string")
    long = checks.score(df, "text", ["text"], fired_only=False).collect()
    assert len(long) == len(PHRASES) * len(checks.CHECKS)
    maps = {r["text"]: r["scored"] for r in checks.score_map(df, "text").collect()}
    for r in long:
        got = maps[r["text"]][r["eval_id"]]
        assert (got["applied"], got["passed"]) == (r["applied"], r["passed"])


def test_captured_results_win(spark):
    rows = [("a", "All done.", {"x": (False, "p")}), ("b", "All done.", {})]
    df = spark.createDataFrame(
        rows, "id string, response_preview string, eval_results map<string, struct<passed: boolean, pattern: string>>"
    )
    got = {(r["id"], r["eval_id"], r["passed"]) for r in checks.score_or_captured(df, ["id"]).collect()}
    assert got == {("a", "x", False), ("b", "completion_without_artifact", False)}


def test_custom_check(spark):
    spec = checks.CheckSpec("shouting", "tone", lambda t: t.rlike("[A-Z]{5}"), lambda t: t.contains("sorry"))
    df = spark.createDataFrame([("HELLO",), ("HELLO sorry",), ("hello",)], "text string")
    got = {r["text"]: r["passed"] for r in checks.score(df, "text", ["text"], [spec]).collect()}
    assert got == {"HELLO": False, "HELLO sorry": True}


def low_of(text):
    return text.replace("İ", "i").replace("ı", "i").replace("ſ", "s").replace("\u212a", "k").lower()


@pytest.mark.parametrize("name", sorted({**checks.GATE_WORDS, **checks.GATE_PARTS}))
def test_gate_words_never_hide_a_match(name):
    """Whatever an expression matches holds one of its gate words."""
    lists = [w[name] for w in (checks.GATE_WORDS, checks.GATE_ALSO) if name in w]
    words = [re.compile("(?<![a-z0-9_])" + tree_regex(w) + "(?![a-z_])") for w in lists]
    parts = checks.GATE_PARTS.get(name, ())

    @settings(max_examples=400, deadline=None, database=None, suppress_health_check=list(HealthCheck))
    @given(from_regex(re.compile(CHECK_PATTERNS[name], re.I)))
    def hold(text):
        low = low_of(text)
        assert all(w.search(low) for w in words)
        assert not parts or any(p in low for p in parts)

    hold()
    assert {n for c in checks.CHECKS for n in CHECK_PATTERNS if getattr(c.gate, "words", getattr(c.gate, "parts", []))}


def test_every_gate_is_behind_words():
    assert all(getattr(c.gate, "words", None) or getattr(c.gate, "parts", None) for c in checks.CHECKS)


def test_bits_of_words(spark):
    lists = [("a", "ab"), ("ab", "abc"), *[(f"w{k}x",) for k in range(70)], ("x_y",)]
    gates = WordGates(lists)
    texts = ["a", "xab", "ab1 c", "abc. w3x", "w69x_ w68x-", "x_y", "", "ABC"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("f", gates.found(F.col("t")))
    df = df.select("t", *[b.alias(f"b{k}") for k, b in enumerate(gates.bits(F.col("f")))])
    got = df.select("t", *[gates.test(w, "b").alias(str(k)) for k, w in enumerate(lists)]).collect()
    for r in got:
        found = set(re.findall(r"(?<![a-z0-9_])[a-z_][a-z0-9_]*?x?(?=\d*(?:$|[^a-z0-9_]))", r.t))
        tokens = {t.rstrip("0123456789") for t in re.findall(r"[a-z0-9_]+", r.t)} | set(re.findall(r"[a-z0-9_]+", r.t))
        assert [r[str(k)] for k in range(len(lists))] == [bool(tokens & set(w)) for w in lists], (r.t, found)


def test_vector_test_gets_only_fired_texts(spark):
    def calm(texts):
        assert texts.str.contains("done").all()
        return ~texts.str.isupper() & (texts.str.count("!") < 2)

    spec = checks.CheckSpec("calm", "tone", checks.says("claim"), vector_test=calm)
    native = checks.CheckSpec("hedge", "tone", checks.says("hedge"))
    df = spark.createDataFrame([("done!! probably", 1), ("done", 2), ("quiet", 3), (None, 4)], "text string, id int")
    got = {(r.id, r.eval_id): r.passed for r in checks.score(df, "text", ["id"], [spec, native]).collect()}
    assert got == {(1, "calm"): False, (2, "calm"): True, (1, "hedge"): False}
    full = checks.score(df, "text", ["id"], [spec], fired_only=False).collect()
    assert sorted((r.id, r.applied, r.passed) for r in full) == [(1, True, False), (2, True, True), (3, False, None), (4, False, None)]
    with pytest.raises(ValueError):
        checks.score_map(df, "text", [spec])
