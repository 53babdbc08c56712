"""Queries over transcripts, prompts and tool calls."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.fixed_values import (
    ALWAYS_ON,
    APPROVAL_COMMAND,
    CHECK_PATTERNS,
    DETECTOR_DEFAULT_MODES,
    DURABLE_CLAIM,
    ENV_PREFIX,
    FORBIDDEN_TOOL_NAME,
    GIT_PUSH,
    GRAPH_TOOL,
    GRAPH_WRITE_TOOL,
    PATH_SKILLS,
    PRAISE_PHRASES,
    PRAISE_WORDS,
    PROMOTION_BRANCH,
    RATING_BAD_SUFFIX,
    RATING_NUMBER,
    RATING_SENTENCE,
    RESEARCH_TOOL,
    SEED_DURABLE,
    SEED_RESEARCH_TOOL,
    SEED_WRITE_TOOL,
    SKILL_STOPWORDS,
    SYMBOL,
    SYSTEM_TEXT,
)
from feedloom.functions import capture, checks, detectors
from feedloom.functions.text import symbols
from feedloom.operators import policy, ratelimit, turns
from feedloom.plans import adapters as A
from feedloom.plans import checker as K
from feedloom.plans.registry import query
from feedloom.scale import prefix_sums
from feedloom.session import ensure_checkpoint_dir
from feedloom.sources import readers


def transcript(spark: SparkSession, sf: str) -> DataFrame:
    df = A.view(spark, sf, A.TRANSCRIPT)
    return df.withColumn("tools", F.filter(F.split("tools", ","), lambda t: t != ""))


def responses(spark: SparkSession, sf: str) -> DataFrame:
    return A.view(spark, sf, A.TRANSCRIPT).where("type = 'assistant'").select("session", "seq", "text")


_RESPONSES = f"resp AS (SELECT session, seq, text FROM ({A.TRANSCRIPT}) WHERE type = 'assistant')"
_TURNS = f"""tr AS ({A.TRANSCRIPT}),
nt AS (SELECT *, CAST(coalesce(sum(CASE WHEN type = 'user' AND trim(text) <> '' THEN 1 ELSE 0 END)
  OVER (PARTITION BY session ORDER BY seq), 0) AS BIGINT) AS turn_no FROM tr)"""


@query("response_checks", f"WITH {_RESPONSES} SELECT * FROM {K.fired('resp', 'text', 'session, seq')}")
def response_checks(spark, sf):
    return checks.score(responses(spark, sf), "text", ["session", "seq"]).drop("applied")


@query(
    "check_report",
    f"""WITH {_RESPONSES}, f AS {K.fired('resp', 'text', 'session, seq')}
SELECT eval_id, pattern, count(*) AS fired, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed,
 round(count(*) FILTER (NOT passed) / count(*), 4) AS fail_rate FROM f GROUP BY ALL""",
)
def check_report(spark, sf):
    from feedloom.operators.reports import check_report as report

    return report(checks.score(responses(spark, sf), "text", ["session", "seq"]))


def two_sentences(texts):
    """A vectorised test: at least two full stops."""
    return texts.str.count(r"\.") >= 2


BRIEF_CLAIM = checks.CheckSpec("brief_claim", "unverified_completion", checks.says("claim"), vector_test=two_sentences)


@query(
    "vector_checks",
    f"""WITH {_RESPONSES} SELECT session, seq, 'brief_claim' AS eval_id, 'unverified_completion' AS pattern,
 length(text) - length(replace(text, '.', '')) >= 2 AS passed FROM resp WHERE {K.re(K.fold('text'), CHECK_PATTERNS['claim'])}""",
)
def vector_checks(spark, sf):
    return checks.score(responses(spark, sf), "text", ["session", "seq"], [BRIEF_CLAIM]).drop("applied")


_ARMED = {p: m for p, m in DETECTOR_DEFAULT_MODES.items() if p in ALWAYS_ON or p in ("blind_retry", "duplicate_approval")}
_ARMED["blind_retry"] = "block"
_ARMED.pop("guardrail_bypass")


@query(
    "enforcement_fires",
    f"""WITH {_RESPONSES}, f AS (SELECT session, seq, text AS t FROM resp) """
    + " UNION ALL ".join(
        f"SELECT session, seq, {K.lit(p)} AS pattern, {K.lit(_ARMED[p])} AS mode, {str(_ARMED[p] == 'block').lower()} AS blocked FROM f WHERE {cond}"
        for p, cond in K.detector_fires("t")
        if p in _ARMED
    ),
)
def enforcement_fires(spark, sf):
    escalated = spark.sql("SELECT explode(array('blind_retry', 'duplicate_approval', 'stale_context')) AS pattern")
    overrides = spark.sql(
        "SELECT * FROM VALUES ('blind_retry', 'block'), ('guardrail_bypass', 'off') AS t(pattern, mode)"
    )
    armed = detectors.armed_modes(escalated, overrides)
    return detectors.enforce(responses(spark, sf), "text", ["session", "seq"], armed)


@query("turns", f"WITH {_TURNS} SELECT session, seq, type, turn_no FROM nt")
def turn_numbers(spark, sf):
    return turns.number_turns(transcript(spark, sf)).select("session", "seq", "type", "turn_no")


_TOOL = lambda p, flag="(?i)": (
    f"CAST(coalesce(sum(len(list_filter(string_split(tools, ','), lambda x: x <> '' AND regexp_matches(x, {K.lit(flag + p)})))), 0) AS BIGINT)"
)
_TURN_TABLE = f"""{_TURNS}, tt AS (SELECT session, turn_no, arg_max(text, seq) FILTER (trim(text) <> '') AS response,
 {_TOOL('', '')} AS n_tools, {_TOOL(RESEARCH_TOOL)} AS n_research, {_TOOL(GRAPH_TOOL, '')} AS n_graph,
 {_TOOL(GRAPH_WRITE_TOOL, '')} AS n_graph_write, {_TOOL(FORBIDDEN_TOOL_NAME)} AS n_forbidden
 FROM nt WHERE type = 'assistant' AND turn_no > 0 GROUP BY ALL)"""


@query("turn_summary", f"WITH {_TURN_TABLE} SELECT * FROM tt")
def turn_summary(spark, sf):
    return turns.summarize_turns(turns.number_turns(transcript(spark, sf)))


@query(
    "turn_rule_fires",
    f"""WITH {_TURN_TABLE}, f AS (
SELECT session, turn_no, 'silent_completion' AS pattern, 'block' AS mode FROM tt WHERE length(trim(response)) < 15 AND n_tools > 0
UNION ALL SELECT session, turn_no, 'graph_bypass', 'block' FROM tt WHERE n_research >= 2 AND n_graph = 0
UNION ALL SELECT session, turn_no, 'writeback_skipped', 'warn' FROM tt WHERE n_research >= 2 AND n_graph_write = 0 AND length(trim(response)) > 200 AND {K.re('response', DURABLE_CLAIM)}
UNION ALL SELECT session, turn_no, 'tool_misuse', 'warn' FROM tt WHERE n_forbidden > 0)
SELECT *, mode = 'block' AS blocked FROM f""",
)
def turn_rule_fires(spark, sf):
    table = turns.summarize_turns(turns.number_turns(transcript(spark, sf)))
    return detectors.turn_rule_fires(table, ["session", "turn_no"], {"tool_misuse": "warn"})


@query(
    "rated_turns",
    f"""WITH {_TURNS}, b AS (SELECT session, turn_no, trim(text, chr(10) || ' ') AS block, row_number() OVER (PARTITION BY session, turn_no ORDER BY seq DESC) AS rn
  FROM nt WHERE type = 'assistant' AND turn_no > 0 AND trim(text) <> ''),
j AS (SELECT session, turn_no, max(block) FILTER (rn = 1) AS l, max(block) FILTER (rn = 2) AS p FROM b WHERE rn <= 2 GROUP BY ALL),
w AS (SELECT session, turn_no + 1 AS turn_no, CASE WHEN length(l) < 120 AND p IS NOT NULL THEN concat(p, chr(10), chr(10), l) ELSE l END AS r FROM j)
SELECT nt.session, nt.turn_no, nt.text AS prompt, substring(r, 1, 2500) AS response FROM nt JOIN w USING (session, turn_no)
WHERE type = 'user' AND trim(text) <> '' AND length(r) >= 40""",
)
def rated_turns(spark, sf):
    return turns.rated_responses(turns.number_turns(transcript(spark, sf)))


@query(
    "recent_context",
    f"""WITH tr AS ({A.TRANSCRIPT}), s AS (SELECT session, seq, CASE WHEN type = 'user' THEN concat('User: ', substring(text, 1, 200))
  ELSE concat('Assistant: ', substring(text, 1, 150)) END AS line,
  row_number() OVER (PARTITION BY session ORDER BY seq DESC) AS rn FROM tr WHERE type IN ('user', 'assistant') AND trim(text) <> '')
SELECT session, string_agg(line, chr(10) ORDER BY seq) AS context FROM s WHERE rn <= 6 GROUP BY session""",
)
def recent_context(spark, sf):
    return turns.recent_context(transcript(spark, sf), 6)


_TRIM = "trim(text, chr(10) || ' ')"


@query(
    "session_signals",
    f"""WITH tr AS ({A.TRANSCRIPT}), a AS (SELECT session, seq, tools, {_TRIM} AS t FROM tr WHERE type = 'assistant'),
c AS (SELECT *, sum(length(t)) OVER (PARTITION BY session ORDER BY seq DESC) - length(t) AS later FROM a),
k AS (SELECT * FROM c WHERE later < 12000),
g AS (SELECT session, {_TOOL('', '')} AS n_tools, {_TOOL(SEED_RESEARCH_TOOL)} AS research_n, {_TOOL(SEED_WRITE_TOOL)} > 0 AS had_write,
  coalesce(right(string_agg(t, chr(10) || chr(10) ORDER BY seq) FILTER (t <> ''), 12000), '') AS tail FROM k GROUP BY session),
h AS (SELECT *, CAST(len(regexp_extract_all({K.fold('tail')}, {K.lit('(?i)' + SEED_DURABLE)})) AS INT) AS durable_hits FROM g)
SELECT *, NOT had_write AND length(trim(tail, chr(10) || ' ')) >= 280 AND durable_hits >= 3 AND (research_n >= 1 OR durable_hits >= 5) AS seed FROM h""",
)
def session_signals(spark, sf):
    return turns.session_signals(transcript(spark, sf))


@query(
    "turn_evidence",
    f"""WITH {_TURNS} SELECT session, turn_no, right(string_agg(substring(text, 1, 2000), chr(10) || '---' || chr(10) ORDER BY seq), 12000) AS evidence
FROM nt WHERE type = 'tool_result' GROUP BY ALL""",
)
def turn_evidence(spark, sf):
    return turns.turn_evidence(turns.number_turns(transcript(spark, sf)))


@query(
    "turns_with_evidence",
    f"""WITH {_TURN_TABLE}, ev AS (SELECT session, turn_no, right(string_agg(substring(text, 1, 2000), chr(10) || '---' || chr(10) ORDER BY seq), 12000) AS evidence
 FROM nt WHERE type = 'tool_result' GROUP BY ALL)
SELECT session, turn_no, response, n_tools, coalesce(evidence, '') AS evidence FROM tt LEFT JOIN ev USING (session, turn_no) WHERE turn_no > 0""",
)
def turns_with_evidence(spark, sf):
    numbered = turns.number_turns(transcript(spark, sf))
    return turns.turns_with_evidence(numbered).select("session", "turn_no", "response", "n_tools", "evidence")


@query(
    "cost_proxy",
    f"""WITH tr AS ({A.TRANSCRIPT}), p AS (SELECT session, count(*) FILTER (text <> '') AS messages, {_TOOL('', '')} AS tool_calls,
 CAST(sum(length(text)) AS BIGINT) AS chars FROM tr GROUP BY session)
SELECT *, round(tool_calls / greatest(messages, 1), 4) AS ratio, round(tool_calls / greatest(messages, 1), 4) > 3 AS over_asserting,
 CAST(tool_calls * 200 + floor(chars / 4) AS BIGINT) AS score FROM p ORDER BY score DESC, session LIMIT 10""",
)
def cost_proxy(spark, sf):
    return turns.cost_proxy(transcript(spark, sf))


# --- prompts -------------------------------------------------------------------------

_P = "trim(prompt, chr(10) || ' ')"
_PLAIN = f"""regexp_replace(lower({_P}), '[.!?,''"]', '', 'g')"""


@query(
    "prompt_routes",
    f"""WITH p AS ({A.PROMPTS}), n AS (SELECT *, {_P} AS t, {_PLAIN} AS plain,
 trim(regexp_extract({_P}, '^(10|[1-9])(?:\\s*[-:]\\s*|\\s+)?(.*)$', 2)) AS rest FROM p),
m AS (SELECT *, regexp_matches(t, '^(10|[1-9])(?:\\s*[-:]\\s*|\\s+)?(.*)$') AND NOT regexp_matches(regexp_replace(t, {K.lit(RATING_NUMBER)}, ''), {K.lit(RATING_BAD_SUFFIX)})
 AND NOT {K.re('rest', RATING_SENTENCE)} AS is_rating FROM n)
SELECT conv_id, turn, CASE WHEN is_rating THEN CAST(regexp_extract(t, '^(10|[1-9])', 1) AS INT) END AS rating,
 CASE WHEN is_rating AND rest <> '' THEN rest END AS comment,
 CASE WHEN {K.in_list('plain', PRAISE_WORDS + PRAISE_PHRASES)} OR (len(regexp_split_to_array(plain, '\\s+')) = 2
  AND len(list_filter(regexp_split_to_array(plain, '\\s+'), lambda x: {K.in_list('x', PRAISE_WORDS)})) = 2) THEN 8 END AS praise,
 {K.any_of('t', SYSTEM_TEXT)} AS is_system, length(prompt) < 3 AS too_short FROM m""",
)
def prompt_routes(spark, sf):
    p = F.col("prompt")
    rated = A.view(spark, sf, A.PROMPTS).withColumn("_r", capture.explicit_rating(p))
    return rated.select(
        "conv_id",
        "turn",
        "_r.rating",
        "_r.comment",
        capture.praise_rating(p).alias("praise"),
        capture.is_system_text(p).alias("is_system"),
        capture.is_too_short(p).alias("too_short"),
    )


_IMPLICIT = """
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE CAST(1 + doc_id % 10 AS INT) END AS rating,
 CAST((doc_id % 4) / 4.0 AS DOUBLE) AS confidence, text AS response FROM {documents}
"""


@query(
    "implicit_routes",
    f"""WITH d AS ({_IMPLICIT}) SELECT doc_id, CASE WHEN rating IS NOT NULL AND confidence >= 0.5 THEN 'keep'
 WHEN length(trim(response, chr(10) || ' ')) >= 200 THEN 'judge' ELSE 'drop' END AS route, length(substring(response, 1, 3000)) AS kept FROM d""",
)
def implicit_routes(spark, sf):
    df = A.view(spark, sf, _IMPLICIT)
    route = capture.implicit_route(F.col("rating"), F.col("confidence"), F.col("response"))
    return df.select("doc_id", route.alias("route"), F.length(capture.judge_response(F.col("response"))).alias("kept"))


_SKILL_TURNS = f"""
SELECT event_id, {A.case("event_id % 6", ["/review the diff", "please use skill bq here", "run `/deploy` then /bq",
   "<command-name>/jira</command-name> look", "plain words only", "the command dataform and the skill the"])} AS prompt,
 CASE WHEN event_id % 5 = 0 THEN 'Terraform' ELSE '' END AS skill_input,
 CASE WHEN event_id % 4 = 0 THEN 'deploy' WHEN event_id % 4 = 1 THEN 'unknown' ELSE '' END AS command_input,
 {A.case("event_id % 3", ["Bash", "Edit", "bigquery_run"])} AS tool,
 {A.case("event_id % 7", ["/srv/definitions/x.sqlx", "/srv/infra/main.tf", "/home/dev/.claude/commands/bq.md", "/srv/a.txt",
   "/srv/dags/load.py", "/srv/.github/ci.yml", "/home/dev/.claude/commands/Ship-It.md"])} AS file
FROM {{events}}
"""
_KNOWN = ["review", "bq", "deploy", "jira"]


def _skill_sql() -> str:
    m = lambda pos, src: f"SELECT event_id, {pos} AS src, unnest({src}) AS raw, generate_subscripts({src}, 1) AS i FROM s"
    ex = lambda text, pattern: f"regexp_extract_all({text}, {K.lit('(?i)' + pattern)}, 1)"
    known = K.in_list("x", _KNOWN)
    blob = "concat(file, chr(10), tool, chr(10), '', chr(10), prompt)"
    paths = " UNION ALL ".join(
        f"SELECT event_id, {6 + n} AS src, {K.lit(s)} AS raw, 1 AS i FROM s WHERE {K.re(blob, p)}"
        for n, (s, p) in enumerate(PATH_SKILLS)
    )
    ment = " UNION ALL ".join([
        m(0, "list_filter([skill_input], lambda x: x <> '')"),
        m(1, ex("prompt", r"<command-name>\s*/?([a-z][\w-]*)") + "[1:1]"),
        m(2, ex("trim(prompt)", r"^/([a-z][\w-]*)")),
        m(3, f"list_filter({ex('prompt', r'(?:^|[\s`])/([a-z][\w-]*)')}, lambda x: {known})"),
        m(4, ex("prompt", r"""\b(?:skill|command)\s+["'`]?([a-z][\w-]*)""")),
        m(5, f"list_filter([command_input], lambda x: {known})"),
        paths,
        m(90, ex("file", r"\.claude/commands/([a-z][\w-]*)\.md$")),
    ])
    return f"""WITH s AS ({_SKILL_TURNS}), ment AS ({ment}),
clean AS (SELECT event_id, src * 1000 + i AS pos, lower(raw) AS name FROM ment WHERE regexp_matches(lower(raw), '^[a-z][\\w-]*$')
  AND NOT {K.in_list('lower(raw)', SKILL_STOPWORDS)}),
lastm AS (SELECT event_id, name, max(pos) AS pos FROM clean GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY pos DESC) AS rn, row_number() OVER (PARTITION BY event_id ORDER BY pos) AS fw FROM lastm),
prim AS (SELECT event_id, coalesce(arg_min(name, fw) FILTER ({K.in_list('name', _KNOWN)}), arg_min(name, fw) FILTER ({K.in_list('name', [s for s, _ in PATH_SKILLS])}), arg_min(name, fw)) AS skill
  FROM ranked GROUP BY event_id),
cand AS (SELECT event_id, string_agg(name, ',' ORDER BY pos) AS candidates FROM ranked WHERE rn <= 8 GROUP BY event_id)
SELECT s.event_id, coalesce(candidates, '') AS candidates, coalesce(skill, 'general-session') AS skill
FROM s LEFT JOIN cand USING (event_id) LEFT JOIN prim USING (event_id)"""


@query("skill_attribution", _skill_sql())
def skill_attribution(spark, sf):
    df = A.view(spark, sf, _SKILL_TURNS)
    one = lambda c: F.filter(F.array(c), lambda x: x != "")
    found = capture.harvest_skills(
        F.col("prompt"), one("skill_input"), one("command_input"), F.array("tool"), F.array("file"),
        F.lit(""), F.col("prompt"), _KNOWN,
    )
    df = df.withColumn("_c", found)
    return df.select(
        "event_id", F.array_join("_c", ",").alias("candidates"), capture.primary_skill(F.col("_c"), _KNOWN).alias("skill")
    )


# --- tool calls ------------------------------------------------------------------------

RULES = [
    policy.Rule("trusted", r"^ls\b"),
    policy.Rule("blocked", r"rm\s+-rf\s+/", "wipes the root"),
    policy.Rule("blocked", r"git\s+push\s+.*--force", "force push"),
    policy.Rule("confirm", r"bq\s+rm\b", "destructive remove"),
    policy.Rule("confirm", r"gh\s+pr\s+(review|comment|create|merge|edit)\b", "review change"),
    policy.Rule("confirm", r"git\s+push\b", "push to remote"),
    policy.Rule("confirm", r"terraform\s+apply\b", "apply"),
    policy.Rule("alert", r"sudo\b", "elevated"),
]
PATH_RULES = [
    policy.Rule("zeroAccess", "~/.ssh"),
    policy.Rule("readOnly", "/srv/app/docs/*.md"),
    policy.Rule("confirmWrite", "~/.agent/settings.json"),
    policy.Rule("confirmWrite", "/srv/**/lesson_*.md"),
    policy.Rule("noDelete", "~/.agent/memory"),
]
HOME = "/home/dev"


@query(
    "policy_verdicts",
    f"""WITH t AS ({A.TOOL_CALLS}), c AS (SELECT event_id, regexp_replace(command, {K.lit(ENV_PREFIX)}, '') AS c FROM t)
SELECT event_id, CASE WHEN {K.re('c', RULES[0].pattern)} THEN 'allow' """
    + " ".join(f"WHEN {K.re('c', r.pattern)} THEN '{policy.COMMAND_TIERS[r.tier].replace('blocked', 'block')}'" for r in RULES[1:])
    + f" ELSE 'allow' END AS verdict, CASE WHEN {K.re('c', RULES[0].pattern)} THEN NULL "
    + " ".join(f"WHEN {K.re('c', r.pattern)} THEN {K.lit(r.reason)}" for r in RULES[1:])
    + " END AS reason FROM c",
)
def policy_verdicts(spark, sf):
    return policy.policy_verdict(A.view(spark, sf, A.TOOL_CALLS), RULES).select("event_id", "verdict", "reason")


@query(
    "path_verdicts",
    f"""WITH t AS ({A.TOOL_CALLS}), v AS (SELECT event_id, action, CASE
 WHEN file_path = '/home/dev/.ssh' OR starts_with(file_path, '/home/dev/.ssh/') THEN 'block|Zero access path: ~/.ssh'
 WHEN action IN ('write', 'delete') AND regexp_matches(file_path, '^/srv/app/docs/[^/]*\\.md$') THEN 'block|Read-only path: /srv/app/docs/*.md'
 WHEN action = 'write' AND file_path = '/home/dev/.agent/settings.json' THEN 'confirm|Writing to protected file requires confirmation: ~/.agent/settings.json'
 WHEN action = 'write' AND regexp_matches(file_path, '^/srv/.*/lesson_[^/]*\\.md$') THEN 'confirm|Writing to protected file requires confirmation: /srv/**/lesson_*.md'
 WHEN action = 'delete' AND starts_with(file_path, '/home/dev/.agent/memory/') THEN 'block|Cannot delete protected path: ~/.agent/memory' ELSE 'allow' END AS x FROM t)
SELECT event_id, action, split_part(x, '|', 1) AS verdict, CASE WHEN contains(x, '|') THEN split_part(x, '|', 2) END AS reason FROM v""",
)
def path_verdicts(spark, sf):
    return policy.path_verdict(A.view(spark, sf, A.TOOL_CALLS), PATH_RULES, HOME).select("event_id", "action", "verdict", "reason")


@query(
    "surface_allowed",
    f"""WITH t AS ({A.TOOL_CALLS}) SELECT event_id, file_path,
 (file_path LIKE '/srv/%.md' OR file_path LIKE '/home/dev/.agent/%') AND NOT file_path LIKE '%/settings.json' AS allowed FROM t""",
)
def surface_allowed(spark, sf):
    allow = [
        {"glob": "/srv/*.md", "who": ["curator"]},
        {"glob": "~/.agent/*"},
        {"glob": "/srv/app/*", "who": ["someone-else"]},
    ]
    ok = policy.surface_allowed(F.col("file_path"), allow, ["*/settings.json"], HOME, actor="curator")
    return A.view(spark, sf, A.TOOL_CALLS).select("event_id", "file_path", ok.alias("allowed"))


@query(
    "tool_event_flags",
    f"""WITH t AS ({A.TOOL_CALLS}) SELECT event_id,
 {K.re('command', GIT_PUSH, False)} AND NOT contains(command, 'no-mistakes') AND NOT {K.re('command', PROMOTION_BRANCH, False)} AS push_blocked,
 contains(file_path, '.github/workflows/') AND (file_path LIKE '%.yml' OR file_path LIKE '%.yaml') AND regexp_matches(content, '(?i)notify_teams_channel.*bigbrother') AS workflow_blocked,
 contains(command, 'git push') OR contains(command, 'gh pr create') AS pr_text_reminder,
 contains(command, 'gh stack') OR contains(command, 'gh-stack') AS stacked_reminder,
 contains(command, 'gh pr view') OR contains(command, 'pr comments') OR contains(file_path, 'CLAUDE.md') AS feedback_reminder,
 (contains(lower(tool_name), 'write') OR contains(lower(tool_name), 'edit')) AND coalesce(file_path, '') <> '' AS verify_reminder,
 {K.re('command', APPROVAL_COMMAND, False)} AS is_approval FROM t""",
)
def tool_event_flags(spark, sf):
    return policy.tool_event_flags(A.view(spark, sf, A.TOOL_CALLS)).select(
        "event_id", "push_blocked", "workflow_blocked", "pr_text_reminder", "stacked_reminder", "feedback_reminder", "verify_reminder", "is_approval"
    )


@query(
    "ungrounded_symbols",
    f"""WITH t AS ({A.TOOL_CALLS}), s AS (SELECT DISTINCT event_id, unnest(regexp_extract_all(content, {K.lit(SYMBOL)})) AS symbol FROM t)
SELECT event_id, symbol FROM s WHERE symbol NOT IN ('TokenHelper')""",
)
def ungrounded_symbols(spark, sf):
    calls = A.view(spark, sf, A.TOOL_CALLS)
    known = calls.select(F.explode(symbols(F.col("content"))).alias("symbol")).where("symbol = 'TokenHelper'")
    return policy.ungrounded_symbols(calls, ["event_id"], "content", known)


# Approvals every few seconds: event ids stand in for arrival order.
_APPROVALS = """
SELECT event_id, CAST(event_id % 3 AS STRING) AS host, event_id * 4 + CAST(floor(value) AS BIGINT) % 3 AS at_s FROM {events}
"""


@query(
    "rate_limited",
    f"""WITH RECURSIVE e AS ({_APPROVALS}), o AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY at_s, event_id) AS n FROM e),
w(host, n, event_id, allowed, clock) AS (SELECT host, n, event_id, true, at_s FROM o WHERE n = 1
 UNION ALL SELECT o.host, o.n, o.event_id, o.at_s - w.clock >= 10, CASE WHEN o.at_s - w.clock >= 10 THEN o.at_s ELSE w.clock END
 FROM w JOIN o ON o.host = w.host AND o.n = w.n + 1)
SELECT event_id, allowed FROM w""",
)
def rate_limited(spark, sf):
    df = A.view(spark, sf, _APPROVALS)
    return ratelimit.rate_limited(df, "host", "at_s", "event_id", gap=10, bucket=21600).select("event_id", "allowed")


_LINES = """
SELECT conv_id, turn, role, text, row_number() OVER (ORDER BY conv_id, turn) - 1 AS line FROM {conversations}
"""


@query(
    "transcript_lines",
    f"""SELECT line AS seq, role AS type, concat('/c', CAST(conv_id AS VARCHAR)) AS cwd, text FROM ({_LINES}) WHERE line % 13 <> 4""",
)
def transcript_lines(spark, sf):
    """All conversations written as one transcript file of odd lines (plain texts, blocks, broken ones) and read back."""
    view = A.view(spark, sf, "SELECT conv_id, turn, role, text FROM {conversations}")
    placed = prefix_sums(view, [], ["conv_id", "turn"], {"line": F.lit(1).cast("long")}).withColumn("line", F.col("line") - 1)
    block = F.array(F.struct(F.lit("text").alias("type"), F.col("text")))
    common = [F.col("role").alias("type"), F.concat(F.lit("/c"), F.col("conv_id").cast("string")).alias("cwd")]
    plain = F.to_json(F.struct(*common, F.struct(F.col("text").alias("content")).alias("message")))
    blocks = F.to_json(F.struct(*common, F.struct(block.alias("content")).alias("message")))
    line = F.when(F.col("line") % 13 == 4, F.concat(F.lit("{broken "), F.col("role"))).when(F.col("line") % 3 == 0, blocks).otherwise(plain)
    path = f"{ensure_checkpoint_dir(spark)}/transcript-{uuid.uuid4().hex}"
    placed.orderBy("line").coalesce(1).select(line.alias("value")).write.text(path)
    return readers.read_transcripts(spark, path).select("seq", "type", "cwd", "text")
