"""Logical tables of the engine as views over the bundled test tables.

The test text makes no claims of its own, so the views add deterministic phrases and
labels by row id.  Each view is one SQL text that Spark and the SQL checker both accept;
``{events}`` and the like stand for the input tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Twelve response phrases, chosen by a row number modulo twelve.
PHRASES = [
    "All work is done and the fix is deployed.",
    "Fixed. Ran pytest: 12 tests passed, output attached.",
    "I think the column is probably there.",
    "Posted the comment, see https://example.org/c/1",
    "Still fails, let me try again.",
    "Root cause is a missing filter, retrying now. I checked src/job.py",
    "Looks unrelated, no changes needed.",
    "I approved the PR again just in case.",
    "Renamed it across all files.",
    "The table has 5000 rows.",
    "Here is a plan for tomorrow.",
    "Same issue here, that will work.",
]


def case(number: str, values: list[str]) -> str:
    """CASE that maps ``number`` (0, 1, ...) to the listed texts."""
    arms = " ".join("WHEN {} THEN '{}'".format(i, v.replace("'", "''")) for i, v in enumerate(values))
    return f"CASE {number} {arms} END"


TAXONOMY = {
    "unverified_completion": ["claimed"],
    "blind_retry": ["repeated the same"],
    "tool_misuse": ["wrong tool"],
    "scope_misunderstanding": ["misunderstood"],
    "stale_context": ["outdated"],
}

LESSONS = """
SELECT * FROM (VALUES ('unverified_completion','2024-01-10'),('blind_retry','2024-01-15'),
 ('tool_misuse','2024-01-20'),('scope_misunderstanding','2024-01-12'),('stale_context','2024-01-20'),
 ('wrong_env_promotion','2024-01-15'),('missing_dependency','2024-01-31'),
 ('redundant_recommendation','2024-02-05')) AS t(pattern, baseline_date)
"""

RATINGS = f"""
SELECT event_id, ts, event_date, replace(substring(CAST(ts AS STRING), 1, 19), ' ', 'T') AS timestamp,
 CAST(user_id AS STRING) AS session_id,
 CAST(1 + (CAST(floor(value) AS BIGINT) + event_id) % 10 AS INT) AS rating,
 CASE WHEN event_id % 5 = 0 THEN 'explicit' ELSE 'implicit' END AS source,
 CASE event_type WHEN 'click' THEN 'bq' WHEN 'error' THEN 'review' WHEN 'purchase' THEN 'dataform'
   WHEN 'view' THEN 'general-session' ELSE '' END AS skill,
 CASE WHEN event_id % 9 = 0 THEN 'review' WHEN event_id % 9 = 1 THEN 'bq' ELSE '' END AS second_skill,
 {case("event_id % 4", ["cli", "editor", "web", ""])} AS agent,
 {case("event_id % 3", ["core", "infra", "site"])} AS repo,
 {case("event_id % 5", ["Bash", "Grep", "Edit", "Read", "Write"])} AS tool,
 CAST(CASE WHEN event_id % 13 = 0 THEN 0.0 ELSE 0.9 END AS DOUBLE) AS confidence,
 CASE sk WHEN 0 THEN 'claimed completion too early' WHEN 1 THEN 'repeated the same failing action'
   WHEN 2 THEN 'wrong tool used' WHEN 3 THEN 'misunderstood the request scope' WHEN 4 THEN 'good work'
   WHEN 5 THEN 'outdated diff quoted' WHEN 6 THEN 'fine' END AS sentiment_summary,
 {case("(event_id * 5 + user_id) % 12", PHRASES)} AS response_preview
FROM (
 SELECT *, CASE
   WHEN event_id % 7 = 1 AND event_date >= '2024-01-15' AND event_id % 3 <> 0 THEN 6
   WHEN event_id % 7 = 5 AND event_date >= '2024-01-20' THEN 6
   WHEN event_id % 7 = 2 AND event_date < '2024-01-20' AND event_id % 2 = 0 THEN 6
   WHEN event_id % 7 = 3 AND event_date >= '2024-01-12' AND event_id % 4 = 0 THEN 6
   ELSE event_id % 7 END AS sk
 FROM (SELECT event_id, ts, CAST(CAST(ts AS DATE) AS STRING) AS event_date, user_id, value, event_type
       FROM {{events}}) b
) k
"""

# Judge rows: one per labelled document and label, failed when the flag is 0.
JUDGED = """
SELECT CAST(CAST(date_add(DATE '2024-01-01', CAST(doc_id % 30 AS INT)) AS DATE) AS STRING) AS timestamp,
 CAST(doc_id AS STRING) AS session_id, 'wrong_env_promotion' AS pattern, quality = 1 AS passed FROM {labels}
UNION ALL
SELECT CAST(CAST(date_add(DATE '2024-01-01', CAST(doc_id % 30 AS INT)) AS DATE) AS STRING),
 CAST(doc_id AS STRING), 'redundant_recommendation', toxic = 0 FROM {labels}
"""

JUDGE_VOTES = """
SELECT CAST(user_id AS STRING) AS session_id, CAST(CAST(ts AS DATE) AS STRING) AS timestamp,
 CAST(event_id % 3 AS INT) AS pass_no, event_type AS pattern, value > 12 AS flagged,
 concat('event ', CAST(event_id AS STRING)) AS evidence
FROM {events}
"""

TRANSCRIPT = f"""
SELECT CAST(conv_id AS STRING) AS session, turn * 3 AS seq, role AS type,
 CASE WHEN role = 'assistant' AND (conv_id + turn) % 7 = 0 THEN 'ok.'
   WHEN role = 'assistant' THEN concat(text, ' ', {case("(conv_id * 5 + turn) % 12", PHRASES)})
   ELSE text END AS text,
 CASE WHEN role = 'assistant' THEN {case("(conv_id * 3 + turn) % 5", [
     "Grep,WebSearch,Bash", "mcp__graphiti-memory__search_nodes,Grep,Glob",
     "Edit", "", "WebFetch,Task,mcp__jira-context__get"])} ELSE '' END AS tools
FROM {{conversations}}
UNION ALL
SELECT CAST(conv_id AS STRING), turn * 3 + 1, 'user', '', '' FROM {{conversations}} WHERE role = 'assistant'
UNION ALL
SELECT CAST(conv_id AS STRING), turn * 3 + 2, 'tool_result', concat('result ', CAST(turn AS STRING), ': ', text), ''
FROM {{conversations}} WHERE role = 'assistant' AND turn % 4 <> 3
"""

PROMPTS = f"""
SELECT conv_id, turn, CASE WHEN turn >= 2 THEN {case("(conv_id + turn) % 9", [
    "7", "8 - good work", "10/10", "3 items", "Great job!", "7th thing", "10: nice", "2 of them fail", "Perfect, thanks"])}
  ELSE text END AS prompt
FROM {{conversations}} WHERE role = 'user'
"""

ENFORCEMENT = """
SELECT ts, CAST(user_id AS STRING) AS session, event_type AS pattern,
 CASE WHEN event_id % 3 = 0 THEN 'block' ELSE 'warn' END AS mode, event_id % 3 = 0 AS blocked, event_id
FROM {events}
"""

COMMANDS = [
    "git push origin feature-x", "LANG=C rm -rf /tmp/build && rm -rf /", "ls -la", "gh pr review 12 --approve",
    "bq rm dataset.old", "sudo make install", "git push origin master", "FOO=\"a b\" terraform apply",
]
PATHS = [
    "/home/dev/.ssh/id_ed25519", "/srv/app/main.py", "/home/dev/.agent/settings.json", "/home/dev/.agent/memory/a.md",
    "/srv/app/.github/workflows/deploy.yml", "/srv/notes/lesson_autogen_retry.md", "/srv/app/docs/README.md",
]

TOOL_CALLS = f"""
SELECT event_id, ts, CAST(user_id AS STRING) AS session_id, 'Bash' AS tool_name,
 {case("event_id % 8", COMMANDS)} AS command,
 {case("event_id % 7", PATHS)} AS file_path,
 {case("event_id % 3", ["read", "write", "delete"])} AS action,
 {case("event_id % 4", ["uses: notify_teams_channel: bigbrother", "class JobFactory(BaseSensor): pass",
                        "plain text", "TokenHelper and TokenHelper, RetryManager"])} AS content
FROM {{events}}
"""

QUEUE = """
SELECT o_orderkey AS record_id, o_orderpriority AS pattern, CAST(CAST(o_orderdate AS DATE) AS STRING) AS detected_at,
 CAST(round(o_totalprice / 1000000 - 0.2, 4) AS DOUBLE) + 0.0 AS delta, CAST(o_orderkey % 50 AS INT) AS after_n,
 CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'approved' ELSE 'rejected' END AS status,
 CASE o_custkey % 5 WHEN 0 THEN 'base' WHEN 1 THEN 'lesson_dedup' WHEN 2 THEN 'lesson_evolve'
   WHEN 3 THEN 'pattern_promotion' ELSE 'manual' END AS source,
 CAST(NULL AS STRING) AS reviewed_at, CAST(NULL AS STRING) AS reviewer
FROM {orders}
"""
QUEUE_AS_OF = "2001-08-05"

EDITS = """
SELECT skill, pattern, applied, status, CAST(base AS DOUBLE) AS baseline_fail_rate FROM (VALUES ('bq','blind_retry','2024-01-08','active',0.45),('bq','tool_misuse','2024-01-02','reverted',0.40),
 ('review','unverified_completion','2024-01-12','active',0.95),('dataform','stale_context','2024-01-20','active',0.20),
 ('airflow','blind_retry','2024-01-03','active',0.50),('terraform','tool_misuse','2024-01-25','active',0.50),
 ('review','scope_misunderstanding','2024-01-05','stalled',0.30),('jira','tool_misuse','2024-01-01','stalled',0.30))
 AS t(skill, pattern, applied, status, base)
"""

NODES = """
SELECT concat('region_', CAST(r_regionkey AS STRING)) AS id, r_name AS label, 'region' AS file_type, 'region.tbl' AS source_file FROM {region}
UNION ALL SELECT concat('nation_', CAST(n_nationkey AS STRING)), n_name, 'nation', 'nation.tbl' FROM {nation}
UNION ALL SELECT concat('supplier_', CAST(s_suppkey AS STRING)), s_name, 'supplier',
  CASE WHEN s_suppkey % 4 = 0 THEN 'supplier_b.tbl' ELSE 'supplier_a.tbl' END FROM {supplier}
UNION ALL SELECT concat('customer_', CAST(c_custkey AS STRING)), c_name, 'customer', 'customer.tbl' FROM {customer}
"""

EDGES = """
SELECT concat('nation_', CAST(n_nationkey AS STRING)) AS source, concat('region_', CAST(n_regionkey AS STRING)) AS target,
  'in_region' AS relation, 'EXTRACTED' AS confidence, CAST(1.0 AS DOUBLE) AS confidence_score FROM {nation}
UNION ALL SELECT concat('supplier_', CAST(s_suppkey AS STRING)), concat('nation_', CAST(s_nationkey AS STRING)),
  'supplies_from', CASE WHEN s_suppkey % 3 = 0 THEN 'AMBIGUOUS' ELSE 'INFERRED' END,
  CAST((2 + s_suppkey % 7) / 10.0 AS DOUBLE) FROM {supplier}
UNION ALL SELECT concat('customer_', CAST(c_custkey AS STRING)), concat('nation_', CAST(c_nationkey AS STRING)),
  'buys_from', 'EXTRACTED', CASE WHEN c_custkey % 100 = 0 THEN 0.5 ELSE 1.0 END FROM {customer} WHERE c_custkey % 10 <> 0
"""

FILES_NOW = """
SELECT concat(url, '#', CAST(page_id AS STRING)) AS path, CAST(page_id * 10 AS DOUBLE) AS mtime, CAST(length(html) AS BIGINT) AS size FROM {pages}
"""
FILES_BEFORE = """
SELECT concat(url, '#', CAST(page_id AS STRING)) AS path, CAST(page_id * 10 AS DOUBLE) + CASE WHEN page_id % 11 = 0 THEN 0.5 ELSE 0 END AS mtime,
 CAST(length(html) + CASE WHEN page_id % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS size
FROM {pages} WHERE page_id % 10 <> 0
"""

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run a view text over the tables it names."""
    used = [t for t in TABLES if "{" + t + "}" in sql]
    return spark.sql(sql, **tables(spark, sf_dir, *used)) if used else spark.sql(sql)


def checker_sql(sql: str) -> str:
    """The same text for the SQL checker, where tables carry their own names."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql
