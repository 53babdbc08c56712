"""Report queries over ratings and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.fixed_values import (
    REVIEW_TAXONOMY,
    ALGORITHM_WORDS,
    CONSTRAINT_MARKERS,
    HOW_MARKERS,
    INTENT_MARKERS,
    JUNK_PATTERNS,
    LEARNING_WORDS,
    RULE_ARTIFACT,
    RULE_GENERIC_AVOID,
    RULE_HOLLOW,
    RULE_IMPERATIVE,
    RULE_SEQUENCE,
    RULE_STUB,
    SEED_DURABLE,
    SLUDGE,
    STOPWORDS_LESSONS,
    SYSTEM_WORDS,
)
from feedloom.functions import checks
from feedloom.functions import lessons as lesson_text
from feedloom.functions import text as T
from feedloom.operators import classify, reports
from feedloom.plans import adapters as A
from feedloom.plans import checker as K
from feedloom.plans.queries_measure import ratings
from feedloom.plans.registry import query
from feedloom.scale import keep_last

R = K.RATINGS_CTE


def full_ratings(spark, sf):
    """Ratings with the array columns of the log."""
    df = ratings(spark, sf)
    return df.withColumn("skill_candidates", F.array_distinct(F.filter(F.array("skill", "second_skill"), lambda s: s != "")))


@query("classified_ratings", f"WITH {R} SELECT event_id, pattern FROM rp")
def classified_ratings(spark, sf):
    return ratings(spark, sf).select("event_id", F.explode("patterns").alias("pattern"))


# A pattern of the part table for each brand; keywords are whole and partial names, and two of less than a gram.
_PART_TAXONOMY = """
SELECT p_brand AS pattern, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN concat(p_name, ' ', CAST(p_size AS STRING)) ELSE substring(p_name, 3, 8) END AS keyword,
 CAST(p_partkey AS INT) AS ord FROM {part} UNION ALL SELECT 'short', 'ok', -1 FROM {region} WHERE r_regionkey = 0 UNION ALL SELECT 'short', 'hot', -1 FROM {region} WHERE r_regionkey = 1
"""
_PART_TEXTS = """
SELECT e.event_id, concat('Saw ', coalesce(p_name, ''), ' ', CAST(e.user_id % 50 AS STRING), ' by ', event_type) AS comment
FROM {events} e LEFT JOIN {part} p ON p.p_partkey = e.event_id % 2300
"""


@query(
    "classified_by_table",
    f"""WITH t AS ({_PART_TAXONOMY}), e AS (SELECT event_id, lower(comment) AS x FROM ({_PART_TEXTS})), d AS (SELECT DISTINCT pattern, keyword FROM t),
hit AS (SELECT DISTINCT x, pattern FROM (SELECT DISTINCT x FROM e) JOIN d ON contains(x, keyword)), o AS (SELECT pattern, min(ord) AS place FROM t GROUP BY 1),
l AS (SELECT x, string_agg(pattern, ',' ORDER BY place, pattern) AS patterns FROM hit JOIN o USING (pattern) GROUP BY x)
SELECT event_id, coalesce(patterns, 'other') AS patterns FROM e LEFT JOIN l USING (x)""",
)
def classified_by_table(spark, sf):
    out = classify.classify(A.view(spark, sf, _PART_TEXTS), A.view(spark, sf, _PART_TAXONOMY))
    return out.select("event_id", F.array_join("patterns", ",").alias("patterns"))


_RECLASS = """
SELECT CAST(user_id AS STRING) AS session_id, replace(substring(CAST(ts AS STRING), 1, 19), ' ', 'T') AS timestamp,
 CASE WHEN value > 15 THEN 'relabelled_high' ELSE 'relabelled_low' END AS pattern, event_id AS seq
FROM {events} WHERE event_id % 6 = 0
"""


@query(
    "classified_with_overrides",
    f"""WITH {R}, o AS (SELECT session_id, timestamp, arg_max(pattern, seq) AS pattern FROM ({_RECLASS}) GROUP BY ALL)
SELECT rp.event_id, coalesce(o.pattern, rp.pattern) AS pattern FROM rp LEFT JOIN o USING (session_id, timestamp) GROUP BY ALL""",
)
def classified_with_overrides(spark, sf):
    reclass = A.view(spark, sf, _RECLASS).withColumn("patterns", F.array("pattern"))
    base = A.view(spark, sf, A.RATINGS).withColumn("tools_used", F.array("tool"))
    out = classify.classify(base, A.TAXONOMY, reclass)
    return out.select("event_id", F.explode("patterns").alias("pattern"))


_REVIEW = ", ".join(
    "CASE WHEN " + " OR ".join(f"contains(t, {K.lit(w)})" for w in words) + f" THEN '{p}' END" for p, words in REVIEW_TAXONOMY.items()
)


@query(
    "source_classification",
    f"""WITH r AS ({A.RATINGS}), x AS (SELECT event_id, lower(concat(sentiment_summary, ' ', '', ' ', response_preview)) AS t FROM r),
p AS (SELECT event_id, concat_ws(',', {_REVIEW}) AS patterns FROM x)
SELECT event_id, CASE WHEN patterns = '' THEN 'other' ELSE patterns END AS patterns FROM p""",
)
def source_classification(spark, sf):
    out = classify.classify_for_source(A.view(spark, sf, A.RATINGS), "pr_review", A.TAXONOMY)
    return out.select("event_id", F.array_join("patterns", ",").alias("patterns"))


@query(
    "pattern_stats",
    f"""WITH {R}, n AS (SELECT count(*) AS n FROM r WHERE rating <= 4),
g AS (SELECT pattern, count(*) AS n, round(avg(rating), 4) AS avg_rating FROM rp WHERE rating <= 4 GROUP BY pattern)
SELECT g.*, round(g.n / n.n, 4) AS share_of_low, CASE WHEN pattern = 'other' THEN 'skip_unclassified' WHEN g.n < 2
 THEN concat('skip_count_', g.n) ELSE 'lesson_written' END AS action FROM g, n""",
)
def pattern_stats(spark, sf):
    return reports.pattern_stats(ratings(spark, sf))


@query("rating_distribution", f"WITH r AS ({A.RATINGS}) SELECT rating, count(*) AS n FROM r GROUP BY rating")
def rating_distribution(spark, sf):
    return reports.rating_distribution(A.view(spark, sf, A.RATINGS))


@query(
    "rating_overview",
    f"""WITH r AS ({A.RATINGS}) SELECT count(*) AS n, round(avg(rating), 4) AS avg_rating, count(*) FILTER (rating <= 4) AS low_n,
 round(count(*) FILTER (rating <= 4) / count(*), 4) AS low_share FROM r""",
)
def rating_overview(spark, sf):
    return reports.rating_overview(A.view(spark, sf, A.RATINGS))


@query(
    "skill_concentration",
    f"""WITH r AS ({A.RATINGS}) SELECT skill, count(*) FILTER (rating <= 4) AS low_n, count(*) AS total_n, round(avg(rating) FILTER (rating <= 4), 4) AS avg_low
FROM r WHERE skill <> '' GROUP BY skill HAVING low_n > 0 ORDER BY low_n DESC, skill LIMIT 10""",
)
def skill_concentration(spark, sf):
    return reports.skill_concentration(A.view(spark, sf, A.RATINGS))


@query(
    "where_it_happens",
    f"""WITH {R}, f AS (SELECT pattern, 'repo' AS facet, repo AS value FROM rp WHERE rating <= 4 UNION ALL
 SELECT pattern, 'skill', skill FROM rp WHERE rating <= 4 UNION ALL SELECT pattern, 'tool', tool FROM rp WHERE rating <= 4),
c AS (SELECT pattern, facet, value, count(*) AS n FROM f WHERE value <> '' GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY pattern, facet ORDER BY n DESC, value) AS rank FROM c)
SELECT * FROM k WHERE rank <= 3""",
)
def where_it_happens(spark, sf):
    return reports.where_it_happens(ratings(spark, sf))


_JUNK = f"""coalesce(source <> 'explicit' AND (rating IS NULL OR (confidence = 0 AND contains(shown, 'INFERENCE_FAILED'))
 OR (length(trim(shown)) < 40 AND source = 'implicit') OR {K.any_of('shown', JUNK_PATTERNS)}), rating IS NULL)"""
_HYG = f"""
SELECT event_id, CASE WHEN event_id % 17 = 0 THEN NULL ELSE rating END AS rating, source, confidence, skill, second_skill, agent, sentiment_summary,
 CASE WHEN event_id % 19 = 0 THEN 'INFERENCE_FAILED: no answer' WHEN event_id % 23 = 0 THEN 'report with "summaries" : []' WHEN event_id % 4 = 0 THEN ''
  ELSE response_preview END AS response_preview FROM ({A.RATINGS}) base
"""


@query(
    "hygiene_report",
    f"""WITH h AS (SELECT *, concat(response_preview, ' ', sentiment_summary) AS shown FROM ({_HYG})), j AS (SELECT *, {_JUNK} AS junk FROM h),
c AS (SELECT count(*) AS total, count(*) FILTER (junk) AS junk, count(*) FILTER (NOT junk) AS clean,
 count(*) FILTER (NOT junk AND skill NOT IN ('', 'general-session')) AS with_real_skill,
 count(*) FILTER (NOT junk AND skill <> '' AND second_skill <> '' AND skill <> second_skill) AS with_many_candidates,
 count(*) FILTER (NOT junk AND agent <> '') AS with_agent FROM j)
SELECT *, round(with_real_skill / clean, 3) AS real_skill_rate, round(with_real_skill / clean, 3) >= 0.3 AS attribution_healthy FROM c""",
)
def hygiene_report(spark, sf):
    df = A.view(spark, sf, _HYG)
    names = F.array_distinct(F.filter(F.array("skill", "second_skill"), lambda s: s != ""))
    return reports.hygiene_report(df.withColumn("skill_candidates", names))


@query(
    "junk_ratings",
    f"WITH h AS (SELECT *, concat(response_preview, ' ', sentiment_summary) AS shown FROM ({_HYG})) SELECT event_id FROM h WHERE {_JUNK}",
)
def junk_ratings(spark, sf):
    return A.view(spark, sf, _HYG).where(reports.is_junk()).select("event_id")


@query(
    "weakness_patterns",
    f"""WITH {R} SELECT pattern, count(*) AS n, count(*) >= 2 AND pattern <> 'other' AS addressable FROM rp WHERE rating <= 4
GROUP BY pattern ORDER BY n DESC, pattern LIMIT 15""",
)
def weakness_patterns(spark, sf):
    return reports.weakness_patterns(ratings(spark, sf))


_SCORES_SMALL = "SELECT * FROM (VALUES ('blind_retry', 'working'), ('tool_misuse', 'flat'), ('stale_context', 'regressed')) AS t(pattern, verdict)"


@query(
    "proposals",
    f"""WITH {R}, sc AS ({_SCORES_SMALL}),
p AS (SELECT pattern, count(*) AS n FROM rp WHERE rating <= 4 GROUP BY pattern ORDER BY n DESC, pattern LIMIT 15),
s AS (SELECT skill, count(*) AS n FROM r WHERE rating <= 4 AND skill <> '' GROUP BY skill ORDER BY n DESC, skill LIMIT 10)
SELECT p.pattern, coalesce(sc.verdict, 'pending') AS verdict, 'lesson_autogen' AS surface, 'evolve_or_reinforce' AS action FROM p LEFT JOIN sc USING (pattern)
WHERE n >= 2 AND p.pattern <> 'other' AND coalesce(sc.verdict, 'pending') IN ('regressed', 'flat', 'pending')
UNION ALL SELECT concat('skill:', skill), 'skill_fail_concentration', 'skill_guardrails', concat('skill_autofix /', skill, ' (n_low=', n, ')') FROM s""",
)
def proposals(spark, sf):
    r = ratings(spark, sf)
    surfaces = spark.sql("SELECT explode(array('lesson_autogen', 'skill_guardrails', 'playbook')) AS surface")
    return reports.proposals(
        reports.weakness_patterns(r), reports.weakness_skills(r), spark.sql(_SCORES_SMALL), surfaces
    )


@query(
    "lesson_examples",
    f"""WITH {R} SELECT pattern, rating, timestamp, session_id, sentiment_summary,
 row_number() OVER (PARTITION BY pattern ORDER BY rating, timestamp, session_id, sentiment_summary) AS rank FROM rp WHERE rating <= 4 QUALIFY rank <= 5""",
)
def lesson_examples(spark, sf):
    return reports.collect_examples(ratings(spark, sf), 5)


@query(
    "attribution_cube",
    f"""WITH r AS ({A.RATINGS}) SELECT agent, skill, grouping(agent, skill) AS level, count(*) AS n, round(avg(rating), 4) AS avg_rating,
 round(count(*) FILTER (rating <= 4) / count(*), 4) AS low_share FROM r GROUP BY CUBE (agent, skill)""",
)
def attribution_cube(spark, sf):
    return reports.attribution_cube(A.view(spark, sf, A.RATINGS))


@query(
    "check_cube",
    f"""WITH r AS ({A.RATINGS}), f AS {K.fired('r', 'response_preview', 'agent, skill')}
SELECT eval_id, agent, skill, grouping(eval_id, agent, skill) AS level, count(*) AS fired, count(*) FILTER (NOT passed) AS failed,
 round(count(*) FILTER (NOT passed) / count(*), 4) AS fail_rate FROM f GROUP BY GROUPING SETS ((eval_id, agent, skill), (eval_id, agent), (eval_id, skill), (eval_id))""",
)
def check_cube(spark, sf):
    return reports.check_cube(checks.score(A.view(spark, sf, A.RATINGS), "response_preview", ["agent", "skill"]))


@query(
    "learning_routes",
    f"""WITH r AS ({A.RATINGS}), t AS (SELECT *, lower(concat(response_preview, ' ', sentiment_summary)) AS c FROM r WHERE rating < 5 AND trim(response_preview) <> '')
SELECT timestamp, session_id, rating, source, CASE WHEN {K.any_of('c', ALGORITHM_WORDS)} THEN 'ALGORITHM' WHEN {K.any_of('c', SYSTEM_WORDS)} THEN 'SYSTEM'
 ELSE 'ALGORITHM' END AS category, rating <= 3 AS failure, concat(CASE WHEN source = 'explicit' THEN 'low-rating-' ELSE 'sentiment-rating-' END, rating) AS label FROM t""",
)
def learning_routes(spark, sf):
    return reports.learning_routes(A.view(spark, sf, A.RATINGS))


_SAID = f"""SELECT event_id, concat(response_preview, ' ', {A.case("event_id % 4", ["the bug is solved", "next time ask", "ok", "a lesson"])}) AS said FROM ({A.RATINGS}) base"""


@query(
    "learning_captures",
    f"WITH s AS ({_SAID}) SELECT event_id FROM s WHERE " + " + ".join(f"CAST({K.re('said', p)} AS INT)" for p in LEARNING_WORDS) + " >= 2",
)
def learning_captures(spark, sf):
    return A.view(spark, sf, _SAID).where(T.is_learning(F.col("said"))).select("event_id")


@query(
    "signal_trends",
    f"""WITH r AS ({A.RATINGS}), g AS (SELECT rating, agent, date_diff('second', CAST(timestamp AS TIMESTAMP), TIMESTAMP '2024-01-31 12:00:00') AS age FROM r),
t AS (SELECT round(avg(rating) FILTER (age < 86400), 1) AS day_avg, round(avg(rating) FILTER (age < 604800), 1) AS week_avg,
 round(avg(rating) FILTER (age < 2592000), 1) AS month_avg, count(*) AS total, count(*) FILTER (agent = 'cli') AS agent_total FROM g WHERE age >= 0)
SELECT *, CASE WHEN week_avg > month_avg + 0.2 THEN 'improving' WHEN week_avg < month_avg - 0.2 THEN 'declining' ELSE 'stable' END AS trend FROM t""",
)
def signal_trends(spark, sf):
    return reports.signal_trends(A.view(spark, sf, A.RATINGS), "2024-01-31T12:00:00", "cli")


@query(
    "recent_blocks",
    f"""WITH e AS (SELECT * FROM ({A.ENFORCEMENT}) ORDER BY ts DESC, event_id DESC LIMIT 40)
SELECT pattern, count(*) AS n FROM e WHERE blocked GROUP BY pattern ORDER BY n DESC, pattern LIMIT 5""",
)
def recent_blocks(spark, sf):
    return reports.last_n_counts(A.view(spark, sf, A.ENFORCEMENT), [F.desc("ts"), F.desc("event_id")])


# Months are made from the day so that the history spans several of them.
_MONTHLY = f"""
SELECT rating, sk AS pattern, concat('2024-0', CAST(1 + CAST(substring(event_date, 9, 2) AS INT) % 6 AS STRING), '-01') AS event_date
FROM (SELECT rating, event_date, event_id, CASE WHEN event_id % 4 = 0 AND event_id % 3 = 0 THEN 'a' WHEN event_id % 4 = 1 THEN 'b' ELSE 'c' END AS sk
      FROM ({A.RATINGS}) q) z WHERE NOT (sk = 'b' AND CAST(substring(event_date, 9, 2) AS INT) % 6 IN (2, 3))
"""


@query(
    "trajectory",
    f"""WITH m AS (SELECT pattern, substring(event_date, 1, 7) AS month, count(*) AS n FROM ({_MONTHLY}) WHERE rating <= 4 GROUP BY ALL),
g AS (SELECT *, CAST(substring(month, 6, 2) AS INT) - lag(CAST(substring(month, 6, 2) AS INT)) OVER (PARTITION BY pattern ORDER BY month) > 1 AS gap FROM m),
t AS (SELECT pattern, count(*) AS months, arg_min(n, month) AS first_n, arg_max(n, month) AS last_n, coalesce(bool_or(gap), false) AS cyc FROM g GROUP BY pattern)
SELECT pattern, months, first_n, last_n, CASE WHEN cyc THEN 'cycling' WHEN last_n < first_n THEN 'better' WHEN last_n > first_n THEN 'worse' ELSE 'stable' END AS trajectory FROM t""",
)
def trajectory(spark, sf):
    return reports.trajectory(A.view(spark, sf, _MONTHLY).withColumn("patterns", F.array("pattern")))


@query(
    "passing_examples",
    f"""WITH r AS ({A.RATINGS}), g AS (SELECT skill, rating, timestamp, session_id, substring(sentiment_summary, 1, 160) AS summary FROM r WHERE rating >= 7 AND skill <> '')
SELECT *, row_number() OVER (PARTITION BY skill ORDER BY rating DESC, timestamp, session_id, summary) AS rank FROM g QUALIFY rank <= 4""",
)
def passing_examples(spark, sf):
    return reports.passing_examples(A.view(spark, sf, A.RATINGS))


@query(
    "recent_corrections",
    f"""WITH r AS ({A.RATINGS}) SELECT timestamp, session_id, concat('[', rating, '/10] ', substring(sentiment_summary, 1, 80)) AS line FROM r
WHERE rating <= 4 ORDER BY timestamp DESC, session_id DESC, sentiment_summary LIMIT 3""",
)
def recent_corrections(spark, sf):
    return reports.recent_corrections(A.view(spark, sf, A.RATINGS))


_FAILURES = """
SELECT substring(CAST(CAST(ts AS DATE) AS STRING), 1, 7) AS month,
 concat(CAST(CAST(ts AS DATE) AS STRING), '-', substring(replace(substring(CAST(ts AS STRING), 12, 8), ':', ''), 1, 6), '_', event_type, '-went-wrong-', CAST(event_id AS STRING)) AS name
FROM {events}
"""


@query(
    "recent_failures",
    f"""WITH f AS ({_FAILURES}) SELECT name, concat('[', substring(name, 1, 10), '] ', substring(replace(regexp_replace(name, '^\\d{{4}}-\\d{{2}}-\\d{{2}}-\\d{{6}}_', ''), '-', ' '), 1, 70)) AS line
FROM f ORDER BY month DESC, name DESC LIMIT 5""",
)
def recent_failures(spark, sf):
    return reports.recent_failures(A.view(spark, sf, _FAILURES), 5)


@query(
    "reclass_candidates",
    f"""WITH {R} SELECT timestamp, session_id, rating FROM rp WHERE rating <= 4 AND pattern = 'other' ORDER BY timestamp DESC, session_id DESC, rating DESC LIMIT 40""",
)
def reclass_candidates(spark, sf):
    return reports.reclass_candidates(ratings(spark, sf), 40).select("timestamp", "session_id", "rating")


_RUNS = """
SELECT event_id AS run_id, ts AS run_at, CAST(CAST(ts AS DATE) AS STRING) AS day, CAST(floor(value * 100) AS BIGINT) AS input_tokens,
 CAST(floor(value * 10) AS BIGINT) AS output_tokens FROM {events}
"""


@query(
    "running_cost",
    f"""WITH c AS ({_RUNS}) SELECT run_id, CAST(sum(input_tokens) OVER (ORDER BY run_at, run_id) AS BIGINT) AS total_input_tokens,
 CAST(sum(output_tokens) OVER (ORDER BY run_at, run_id) AS BIGINT) AS total_output_tokens FROM c""",
)
def running_cost(spark, sf):
    return reports.running_cost(A.view(spark, sf, _RUNS)).select("run_id", "total_input_tokens", "total_output_tokens")


# --- text ------------------------------------------------------------------------------

_RULES = [
    "Avoid missed context — verify before acting.",
    "Never claim done without fenced CLI output; run tests before saying complete, then attach the log of the run.",
    "Be careful with schemas and double-check them twice",
    "Check `gh pr view` before approving and never approve twice instead of asking the author first.",
    "When scope risk appears: stop, gather tool evidence, then act. Do not proceed on memory alone.",
    "short",
    "Avoid tool misuse in general sessions of the kind seen",
    "Formula: promotion order: master, then stage, then production. Do not skip a stage at any time.",
]
LESSON_ROWS = f"""
SELECT p_partkey AS lesson_id, concat({A.case("p_partkey % 4", ["missed_context", "schema_error", "tone_drift", "retry_violation"])}, '_', CAST(p_partkey AS STRING)) AS pattern,
 {A.case("p_partkey % 8", _RULES)} AS rule, CAST(p_size AS INT) AS occurrence_count,
 {A.case("p_partkey % 6", ["regressed", "flat", "improving", "working", "resolved", "pending"])} AS verdict
FROM {{part}}
"""
_WEAK = f"""(length(t) < 40 OR {K.re('t', RULE_STUB)} OR ({K.re('t', RULE_GENERIC_AVOID)} AND length(t) < 70)
 OR (starts_with(lower(t), 'avoid ') AND contains(lower(t), 'verify before acting')) OR ({K.re('t', RULE_HOLLOW)} AND length(t) < 90))"""
_QUALITY = f"""CASE WHEN {_WEAK} THEN 0 ELSE 1 + CAST({K.re('t', RULE_IMPERATIVE)} AS INT) + CAST({K.re('t', RULE_ARTIFACT)} AS INT)
 + CAST(contains(lower(t), ' instead') OR (contains(t, ';') AND length(t) > 80) OR {K.re('t', RULE_SEQUENCE)} AS INT) END"""
_SECTION = """CASE WHEN regexp_matches(lower(t), 'formula|order:|master →|bq query|dry-run') THEN 'formula'
 WHEN regexp_matches(lower(t), 'never |do not |don''t |pitfall|stop\\.') OR regexp_matches(pattern, '(_error|_failure|_violation|_regression)$') THEN 'pitfall' ELSE 'strategy' END"""


@query(
    "rule_quality",
    f"""WITH l AS (SELECT *, trim(rule) AS t FROM ({LESSON_ROWS})), q AS (SELECT lesson_id, pattern, {_WEAK} AS weak, {_QUALITY} AS quality,
 length(t) < 24 OR {K.any_of('t', SLUDGE)} AS sludge, {_SECTION} AS section, verdict FROM l)
SELECT lesson_id, weak, CAST(quality AS INT) AS quality, sludge, section, CASE WHEN sludge OR quality < 2 OR verdict = 'pending' THEN 'deferred'
 WHEN verdict IN ('resolved', 'working', 'improving') THEN 'resolved' ELSE section END AS injection FROM q""",
)
def rule_quality(spark, sf):
    df = A.view(spark, sf, LESSON_ROWS)
    rule = F.col("rule")
    df = df.withColumn("_s", lesson_text.guess_section(F.col("pattern"), rule)).withColumn("_q", lesson_text.rule_quality(rule))
    return df.select(
        "lesson_id",
        lesson_text.weak_rule(rule).alias("weak"),
        F.col("_q").alias("quality"),
        lesson_text.is_sludge(rule).alias("sludge"),
        F.col("_s").alias("section"),
        lesson_text.injection_section(F.col("verdict"), F.col("_s"), F.col("_q"), rule).alias("injection"),
    )


@query(
    "content_ids",
    f"""WITH l AS ({LESSON_ROWS}) SELECT lesson_id, concat('b_', substring(pattern, 1, 40), '_', substring(sha1(concat(pattern, '|', substring(rule, 1, 120))), 1, 10)) AS bullet_id,
 substring(sha1(rule), 1, 10) AS content_version, substring(sha256(substring(rule, 1, 800)), 1, 16) AS content_hash FROM l""",
)
def content_ids(spark, sf):
    return A.view(spark, sf, LESSON_ROWS).select(
        "lesson_id",
        T.bullet_id(F.col("pattern"), F.col("rule")).alias("bullet_id"),
        T.content_version(F.col("rule")).alias("content_version"),
        T.content_hash(F.col("rule")).alias("content_hash"),
    )


@query(
    "document_tokens",
    f"""WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS token FROM documents)
SELECT doc_id, count(*) AS n_tokens FROM t WHERE NOT {K.in_list('token', STOPWORDS_LESSONS)} GROUP BY doc_id""",
)
def document_tokens(spark, sf):
    docs = A.tables(spark, sf, "documents")["documents"]
    n = F.size(T.tokens(F.col("text"), STOPWORDS_LESSONS))
    return docs.select("doc_id", n.cast("long").alias("n_tokens")).where("n_tokens > 0")


_NOTES = """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat('- first decision: must keep the schema', chr(10), '- second', chr(10), '- third: root cause known', chr(10), '- fourth, deployed to PRD', chr(10), text)
  WHEN doc_id % 3 = 1 THEN concat('1. Run the tool', chr(10), 'step by step, you must first a then b then c', chr(10), 'exactly this command', chr(10), text)
  ELSE concat(text, chr(10), 'use when needed; the outcome must not drift; confirm') END AS body FROM {documents}
"""


@query(
    "document_signals",
    f"""WITH d AS (SELECT doc_id, body, {K.fold('body')} AS t FROM ({_NOTES})),
n AS (SELECT *, len(string_split(body, chr(10))) AS lines, {' + '.join(f"CAST({K.re('t', p)} AS INT)" for p in HOW_MARKERS)} AS how,
 {' + '.join(f"CAST({K.re('t', p)} AS INT)" for p in INTENT_MARKERS)} AS intent, {' + '.join(f"CAST({K.re('t', p)} AS INT)" for p in CONSTRAINT_MARKERS)} AS cons FROM d)
SELECT doc_id, octet_length(encode(body)) >= 900 AND len(regexp_extract_all(body, '(?m)^- ')) >= 4 AND len(string_split(body, 'None detected')) - 1 < 6 AS high_signal,
 CAST(len(regexp_extract_all(t, {K.lit('(?i)' + SEED_DURABLE)})) AS INT) AS durable_hits,
 CAST(lines AS INT) AS lines, how AS how_hits, intent AS intent_hits, cons AS constraint_hits,
 (lines > 120 AND how >= 2 AND intent = 0 AND cons = 0) OR (how >= 3 AND intent <= 1 AND cons = 0 AND lines > 80) AS flagged,
 CASE WHEN flagged THEN 'review_for_deprecation_or_intent_rewrite' ELSE 'monitor' END AS recommendation FROM n""",
)
def document_signals(spark, sf):
    df = A.view(spark, sf, _NOTES).withColumn("_h", T.how_intent(F.col("body")))
    return df.select(
        "doc_id",
        T.high_signal(F.col("body")).alias("high_signal"),
        T.durable_hits(F.col("body")).alias("durable_hits"),
        "_h.lines",
        "_h.how_hits",
        "_h.intent_hits",
        "_h.constraint_hits",
        "_h.flagged",
        "_h.recommendation",
    )


@query("compressed_notes")
def compressed_notes(spark, sf):
    """Greedy paragraph choice; the visit order makes it a fold that SQL cannot state."""
    df = A.view(spark, sf, _NOTES)
    paragraphs = F.replace(F.col("body"), F.lit("\n"), F.lit("\n\n"))
    return df.select("doc_id", T.compress_episode(paragraphs).alias("episode"))


# --- lessons ---------------------------------------------------------------------------

_BANK = [("schema", "formula", "Before merging a schema change, run `bq show` and never skip the check of a table.")]
_HINT = ("without permission", "Draft, show, ask, wait, then post. Never post without approval of the owner.")
_PLAIN_RULE = "When {phrase} risk appears: stop, gather tool evidence, then act on what it shows."
_REFLECT = f"""
SELECT p_partkey AS lesson_id, CASE WHEN p_partkey % 5 = 0 THEN 'schema' ELSE concat('tone_drift_', CAST(p_partkey AS STRING)) END AS pattern,
 {A.case("p_partkey % 8", _RULES)} AS rule, CASE WHEN p_partkey % 3 = 0 THEN 'posted without permission' WHEN p_partkey % 3 = 1 THEN 'angry' ELSE 'Never push to the main branch while the owner is away today' END AS line,
 CASE WHEN p_partkey % 2 = 0 THEN 'Check the schema with bq show before any change lands in a table' ELSE '' END AS root_cause, CASE WHEN p_partkey % 4 = 0 THEN 'repos: core' ELSE '' END AS where_
FROM {{part}}
"""


def _reflect_sql() -> str:
    q = lambda text: "(" + _QUALITY.replace("(t,", f"({text},").replace("(t)", f"({text})") + ")"
    w = lambda text: "(" + _WEAK.replace("(t,", f"({text},").replace("(t)", f"({text})") + ")"
    return f"""WITH l AS (SELECT *, trim(rule) AS t FROM ({_REFLECT})),
e AS (SELECT *, {w('t')} AS weak, {q('t')} AS grade, CASE WHEN pattern = 'schema' THEN {K.lit(_BANK[0][2])} END AS bank,
 CASE WHEN contains(line, 'without permission') THEN {K.lit(_HINT[1])} WHEN line <> 'angry' THEN line END AS ev FROM l),
s AS (SELECT *, CASE WHEN NOT weak AND grade >= 3 THEN 'passthrough' WHEN bank IS NOT NULL THEN 'bank' WHEN ev IS NOT NULL AND NOT {w('ev')} THEN 'evidence'
 WHEN length(root_cause) > 30 AND NOT {w('root_cause')} AND {q('root_cause')} >= 2 THEN 'evidence2' WHEN weak OR grade < 2 THEN 'heuristic' ELSE 'passthrough' END AS src FROM e),
d AS (SELECT lesson_id, pattern, weak AS weak_input, bank, replace(src, '2', '') AS source, substring(CASE src WHEN 'bank' THEN bank WHEN 'evidence' THEN ev WHEN 'evidence2' THEN root_cause
 WHEN 'heuristic' THEN concat('When ', replace(pattern, '_', ' '), ' risk appears: stop, gather tool evidence, then act on what it shows.', CASE WHEN where_ <> '' THEN concat(' Hotspots: ', where_, '.') ELSE '' END) ELSE t END, 1, 400) AS t FROM s)
SELECT pattern, t AS description, CASE WHEN bank IS NOT NULL THEN 'formula' ELSE {_SECTION} END AS section, CAST({_QUALITY} AS INT) AS quality, source, weak_input FROM d"""


@query("reflected_lessons", _reflect_sql())
def reflected_lessons(spark, sf):
    df = A.view(spark, sf, _REFLECT).withColumn("evidence", F.array("line"))
    bank = spark.createDataFrame(_BANK, "pattern string, section string, description string")
    return lesson_text.reflect(df, bank, [_HINT], [(".*", _PLAIN_RULE)])


_FILES = """
SELECT doc_id, concat(CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('---', chr(10)) END, 'name: x', chr(10), CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat('description: y', chr(10)) END,
 'metadata:', chr(10), '---', chr(10), text, CASE WHEN doc_id % 5 = 0 THEN '```' ELSE '' END) AS content, concat(lang, CASE WHEN doc_id % 6 = 0 THEN '-Review-Finding' WHEN doc_id % 6 = 1 THEN '-dag-bronze' ELSE '' END) AS name FROM {documents}
"""


@query(
    "lesson_format",
    f"""WITH f AS ({_FILES}), p AS (SELECT doc_id, name, string_split(content, '---') AS s, content FROM f),
b AS (SELECT *, array_to_string(s[3:], '---') AS body FROM p)
SELECT doc_id, len(s) >= 3 AND contains(s[2], 'name:') AND contains(s[2], 'description:') AND contains(s[2], 'metadata:') AND (len(string_split(body, '```')) - 1) % 2 = 0 AS ok,
 regexp_matches(lower(name), 'review|approved|approval|pr-|comment|finding|merge') AS is_review, regexp_matches(lower(name), 'dag|airflow|dataform|sqlx|pipeline|bronze|silver|mysql|bq|bigquery|schema') AS is_data FROM b""",
)
def lesson_format(spark, sf):
    review, data = classify.domain_flags(F.col("name"))
    return A.view(spark, sf, _FILES).select(
        "doc_id", lesson_text.lesson_format_ok(F.col("content")).alias("ok"), review.alias("is_review"), data.alias("is_data")
    )


@query("capped_log", f"SELECT event_id, pattern FROM ({A.ENFORCEMENT}) ORDER BY ts DESC, event_id DESC LIMIT 1000")
def capped_log(spark, sf):
    log = A.view(spark, sf, A.ENFORCEMENT)
    return keep_last(log, [F.desc("ts"), F.desc("event_id")], 1000).select("event_id", "pattern")
