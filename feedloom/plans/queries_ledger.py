"""Queries over the review queue, skill edits, judge votes and held-out cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.fixed_values import INTERVENTIONS, PROTECTED_LESSONS, STOPWORDS_PROMOTION
from feedloom.operators import health as health_ops
from feedloom.operators import ledger
from feedloom.plans import adapters as A
from feedloom.plans import checker as K
from feedloom.plans.queries_measure import AS_OF, EFFECTIVENESS, ratings, scores
from feedloom.plans.queries_reports import full_ratings
from feedloom.plans.queries_measure import worst_side_effect
from feedloom.plans.registry import CHECKS, query
from feedloom.scale import prefix_sums

Q = f"q AS ({A.QUEUE})"
_AGE = f"CAST(date_diff('day', CAST(detected_at AS DATE), DATE '{A.QUEUE_AS_OF}') AS INT)"


def queue(spark, sf):
    return A.view(spark, sf, A.QUEUE)


_AUDIT = """
SELECT o_orderpriority AS pattern, CAST(CAST(o_orderdate AS DATE) AS STRING) AS timestamp, o_orderkey AS record_id,
 CASE WHEN o_orderkey % 2 = 0 THEN 'approved' ELSE 'rejected' END AS action FROM {orders} WHERE o_orderstatus <> 'P'
"""


@query(
    "review_urgency",
    f"""WITH {Q} SELECT record_id, pattern, {_AGE} AS age_days, CAST(14 - {_AGE} AS INT) AS days_left, {_AGE} > 14 AS expiring FROM q WHERE status = 'pending'""",
)
def review_urgency(spark, sf):
    return ledger.urgency(queue(spark, sf), A.QUEUE_AS_OF).select("record_id", "pattern", "age_days", "days_left", "expiring")


@query(
    "queue_stats",
    f"""WITH {Q} SELECT status, count(*) AS n, round(avg(coalesce(delta, 0)), 4) AS avg_delta, max({_AGE}) AS max_age, min(detected_at) AS oldest FROM q GROUP BY status""",
)
def queue_stats(spark, sf):
    return ledger.queue_stats(queue(spark, sf), A.QUEUE_AS_OF)


@query(
    "recidivists",
    f"""WITH {Q} SELECT pattern, count(*) AS n, count(*) FILTER (status = 'pending') AS n_pending, count(*) FILTER (status = 'approved') AS n_approved,
 count(*) FILTER (status = 'rejected') AS n_rejected, min(detected_at) AS first_at, max(detected_at) AS last_at FROM q GROUP BY pattern HAVING count(*) > 1""",
)
def recidivists(spark, sf):
    return ledger.recidivists(queue(spark, sf))


@query(
    "status_path",
    f"WITH {Q} SELECT pattern, record_id, detected_at, status, row_number() OVER (PARTITION BY pattern ORDER BY detected_at, record_id) AS position FROM q",
)
def status_path(spark, sf):
    return ledger.status_path(queue(spark, sf))


@query(
    "queue_history",
    f"""WITH {Q}, a AS ({_AUDIT}), e AS (SELECT pattern, detected_at AS at_day, 'queue' AS kind, record_id, status AS event FROM q
 UNION ALL SELECT pattern, timestamp, 'audit', record_id, action FROM a)
SELECT pattern, at_day AS "at", kind, record_id, event, lag(event) OVER (PARTITION BY pattern ORDER BY at_day, kind, record_id) AS previous FROM e""",
)
def queue_history(spark, sf):
    return ledger.queue_history(queue(spark, sf), A.view(spark, sf, _AUDIT))


@query(
    "auto_drain_eligible",
    f"WITH {Q} SELECT record_id FROM q WHERE status = 'pending' AND source IN ('lesson_dedup', 'lesson_evolve') AND {_AGE} >= 7",
)
def auto_drain_eligible(spark, sf):
    out = ledger.auto_drain_eligible(queue(spark, sf), ["lesson_dedup", "lesson_evolve", "manual"], 7, A.QUEUE_AS_OF)
    return out.select("record_id")


@query(
    "ambiguous_targets",
    f"""WITH {Q} SELECT pattern, count(*) AS n_pending, count(DISTINCT source) AS n_sources FROM q WHERE status = 'pending' GROUP BY pattern HAVING count(*) > 1""",
)
def ambiguous_targets(spark, sf):
    return ledger.ambiguous_targets(queue(spark, sf))


@query(
    "bulk_approved_queue",
    f"""WITH {Q} SELECT record_id, pattern, detected_at, delta, after_n, CASE WHEN status = 'pending' AND {_AGE} >= 30 THEN 'approved' ELSE status END AS status, source,
 CASE WHEN status = 'pending' AND {_AGE} >= 30 THEN '{A.QUEUE_AS_OF}' END AS reviewed_at, CASE WHEN status = 'pending' AND {_AGE} >= 30 THEN 'USER' END AS reviewer FROM q""",
)
def bulk_approved_queue(spark, sf):
    q = queue(spark, sf)
    return ledger.apply_decisions(q, ledger.bulk_decisions(q, 30, A.QUEUE_AS_OF), A.QUEUE_AS_OF)[0]


@query(
    "decision_audit",
    f"""WITH {Q} SELECT '{A.QUEUE_AS_OF}' AS timestamp, pattern, record_id, 'approved' AS action, 'USER' AS reviewer, 'bulk-approved' AS reason, delta, after_n
FROM q WHERE status = 'pending' AND {_AGE} >= 30""",
)
def decision_audit(spark, sf):
    q = queue(spark, sf)
    return ledger.apply_decisions(q, ledger.bulk_decisions(q, 30, A.QUEUE_AS_OF), A.QUEUE_AS_OF)[1]


@query(
    "unqueued_patterns",
    f"""WITH {Q}, c AS (SELECT p_brand AS pattern, count(*) AS n FROM part GROUP BY p_brand UNION ALL SELECT o_orderpriority, count(*) FROM orders GROUP BY o_orderpriority)
SELECT pattern, n FROM c WHERE pattern NOT IN (SELECT pattern FROM q WHERE status = 'pending' AND source = 'lesson_dedup')""",
)
def unqueued_patterns(spark, sf):
    t = A.tables(spark, sf, "part", "orders")
    c = t["part"].groupBy(F.col("p_brand").alias("pattern")).agg(F.count("*").alias("n")).unionByName(
        t["orders"].groupBy(F.col("o_orderpriority").alias("pattern")).agg(F.count("*").alias("n"))
    )
    return ledger.not_queued(c, queue(spark, sf), "lesson_dedup")


# --- skills -----------------------------------------------------------------------------

_BY = f"""{K.RATINGS_CTE}, ed AS ({A.EDITS}),
bs AS (SELECT event_id, rating, timestamp, skill AS own, lower(skill) AS attributed FROM r WHERE skill <> ''
 UNION SELECT event_id, rating, timestamp, skill, lower(second_skill) FROM r WHERE second_skill <> '')"""


def edits(spark, sf):
    return A.view(spark, sf, A.EDITS)


@query(
    "skill_gate",
    f"""WITH {_BY}, g AS (SELECT attributed, count(*) AS n, count(*) FILTER (rating <= 4) AS low_n FROM bs GROUP BY attributed),
pc AS (SELECT attributed, pattern, count(*) AS c FROM bs JOIN cls USING (event_id) WHERE rating <= 4 GROUP BY ALL),
dom AS (SELECT attributed, pattern FROM pc QUALIFY row_number() OVER (PARTITION BY attributed ORDER BY c DESC, pattern) = 1)
SELECT g.attributed AS skill, n, low_n, round(low_n / n, 4) AS rate, coalesce(pattern, 'general_quality') AS pattern FROM g LEFT JOIN dom USING (attributed)
WHERE low_n >= 3 AND low_n / n >= 0.35 AND g.attributed NOT IN (SELECT skill FROM ed WHERE status = 'active')
 AND NOT EXISTS (SELECT 1 FROM ed WHERE status = 'reverted' AND ed.skill = g.attributed AND ed.pattern = coalesce(dom.pattern, 'general_quality'))""",
)
def skill_gate(spark, sf):
    return ledger.skill_gate(full_ratings(spark, sf), edits(spark, sf), min_rate=0.35)


_AFTER = f"""{_BY}, ae AS (SELECT ed.*, count(*) FILTER (bs.timestamp > ed.applied) AS post_n, count(*) FILTER (bs.timestamp > ed.applied AND rating <= 4) AS pl,
 count(bs.event_id) AS all_n, count(*) FILTER (rating <= 4) AS al, max(bs.timestamp) AS newest FROM ed LEFT JOIN bs ON bs.attributed = ed.skill GROUP BY ALL)"""


def _v(rate: str, n: str) -> str:
    return K.verdict("baseline_fail_rate", rate, n, "-1")


@query(
    "edit_outcomes",
    f"""WITH {_AFTER}, v AS (SELECT *, CASE WHEN post_n > 0 THEN pl / post_n ELSE 0 END AS rate FROM ae WHERE status = 'active'),
w AS (SELECT *, {_v('rate', 'post_n')} AS verdict FROM v)
SELECT skill, pattern, applied, post_n, round(rate, 3) AS post_fail_rate, verdict, CASE WHEN verdict IN ('flat', 'regressed') THEN 'reverted'
 WHEN verdict IN ('working', 'improving', 'resolved') THEN 'confirmed' ELSE 'active' END AS new_status FROM w""",
)
def edit_outcomes(spark, sf):
    return ledger.edit_outcomes(edits(spark, sf), full_ratings(spark, sf))


@query(
    "burn_in",
    f"""WITH {_AFTER}, v AS (SELECT *, CASE WHEN all_n > 0 THEN al / all_n ELSE 0 END AS rate FROM ae WHERE status = 'active'),
w AS (SELECT *, {_v('rate', 'greatest(all_n, 5)')} AS pv FROM v)
SELECT skill, pattern, applied, post_n, CASE WHEN post_n > 0 THEN round(pl / post_n, 3) END AS post_fail_rate, all_n, round(rate, 3) AS all_fail_rate, pv AS provisional_verdict,
 post_n < 5 AS needs_live_sessions, all_n >= 5 AND pv IN ('working', 'improving', 'resolved') AND rate < baseline_fail_rate - 0.005 AS provisional_confirm FROM w""",
)
def burn_in(spark, sf):
    return ledger.burn_in(edits(spark, sf), full_ratings(spark, sf))


@query(
    "stalled_edits",
    f"""WITH {_AFTER} SELECT skill, pattern, applied, status AS old_status, CASE WHEN status = 'active' AND date_diff('day', CAST(applied AS DATE), DATE '{AS_OF}') > 14 AND post_n = 0
 THEN 'stalled' WHEN status = 'stalled' AND post_n > 0 THEN 'active' ELSE status END AS new_status, post_n, newest FROM ae""",
)
def stalled_edits(spark, sf):
    return ledger.stall(edits(spark, sf), full_ratings(spark, sf), AS_OF)


# --- judge and cases --------------------------------------------------------------------------

_JUDGE_PATTERNS = ["click", "view", "error", "purchase", "signup"]


@query(
    "judge_quorum",
    f"""WITH v AS ({A.JUDGE_VOTES}), t AS (SELECT DISTINCT timestamp, session_id FROM v), p AS (SELECT unnest({_JUDGE_PATTERNS!r}) AS pattern),
c AS (SELECT timestamp, session_id, pattern, count(DISTINCT pass_no) AS n, arg_min(substring(evidence, 1, 160), (pass_no, evidence)) AS ev FROM v WHERE flagged GROUP BY ALL)
SELECT t.timestamp, t.session_id, p.pattern, coalesce(n, 0) < 2 AS passed, CASE WHEN coalesce(n, 0) >= 2 THEN ev ELSE '' END AS evidence
FROM t CROSS JOIN p LEFT JOIN c ON c.timestamp = t.timestamp AND c.session_id = t.session_id AND c.pattern = p.pattern""",
)
def judge_quorum(spark, sf):
    return ledger.judge_quorum(A.view(spark, sf, A.JUDGE_VOTES), _JUDGE_PATTERNS, 3)


_JQ = "SELECT CAST(doc_id AS STRING) AS session_id, CAST(CAST(date_add(DATE '2024-01-01', CAST(doc_id % 30 AS INT)) AS DATE) AS STRING) AS timestamp FROM {documents}"


@query("judge_remaining", f"WITH q AS ({_JQ}), b AS (SELECT * FROM q ORDER BY timestamp, session_id LIMIT 12) SELECT session_id, timestamp FROM q EXCEPT SELECT session_id, timestamp FROM b")
def judge_remaining(spark, sf):
    return ledger.judge_batch(A.view(spark, sf, _JQ))[1].select("session_id", "timestamp")


# Expected checks of the twelve phrases: (phrase, check, passed).
GOLDEN = [
    (0, "completion_without_artifact", False),
    (1, "completion_without_artifact", True), (1, "metric_without_evidence", True), (1, "bare_metric_not_strong_artifact", True),
    (2, "hedge_without_verification", False),
    (3, "completion_without_artifact", True), (3, "posting_claim_without_trace", True), (3, "external_post_without_ask", False),
    (4, "retry_without_diagnosis", False), (4, "unhelpful_troubleshooting_no_diagnosis", False),
    (5, "conclusion_without_evidence", True), (5, "retry_without_diagnosis", True),
    (6, "scope_dismissal_without_research", False),
    (7, "completion_without_artifact", False), (7, "duplicate_approval_claimed", False), (7, "pr_approve_without_status", False),
    (7, "approve_without_verification_trace", False),
    (8, "global_scope_without_confirm", False),
    (9, "confident_state_without_evidence", False), (9, "metric_without_evidence", False),
    (11, "confident_agreement_without_verification", False),
]
_CASES = f"""
SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'out' ELSE 'in' END AS split, event_type AS domain,
 {A.case("event_id % 4", ["retry", "claims", "scope", "review"])} AS pattern, CAST(event_id % 12 AS INT) AS phrase_no,
 {A.case("event_id % 12", A.PHRASES)} AS response FROM {{events}}
"""
# Every case also expects that no SQL check applies; every eleventh case expects that one does.
_CASE_ERRORS = f"""c AS ({_CASES}), ev AS {K.fired('c', 'response', 'id')},
g AS (SELECT * FROM (VALUES {', '.join(f"({p}, '{e}', {str(ok).lower()})" for p, e, ok in GOLDEN)}) AS t(phrase_no, eval_id, passed)),
ex AS (SELECT id, eval_id, true AS applied, g.passed FROM c JOIN g USING (phrase_no) UNION ALL
 SELECT id, 'sql_without_dry_run', id % 11 = 0, NULL FROM c),
er AS (SELECT ex.id, ex.eval_id, (ev.id IS NOT NULL) <> ex.applied AS wrong_gate, ex.passed IS NOT NULL AND ev.passed IS DISTINCT FROM ex.passed AS wrong_test
 FROM ex LEFT JOIN ev ON ev.id = ex.id AND ev.eval_id = ex.eval_id),
ok AS (SELECT c.*, NOT coalesce(bool_or(wrong_gate OR wrong_test), false) AS ok FROM c LEFT JOIN er USING (id) GROUP BY ALL)"""


def cases(spark, sf):
    kind = "map<string, struct<applied: boolean, passed: boolean>>"
    expected = {}
    for phrase, check, passed in GOLDEN:
        expected.setdefault(phrase, {})[check] = passed
    expect = F.create_map().cast(kind)
    for phrase, wanted in expected.items():
        pairs = []
        for check, passed in wanted.items():
            pairs += [F.lit(check), F.struct(F.lit(True).alias("applied"), F.lit(passed).alias("passed"))]
        expect = F.when(F.col("phrase_no") == phrase, F.create_map(*pairs).cast(kind)).otherwise(expect)
    sql_check = F.create_map(
        F.lit("sql_without_dry_run"),
        F.struct((F.col("id") % 11 == 0).alias("applied"), F.lit(None).cast("boolean").alias("passed")),
    ).cast(kind)
    return A.view(spark, sf, _CASES).withColumn("expect", F.map_concat(expect, sql_check))


@query("case_results", f"WITH {_CASE_ERRORS} SELECT id, ok FROM ok")
def case_results(spark, sf):
    return ledger.expectation_errors(cases(spark, sf)).select("id", "ok")


@query(
    "suite_run",
    f"""WITH {_CASE_ERRORS} SELECT split, domain, pattern, count(*) AS n, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed,
 round(count(*) FILTER (ok) / count(*), 4) AS pass_rate FROM ok GROUP BY GROUPING SETS ((split), (split, domain), (split, pattern))""",
)
def suite_run(spark, sf):
    return ledger.suite_run(ledger.expectation_errors(cases(spark, sf)))


_BASE = "SELECT split, CAST(rate AS DOUBLE) AS pass_rate FROM (VALUES ('in', 0.9), ('out', 0.95)) AS t(split, rate)"


@query(
    "baseline_gate",
    f"""WITH {_CASE_ERRORS}, b AS ({_BASE}), s AS (SELECT split, round(count(*) FILTER (ok) / count(*), 4) AS pass_rate FROM ok GROUP BY split),
gated AS (SELECT s.split, s.pass_rate, round(s.pass_rate - b.pass_rate, 4) AS delta, s.pass_rate < b.pass_rate AS regressed FROM s JOIN b USING (split))
SELECT *, NOT regressed AS gate_pass FROM gated UNION ALL SELECT 'gate', NULL, NULL, coalesce(bool_or(regressed), false), NOT coalesce(bool_or(regressed), false) FROM gated""",
)
def baseline_gate(spark, sf):
    current = ledger.suite_run(ledger.expectation_errors(cases(spark, sf))).where("domain IS NULL AND pattern IS NULL")
    return ledger.baseline_gate(current, spark.sql(_BASE))


@query(
    "rubric_results",
    f"""WITH {_CASE_ERRORS}, l AS (SELECT *, lower(response) AS t FROM ok)
SELECT id, ok AND NOT contains(t, 'deployed') AND (contains(t, 'pytest') OR contains(t, 'the ') OR contains(t, 'again')) AS ok FROM l""",
)
def rubric_results(spark, sf):
    out = ledger.rubric(
        cases(spark, sf)
        .withColumn("must_not_match", F.array(F.lit("Deployed")))
        .withColumn("must_match_any", F.array(F.lit("PyTest"), F.lit("the "), F.lit("again")))
    )
    return out.select("id", "ok")


@query(
    "rubric_summary",
    f"""WITH {_CASE_ERRORS} SELECT split, count(*) AS n, count(*) FILTER (ok) AS passed, round(count(*) FILTER (ok) / count(*), 4) AS pass_rate,
 round(count(*) FILTER (ok) / count(*), 4) >= 0.75 AS accepted FROM ok GROUP BY split""",
)
def rubric_summary(spark, sf):
    return ledger.rubric_summary(ledger.expectation_errors(cases(spark, sf)))


_RUNS = "SELECT CAST(user_id AS STRING) AS task, event_id, value > 2 AS ok FROM {events}"
_TRIALS = f"SELECT task, CAST(row_number() OVER (PARTITION BY task ORDER BY event_id) - 1 AS INT) AS trial_no, ok FROM ({_RUNS})"


@query(
    "pass_hat_k",
    f"""WITH t AS ({_TRIALS}), p AS (SELECT task, count(*) AS n, bool_and(ok) AS e, bool_or(ok) AS s FROM t WHERE trial_no < 4 GROUP BY task HAVING count(*) >= 4)
SELECT count(*) AS tasks, round(avg(CAST(e AS INT)), 4) AS pass_hat_k, round(avg(CAST(s AS INT)), 4) AS pass_at_k FROM p""",
)
def pass_hat_k(spark, sf):
    placed = prefix_sums(A.view(spark, sf, _RUNS), ["task"], ["event_id"], {"place": F.lit(1).cast("long")})
    return ledger.pass_k(placed.select("task", (F.col("place") - 1).cast("int").alias("trial_no"), "ok"), 4)


# --- promotion --------------------------------------------------------------------------------

_LABELS = f"""
SELECT CAST(user_id AS STRING) AS session_id, {A.case("event_id % 4", ["slow_answer", "wrong_file_edit", "lost_context", "noise"])} AS label,
 CAST(CAST(ts AS DATE) AS STRING) AS labeled_at, CAST(event_id % 6 AS INT) AS rating, CASE WHEN user_id % 7 = 0 THEN 'promoted' ELSE 'pending' END AS status,
 concat({A.case("event_id % 5", ["the answer came slowly today", "edited another file instead", "forgot earlier context", "nothing there", "slow again today"])}, ' ', event_type) AS sentiment_summary
FROM {{events}}
"""
# One row per (session, day, label), so that the latest label of a session is unambiguous.
_UNIQUE = f"""
SELECT session_id, label, labeled_at, max(rating) AS rating, max(status) AS status, max(sentiment_summary) AS sentiment_summary
FROM ({_LABELS}) base GROUP BY session_id, label, labeled_at
"""
_LATEST = f"""lb AS ({_UNIQUE}), lt AS (SELECT * FROM lb QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY labeled_at DESC, label DESC) = 1)"""


@query(
    "promotion_candidates",
    f"""WITH {_LATEST} SELECT label, count(*) AS sessions, round(coalesce(avg(rating) FILTER (rating <> 0), 0), 4) AS avg_rating FROM lt WHERE status = 'pending' GROUP BY label HAVING count(*) >= 3""",
)
def promotion_candidates(spark, sf):
    return ledger.promotion_candidates(_unique_labels(spark, sf))


def _unique_labels(spark, sf):
    return A.view(spark, sf, _UNIQUE)


@query(
    "suggested_keywords",
    f"""WITH {_LATEST}, t AS (SELECT label, unnest(regexp_extract_all(lower(sentiment_summary), '[a-z]{{4,}}')) AS token FROM lt WHERE status = 'pending'),
c AS (SELECT label, token, count(*) AS n FROM t WHERE NOT {K.in_list('token', STOPWORDS_PROMOTION)} GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, token) AS rn FROM c QUALIFY rn <= 6)
SELECT label, concat(replace(label, '_', ','), ',', string_agg(token, ',' ORDER BY rn) FILTER (NOT list_contains(string_split(label, '_'), token))) AS keywords FROM k GROUP BY label""",
)
def suggested_keywords(spark, sf):
    out = ledger.suggest_keywords(_unique_labels(spark, sf))
    return out.select("label", F.array_join("keywords", ",").alias("keywords"))


@query(
    "enforcement_candidates",
    f"""WITH e AS ({A.ENFORCEMENT}) SELECT pattern, count(*) FILTER (ts >= TIMESTAMP '2024-01-30' - INTERVAL 14 DAY) AS fires_in_window, count(*) AS total_fires FROM e
WHERE pattern IN ('view', 'purchase', 'signup') GROUP BY pattern HAVING fires_in_window >= 5""",
)
def enforcement_candidates(spark, sf):
    overrides = spark.sql("SELECT * FROM VALUES ('click', 'block'), ('view', 'warn') AS t(pattern, mode)")
    eligible = spark.sql("SELECT * FROM VALUES ('click'), ('view'), ('purchase'), ('signup') AS t(pattern)")
    return ledger.enforcement_candidates(A.view(spark, sf, A.ENFORCEMENT), eligible, overrides, queue(spark, sf), "2024-01-30")


# --- lessons ------------------------------------------------------------------------------------

_INTERVENTION_SQL = "[" + ", ".join(K.lit(i) for i in INTERVENTIONS) + "]"
_CHRONIC_SCORES = "SELECT o_orderpriority AS pattern, CASE WHEN o_orderpriority < '4' THEN 'regressed' ELSE 'flat' END AS verdict FROM {orders} GROUP BY o_orderpriority"
_CHRONIC_SNAPS = "SELECT o_orderpriority AS pattern, max(CAST(CAST(o_orderdate AS DATE) AS STRING)) AS taken_at, CAST(count(*) % 5 AS INT) AS top_hits FROM {orders} GROUP BY o_orderpriority"


@query(
    "chronic_failures",
    f"""WITH {Q}, s AS ({_CHRONIC_SCORES}), a AS ({_AUDIT}), sn AS ({_CHRONIC_SNAPS}),
an AS (SELECT pattern, count(*) AS n FROM a GROUP BY pattern), pn AS (SELECT pattern, count(*) AS n FROM q WHERE status = 'pending' GROUP BY pattern),
j AS (SELECT s.pattern, s.pattern <> '2-HIGH' AS blocked, coalesce(an.n, 0) AS audit_entries, coalesce(pn.n, 0) AS pending_entries,
 CASE WHEN s.pattern = '1-URGENT' THEN 3 END AS ace_quality, top_hits AS h FROM s LEFT JOIN an USING (pattern) LEFT JOIN pn USING (pattern) LEFT JOIN sn USING (pattern) WHERE verdict = 'regressed'),
u AS (SELECT *, list_filter({_INTERVENTION_SQL}, lambda x: NOT ((x = 'lesson' AND audit_entries > 0) OR (x = 'ace_bullet' AND ace_quality IS NOT NULL)
 OR (x = 'enforcement_block' AND blocked) OR (x = 'skill_guardrail' AND pattern = '3-MEDIUM') OR (x = 'human_pairing' AND pending_entries > 0))) AS un FROM j)
SELECT pattern, blocked AND audit_entries >= 5 AS chronic, blocked, audit_entries, pending_entries, ace_quality,
 CAST(CASE WHEN pattern = '3-MEDIUM' THEN 1 ELSE 0 END AS BIGINT) AS skill_edits, array_to_string(un, ',') AS untried,
 coalesce(un[1], 'human_pairing (repeat)') AS next_intervention, CASE WHEN blocked AND audit_entries >= 5 THEN h + 1 ELSE 0 END AS top_hits FROM u""",
)
def chronic_failures(spark, sf):
    overrides = spark.sql("SELECT * FROM VALUES ('1-URGENT', 'block'), ('3-MEDIUM', 'block'), ('2-HIGH', 'warn') AS t(pattern, mode)")
    bullets = spark.sql("SELECT * FROM VALUES ('1-URGENT', 3), ('1-URGENT', 2) AS t(pattern, quality)")
    done = spark.sql("SELECT '3-MEDIUM' AS pattern, 'bq' AS skill, 'reverted' AS status")
    out = ledger.chronic(
        A.view(spark, sf, _CHRONIC_SCORES), overrides, A.view(spark, sf, _AUDIT), queue(spark, sf), done, bullets,
        A.view(spark, sf, _CHRONIC_SNAPS),
    )
    return out.withColumn("untried", F.array_join("untried", ","))


_LESSON_SCORES = f"""
SELECT p_partkey AS id, CASE WHEN p_partkey % 50 = 0 THEN 'blind_retry' ELSE concat('lesson_', CAST(p_partkey AS STRING)) END AS pattern, CAST(p_size AS INT) AS occurrence_count,
 {A.case("p_partkey % 4", ["pending", "stale-pending", "flat", "regressed"])} AS verdict, CAST(p_partkey % 5 AS INT) AS after_n, CAST(p_size AS INT) AS days_open,
 p_partkey % 3 = 0 AS eval_covered, CASE WHEN p_partkey % 2 = 0 THEN 'working' ELSE 'flat' END AS obj_verdict, p_partkey % 5 = 0 AS judge_covered, 'regressed' AS judge_verdict
FROM {{part}} WHERE p_partkey % 50 <> 0 OR p_partkey = 50
"""


@query(
    "lesson_retirement",
    f"""WITH s AS ({_LESSON_SCORES}) SELECT pattern, CASE WHEN verdict = 'stale-pending' THEN 'stale-pending' ELSE 'pending zombie' END AS reason FROM s
WHERE NOT {K.in_list('pattern', PROTECTED_LESSONS)} AND days_open >= 14 AND (verdict = 'stale-pending' OR (verdict = 'pending' AND after_n <= 1 AND occurrence_count <= 20))""",
)
def lesson_retirement(spark, sf):
    s = A.view(spark, sf, _LESSON_SCORES)
    return ledger.retire(s.select("pattern", "occurrence_count"), s, max_occurrences=20)


_VARIANTS = """
SELECT concat('lesson_', CAST(p_partkey AS STRING)) AS pattern, CAST(p_size % 2 AS INT) AS variant_id, concat('Rewritten: ', p_name) AS text,
 CASE WHEN p_size > 25 THEN '2024-02-12' ELSE '2024-02-01' END AS proposed_at FROM {part} WHERE p_partkey % 3 <> 1
"""


@query(
    "evolve_eligible",
    f"""WITH s AS ({_LESSON_SCORES}), v AS (SELECT pattern, max(proposed_at) AS last_proposed FROM ({_VARIANTS}) GROUP BY pattern),
e AS (SELECT pattern, CASE WHEN eval_covered THEN obj_verdict WHEN judge_covered THEN judge_verdict ELSE verdict END AS escalation_verdict FROM s)
SELECT e.*, last_proposed FROM e LEFT JOIN v USING (pattern) WHERE escalation_verdict IN ('flat', 'regressed')
 AND (last_proposed IS NULL OR date_diff('day', CAST(last_proposed AS DATE), DATE '{AS_OF}') >= 7)""",
)
def evolve_eligible(spark, sf):
    s = A.view(spark, sf, _LESSON_SCORES)
    return ledger.evolve_eligible(s, s.select("pattern"), A.view(spark, sf, _VARIANTS), AS_OF)


_MERGES = "SELECT concat('lesson_', CAST(p_partkey - p_partkey % 10 + 1 AS STRING)) AS survivor, concat('lesson_', CAST(p_partkey AS STRING)) AS loser FROM {part} WHERE p_partkey % 10 IN (3, 4, 7)"
_PLAIN = "SELECT concat('lesson_', CAST(p_partkey AS STRING)) AS pattern, p_name AS rule, CAST(p_size AS BIGINT) AS occurrence_count, '2024-01-01' AS first_seen, '2024-01-05' AS last_updated FROM {part}"


@query(
    "merged_lessons",
    f"""WITH l AS ({_PLAIN}), m AS ({_MERGES}), g AS (SELECT survivor, CAST(sum(occurrence_count) AS BIGINT) AS n, count(*) AS c FROM m JOIN l ON l.pattern = m.loser GROUP BY survivor)
SELECT pattern, occurrence_count + coalesce(n, 0) AS occurrence_count, coalesce(c, 0) AS merged_lessons FROM l LEFT JOIN g ON g.survivor = l.pattern WHERE pattern NOT IN (SELECT loser FROM m)""",
)
def merged_lessons(spark, sf):
    out = ledger.apply_merges(A.view(spark, sf, _PLAIN), A.view(spark, sf, _MERGES))
    return out.select("pattern", "occurrence_count", "merged_lessons")


@query(
    "evolved_lessons",
    f"""WITH l AS ({_PLAIN}), v AS ({_VARIANTS}) SELECT l.pattern, coalesce(v.text, l.rule) AS rule, l.first_seen,
 CASE WHEN v.text IS NOT NULL THEN '{AS_OF}' ELSE l.last_updated END AS last_updated FROM l LEFT JOIN v ON v.pattern = l.pattern AND v.variant_id = 1""",
)
def evolved_lessons(spark, sf):
    lessons, variants = A.view(spark, sf, _PLAIN), A.view(spark, sf, _VARIANTS)
    choices = lessons.select("pattern", F.lit(1).alias("variant_id"))
    return ledger.apply_variant(lessons, variants, choices, AS_OF).select("pattern", "rule", "first_seen", "last_updated")


# --- files and episodes -------------------------------------------------------------------------


@query(
    "snapshot_diff",
    f"""WITH n AS ({A.FILES_NOW}), b AS ({A.FILES_BEFORE}) SELECT coalesce(n.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'changed' END AS change,
 b.size AS old_size, n.size AS new_size, CASE WHEN coalesce(n.path, b.path) LIKE '%.py' THEN 'scripts' ELSE 'other' END AS kind
FROM n FULL JOIN b ON n.path = b.path WHERE b.path IS NULL OR n.path IS NULL OR abs(b.mtime - n.mtime) > 1 OR b.size <> n.size""",
)
def snapshot_diff(spark, sf):
    return ledger.snapshot_diff(A.view(spark, sf, A.FILES_BEFORE), A.view(spark, sf, A.FILES_NOW))


_EPISODES = """
SELECT doc_id AS seq, concat('episode-', CAST(doc_id % 300 AS STRING)) AS name, text AS episode_body,
 CASE WHEN doc_id % 13 = 0 THEN 'flushed' ELSE 'pending' END AS status FROM {documents}
"""
_EP = f"e AS ({_EPISODES}), lt AS (SELECT * FROM e WHERE status = 'pending' AND episode_body <> '' QUALIFY row_number() OVER (PARTITION BY name ORDER BY seq DESC) = 1), fs AS (SELECT name, min(seq) AS f FROM e WHERE episode_body <> '' GROUP BY name)"


@query("flush_now", f"WITH {_EP} SELECT name, seq FROM lt JOIN fs USING (name) ORDER BY f LIMIT 20")
def flush_now(spark, sf):
    return ledger.flush_split(A.view(spark, sf, _EPISODES))[0].select("name", "seq")


@query("flush_later", f"WITH {_EP} SELECT name, seq FROM lt JOIN fs USING (name) ORDER BY f OFFSET 20")
def flush_later(spark, sf):
    return ledger.flush_split(A.view(spark, sf, _EPISODES))[1].select("name", "seq")


@query(
    "unseen_episodes",
    f"""WITH e AS ({_EPISODES}), r AS (SELECT substring(episode_body, 1, 800) AS b FROM e WHERE seq % 2 = 0 ORDER BY seq DESC LIMIT 200)
SELECT seq FROM e WHERE seq % 2 = 1 AND substring(episode_body, 1, 800) NOT IN (SELECT b FROM r)""",
)
def unseen_episodes(spark, sf):
    e = A.view(spark, sf, _EPISODES)
    return ledger.unseen_content(e.where("seq % 2 = 1"), e.where("seq % 2 = 0")).select("seq")


@query(
    "new_documents",
    f"""WITH e AS (SELECT concat('doc-', doc_id) AS name, text FROM documents)
SELECT name FROM e WHERE CAST(substring(name, 5) AS INT) % 5 <> 0 AND CAST(substring(name, 5) AS INT) % 7 <> 0""",
)
def new_documents(spark, sf):
    docs = A.tables(spark, sf, "documents")["documents"].select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"), "text", "doc_id")
    archive = docs.where("doc_id % 5 = 0").select("name")
    by_content = docs.where("doc_id % 7 = 0").select(
        F.concat("name", F.lit(":"), F.substring(F.sha2("text", 256), 1, 16)).alias("name")
    )
    return ledger.new_documents(docs.drop("doc_id"), archive, by_content).select("name")


@query(
    "health",
    f"""WITH {EFFECTIVENESS}, {Q}, m AS (SELECT count(*) FILTER (verdict = 'pending') AS p, count(*) FILTER (injectable) AS i FROM esc),
rr AS (SELECT count(*) AS n, count(*) FILTER (skill <> '') AS k, count(*) FILTER (skill NOT IN ('', 'general-session')) AS g, max(timestamp) AS t FROM r),
pq AS (SELECT count(*) AS n FROM q WHERE status = 'pending'),
hx AS (SELECT 'effectiveness_stuck' AS "check", 'warning' AS level, CAST(p AS DOUBLE) AS value, p > 20 AND i < 5 AS fired FROM m
UNION ALL SELECT 'no_skill_attribution', 'warning', k, n > 0 AND k = 0 FROM rr UNION ALL SELECT 'low_skill_attribution', 'warning', round(g / n, 3), n > 0 AND round(g / n, 3) < 0.3 FROM rr
UNION ALL SELECT 'ratings_aging', 'warning', date_diff('day', CAST(substring(t, 1, 10) AS DATE), DATE '{AS_OF}'), date_diff('day', CAST(substring(t, 1, 10) AS DATE), DATE '{AS_OF}') BETWEEN 3 AND 5 FROM rr
UNION ALL SELECT 'ratings_flatline', 'error', date_diff('day', CAST(substring(t, 1, 10) AS DATE), DATE '{AS_OF}'), date_diff('day', CAST(substring(t, 1, 10) AS DATE), DATE '{AS_OF}') > 5 FROM rr
UNION ALL SELECT 'episodes_pending', 'warning', n, n > 10 FROM pq)
SELECT * FROM hx""",
)
def health(spark, sf):
    return health_ops.health_checks(scores(spark, sf), ratings(spark, sf), queue(spark, sf), AS_OF)



@query(
    "merged_evidence",
    f"WITH l AS ({_PLAIN}), m AS ({_MERGES}) SELECT survivor AS pattern, loser AS merged_from, occurrence_count, rule FROM m JOIN l ON l.pattern = m.loser",
)
def merged_evidence(spark, sf):
    return ledger.merged_evidence(A.view(spark, sf, _PLAIN), A.view(spark, sf, _MERGES))


@query(
    "labelled_entries",
    f"""WITH lb AS (SELECT session_id, max(timestamp) AS timestamp FROM ({A.RATINGS}) GROUP BY session_id), e AS (SELECT session_id, timestamp, max(rating) AS rating FROM ({A.RATINGS}) GROUP BY ALL)
SELECT lb.session_id, lb.timestamp, rating FROM lb LEFT JOIN e ON e.session_id = lb.session_id AND e.timestamp = lb.timestamp""",
)
def labelled_entries(spark, sf):
    r = A.view(spark, sf, A.RATINGS)
    labels = r.groupBy("session_id").agg(F.max("timestamp").alias("timestamp"))
    entries = r.groupBy("session_id", "timestamp").agg(F.max("rating").alias("rating"))
    return ledger.label_entries(labels, entries)


# --- writing to the queue -------------------------------------------------------------------

_RECORD = """'n/a' AS obj_verdict, 'n/a' AS judge_verdict, 'pending' AS status, CAST(NULL AS VARCHAR) AS reviewed_at, CAST(NULL AS VARCHAR) AS reviewer"""


def _queued(candidates: str, source: str) -> str:
    return f"""WITH {Q}, k AS ({candidates}) SELECT pattern, '{A.QUEUE_AS_OF}' AS detected_at, CAST(delta AS DOUBLE) AS delta, CAST(after_n AS INT) AS after_n, {_RECORD},
 '{source}' AS source, note FROM k WHERE pattern NOT IN (SELECT pattern FROM q WHERE status = 'pending' AND source = '{source}')"""


@query(
    "queued_side_effects",
    _queued(
        f"""SELECT offending_lesson AS pattern, delta, after_n, concat('lesson of ', lesson_date, ': ', side_effect_pattern, ' ',
 CAST(before_rate AS DECIMAL(10, 4)), ' -> ', CAST(after_rate AS DECIMAL(10, 4))) AS note FROM ({CHECKS['worst_side_effect']})""",
        "held_out_regression",
    ),
)
def queued_side_effects(spark, sf):
    return ledger.queue_side_effects(worst_side_effect(spark, sf), queue(spark, sf), A.QUEUE_AS_OF)


@query(
    "queued_promotions",
    _queued(
        f"""SELECT label AS pattern, CAST(NULL AS DOUBLE) AS delta, sessions AS after_n, concat('sessions=', sessions, ', avg_rating=', CAST(avg_rating AS DECIMAL(10, 4))) AS note
 FROM ({CHECKS['promotion_candidates']})""",
        "pattern_promotion",
    ),
)
def queued_promotions(spark, sf):
    return ledger.queue_promotions(promotion_candidates(spark, sf), queue(spark, sf), A.QUEUE_AS_OF)


# --- what was tried, what is registered ---------------------------------------------------------

_TRIED = """
SELECT concat('skill_', CAST(p_size % 7 AS STRING)) AS skill, concat('pattern_', CAST(p_partkey AS STRING)) AS pattern, p_brand AS applied,
 CASE WHEN p_partkey % 3 = 0 THEN 'active' ELSE 'reverted' END AS status FROM {part}
"""


@query(
    "prior_failed",
    f"SELECT skill, pattern, applied, row_number() OVER (PARTITION BY skill ORDER BY applied DESC, pattern) AS rank FROM ({_TRIED}) WHERE status = 'reverted' QUALIFY rank <= 5",
)
def prior_failed(spark, sf):
    return ledger.prior_failed(A.view(spark, sf, _TRIED)).select("skill", "pattern", "applied", "rank")


_IN_CODE = "SELECT concat('check_', CAST(p_partkey AS STRING)) AS eval_id, CAST(p_size % 3 AS INT) AS version FROM {part} WHERE p_partkey % 3 <> 0"
_REGISTRY = f"""
SELECT concat('check_', CAST(p_partkey AS STRING)) AS eval_id, CAST((p_size + p_partkey % 2) % 3 AS INT) AS version,
 {A.case("p_partkey % 5", ["active", "active", "retired", "orphaned", "active"])} AS status FROM {{part}} WHERE p_partkey % 4 <> 1
"""


@query(
    "reconciled_registry",
    f"""WITH c AS ({_IN_CODE}), r AS ({_REGISTRY}), j AS (SELECT coalesce(c.eval_id, r.eval_id) AS eval_id, c.eval_id IS NOT NULL AS in_code, c.version AS cv, r.version AS rv, r.status AS st
 FROM c FULL JOIN r ON c.eval_id = r.eval_id)
SELECT eval_id, coalesce(cv, rv) AS version, CASE WHEN in_code THEN 'active' WHEN st = 'active' THEN 'orphaned' ELSE st END AS status,
 concat_ws(',', CASE WHEN in_code AND st IS NULL THEN 'added' END, CASE WHEN in_code AND st IS NOT NULL AND cv <> rv THEN 'version' END, CASE WHEN in_code AND st = 'retired' THEN 'reactivated' END,
 CASE WHEN in_code AND st = 'orphaned' THEN 'un-orphaned' END, CASE WHEN NOT in_code AND st = 'active' THEN 'orphaned' END) AS changes FROM j""",
)
def reconciled_registry(spark, sf):
    out = ledger.reconcile_registry(A.view(spark, sf, _IN_CODE), A.view(spark, sf, _REGISTRY))
    return out.withColumn("changes", F.array_join("changes", ","))
