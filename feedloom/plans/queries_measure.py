"""Queries that measure lessons: verdicts, escalation, side effects and series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.fixed_values import ENFORCEABLE, ESCALATION_ORDER, REAL_VERDICTS
from feedloom.functions import checks
from feedloom.operators import classify, measure
from feedloom.plans import adapters as A
from feedloom.plans import checker as K
from feedloom.plans.registry import query

AS_OF = "2024-02-15"
COVERED = checks.covered_patterns()


def ratings(spark: SparkSession, sf: str) -> DataFrame:
    """Ratings with ``patterns``; array columns in the shapes of the log."""
    df = A.view(spark, sf, A.RATINGS).withColumn("tools_used", F.array("tool"))
    return classify.classify(df, A.TAXONOMY)


def check_results(spark: SparkSession, sf: str) -> DataFrame:
    texts = measure.texts_by_key(A.view(spark, sf, A.RATINGS))
    return checks.score(texts, "response_preview", ["timestamp", "session_id"])


def lessons(spark: SparkSession, sf: str) -> DataFrame:
    return A.view(spark, sf, A.LESSONS)


def judged(spark: SparkSession, sf: str) -> DataFrame:
    return A.view(spark, sf, A.JUDGED)


def scores(spark: SparkSession, sf: str) -> DataFrame:
    return measure.effectiveness(
        ratings(spark, sf), lessons(spark, sf), check_results(spark, sf), judged(spark, sf), COVERED, AS_OF
    )


def _effectiveness_sql() -> str:
    v = K.verdict
    return f"""{K.RATINGS_CTE},
l AS ({A.LESSONS}), j AS ({A.JUDGED}),
ev AS {K.fired('r', 'response_preview', 'timestamp')},
bad AS (SELECT DISTINCT timestamp, pattern FROM ev WHERE NOT passed),
jf AS (SELECT timestamp, pattern, bool_or(NOT passed) AS failed FROM j GROUP BY ALL),
tot AS (SELECT l.pattern, l.baseline_date, count(*) FILTER (event_date < baseline_date) AS bn,
  count(*) FILTER (event_date >= baseline_date) AS an FROM l CROSS JOIN r GROUP BY ALL),
hit AS (SELECT l.pattern, count(*) FILTER (event_date < baseline_date) AS hb, count(*) FILTER (event_date >= baseline_date) AS ha
  FROM l JOIN rp USING (pattern) WHERE rating <= 4 GROUP BY ALL),
obj AS (SELECT l.pattern, count(*) FILTER (event_date < baseline_date) AS ob, count(*) FILTER (event_date >= baseline_date) AS oa
  FROM l JOIN bad USING (pattern) JOIN r USING (timestamp) GROUP BY ALL),
jd AS (SELECT l.pattern, count(*) FILTER (timestamp < baseline_date) AS jbn, count(*) FILTER (timestamp >= baseline_date) AS jan,
  count(*) FILTER (failed AND timestamp < baseline_date) AS jbh, count(*) FILTER (failed AND timestamp >= baseline_date) AS jah
  FROM l JOIN jf USING (pattern) GROUP BY ALL),
x AS (SELECT pattern, baseline_date, CAST(date_diff('day', CAST(baseline_date AS DATE), DATE '{AS_OF}') AS INT) AS days_open,
  bn AS before_n, an AS after_n,
  CASE WHEN bn > 0 THEN coalesce(hb, 0) / bn ELSE 0 END AS sb, CASE WHEN an > 0 THEN coalesce(ha, 0) / an ELSE 0 END AS sa,
  {K.in_list('pattern', COVERED)} AS eval_covered,
  CASE WHEN bn > 0 THEN coalesce(ob, 0) / bn ELSE 0 END AS obb, CASE WHEN an > 0 THEN coalesce(oa, 0) / an ELSE 0 END AS oaa,
  jbn IS NOT NULL AS judge_covered,
  CASE WHEN coalesce(jbn, 0) > 0 THEN jbh / jbn ELSE 0 END AS jb, CASE WHEN coalesce(jan, 0) > 0 THEN jah / jan ELSE 0 END AS ja,
  coalesce(jan, 0) AS judge_after_n
  FROM tot LEFT JOIN hit USING (pattern) LEFT JOIN obj USING (pattern) LEFT JOIN jd USING (pattern)),
y AS (SELECT *, {v('sb', 'sa', 'after_n', 'days_open')} AS verdict,
  CASE WHEN eval_covered THEN {v('obb', 'oaa', 'after_n', 'days_open')} ELSE 'no-eval' END AS obj_verdict,
  CASE WHEN judge_covered THEN {v('jb', 'ja', 'judge_after_n', 'days_open')} ELSE 'no-judge' END AS judge_verdict FROM x),
eff AS (SELECT pattern, baseline_date, days_open, round(sb, 4) AS before_rate, round(sa, 4) AS after_rate, round(sa - sb, 4) + 0 AS delta,
  before_n, after_n, verdict,
  ({K.in_list('verdict', REAL_VERDICTS)} OR {K.in_list('obj_verdict', REAL_VERDICTS)} OR {K.in_list('judge_verdict', REAL_VERDICTS)}) AS injectable,
  eval_covered, round(CASE WHEN eval_covered THEN obb ELSE 0 END, 4) AS obj_before, round(CASE WHEN eval_covered THEN oaa ELSE 0 END, 4) AS obj_after,
  round(CASE WHEN eval_covered THEN oaa - obb ELSE 0 END, 4) + 0 AS obj_delta, obj_verdict, judge_covered,
  round(CASE WHEN judge_covered THEN jb ELSE 0 END, 4) AS judge_before, round(CASE WHEN judge_covered THEN ja ELSE 0 END, 4) AS judge_after,
  round(CASE WHEN judge_covered THEN ja - jb ELSE 0 END, 4) + 0 AS judge_delta, judge_verdict, judge_after_n FROM y),
esc AS (SELECT *, CASE WHEN eval_covered AND verdict IN ('flat','regressed') AND after_n >= 5 AND {K.in_list('pattern', ENFORCEABLE)}
  AND obj_verdict NOT IN ('regressed','flat') THEN verdict WHEN eval_covered THEN obj_verdict
  WHEN judge_covered THEN judge_verdict ELSE verdict END AS escalation_verdict FROM eff)"""


EFFECTIVENESS = _effectiveness_sql()


@query("effectiveness_verdicts", f"WITH {EFFECTIVENESS} SELECT * FROM eff")
def effectiveness_verdicts(spark, sf):
    return scores(spark, sf)


@query("escalation", f"WITH {EFFECTIVENESS} SELECT * FROM esc WHERE escalation_verdict IN ('flat', 'regressed')")
def escalation(spark, sf):
    return measure.escalation(scores(spark, sf))


_SEVERITY = "CASE escalation_verdict " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ESCALATION_ORDER.items()) + " ELSE 10 END"


@query(
    "escalation_rank",
    f"WITH {EFFECTIVENESS} SELECT pattern, escalation_verdict, CAST({_SEVERITY} AS INT) AS severity, delta FROM esc",
)
def escalation_rank(spark, sf):
    ranked = measure.escalation_rank(scores(spark, sf))
    return ranked.select("pattern", "escalation_verdict", "severity", "delta")


# The queue's patterns are order priorities; five lesson names stand in for them here.
_GATE_QUEUE = """
SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'stale_context' WHEN '2-HIGH' THEN 'scope_misunderstanding'
  WHEN '3-MEDIUM' THEN 'missing_dependency' ELSE 'other' END AS pattern,
 CAST(CAST(o_orderdate AS DATE) AS STRING) AS detected_at,
 CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN 'pending' ELSE 'approved' END AS status,
 CAST(NULL AS STRING) AS reviewed_at, CAST(NULL AS STRING) AS reviewer FROM {orders}
"""


@query(
    "gated_escalation",
    f"""WITH {EFFECTIVENESS}, q AS ({_GATE_QUEUE}),
waiting AS (SELECT DISTINCT pattern FROM q WHERE status = 'pending' AND date_diff('day', CAST(detected_at AS DATE), DATE '{A.QUEUE_AS_OF}') <= 14)
SELECT esc.pattern, escalation_verdict, CASE WHEN NOT {K.in_list('esc.pattern', ENFORCEABLE)} AND escalation_verdict = 'regressed'
  AND waiting.pattern IS NULL AND esc.pattern <> 'wrong_env_promotion' THEN 'first_time_regressed'
  WHEN NOT {K.in_list('esc.pattern', ENFORCEABLE)} AND waiting.pattern IS NOT NULL THEN 'under_review' ELSE 'escalate' END AS gate
FROM esc LEFT JOIN waiting ON esc.pattern = waiting.pattern WHERE escalation_verdict IN ('flat', 'regressed')""",
)
def gated_escalation(spark, sf):
    queue = A.view(spark, sf, _GATE_QUEUE)
    prior = spark.sql("SELECT 'wrong_env_promotion' AS pattern, 'regressed' AS verdict")
    gated = measure.gate_escalation(scores(spark, sf), queue, prior, A.QUEUE_AS_OF)
    return gated.select("pattern", "escalation_verdict", "gate")


@query(
    "coverage_gaps",
    f"""WITH {K.RATINGS_CTE} SELECT pattern, count(*) AS n FROM rp WHERE rating <= 4 AND pattern <> 'other'
AND pattern NOT IN ('blind_retry', 'tool_misuse') GROUP BY pattern""",
)
def coverage_gaps(spark, sf):
    return measure.coverage_gaps(ratings(spark, sf), ["blind_retry", "tool_misuse"])


# All (lesson, other pattern) rates; the flag thresholds are part of the operator.
_SIDE = f"""WITH {K.RATINGS_CTE}, l AS ({A.LESSONS}),
tot AS (SELECT l.pattern, l.baseline_date, count(*) FILTER (event_date < baseline_date) AS bn,
  count(*) FILTER (event_date >= baseline_date) AS an FROM l CROSS JOIN r GROUP BY ALL),
rates AS (SELECT tot.pattern AS offending_lesson, q.pattern AS side_effect_pattern, tot.baseline_date AS lesson_date, bn AS before_n, an AS after_n,
  count(*) FILTER (rating <= 4 AND event_date < baseline_date) / any_value(bn) AS b, count(*) FILTER (rating <= 4 AND event_date >= baseline_date) / any_value(an) AS a
  FROM tot JOIN rp q ON q.pattern <> tot.pattern AND q.pattern <> 'other' WHERE bn >= 5 AND an >= 5 GROUP BY ALL),
flagged AS (SELECT offending_lesson, side_effect_pattern, lesson_date, round(b, 4) AS before_rate, round(a, 4) AS after_rate,
  round(a - b, 4) AS delta, before_n, after_n FROM rates
  WHERE (b > 0 AND a >= b * 1.5 AND a - b >= 0.05) OR (b = 0 AND a >= 0.1))"""

# Low ratings spread over ten values never move a rate by 0.05, so these two queries
# read ratings where two thirds of one pattern's late rows are rated low.
_SIDE_RATINGS = A.RATINGS.replace(
    "CAST(1 + (CAST(floor(value) AS BIGINT) + event_id) % 10 AS INT) AS rating",
    "CAST(CASE WHEN sk IN (0, 5) AND event_date >= '2024-01-14' THEN 2 ELSE 9 - event_id % 2 END AS INT) AS rating",
)
_SIDE = _SIDE.replace(A.RATINGS, _SIDE_RATINGS)


def _side_ratings(spark, sf):
    df = A.view(spark, sf, _SIDE_RATINGS).withColumn("tools_used", F.array("tool"))
    return classify.classify(df, A.TAXONOMY)


@query("held_out_regression", f"{_SIDE} SELECT * FROM flagged")
def held_out_regression(spark, sf):
    return measure.side_effects(_side_ratings(spark, sf), lessons(spark, sf))


@query(
    "worst_side_effect",
    f"{_SIDE} SELECT * FROM flagged QUALIFY row_number() OVER (PARTITION BY offending_lesson ORDER BY delta DESC, side_effect_pattern) = 1",
)
def worst_side_effect(spark, sf):
    return measure.worst_side_effect(measure.side_effects(_side_ratings(spark, sf), lessons(spark, sf)))


# An effectiveness log: one row per (day, event type) with a verdict by daily volume.
_LOG = """
SELECT event_type AS pattern, CAST(CAST(ts AS DATE) AS STRING) AS measured_at,
 CASE WHEN count(*) % 3 = 0 THEN 'regressed' WHEN avg(value) > 9 THEN 'flat' ELSE 'improving' END AS verdict,
 CASE WHEN count(*) % 2 = 0 THEN CAST(CAST(min(ts) AS DATE) AS STRING) ELSE '' END AS lesson_date,
 CASE WHEN count(*) % 5 = 0 THEN 'unknown' ELSE CAST(CAST(max(ts) AS DATE) AS STRING) END AS baseline_date
FROM {events} GROUP BY event_type, CAST(ts AS DATE)
"""


@query(
    "verdict_series",
    f"""WITH g AS ({_LOG}), s AS (SELECT pattern, measured_at, verdict, lag(verdict) OVER (PARTITION BY pattern ORDER BY measured_at) AS previous FROM g)
SELECT pattern, measured_at, previous, verdict FROM s WHERE previous IS NULL OR previous <> verdict""",
)
def verdict_series(spark, sf):
    return measure.verdict_series(A.view(spark, sf, _LOG))


@query(
    "historical_epoch",
    f"""WITH g AS ({_LOG}), d AS (SELECT pattern, CASE WHEN lesson_date <> '' THEN lesson_date ELSE baseline_date END AS d FROM g)
SELECT pattern, min(d) AS first_date FROM d WHERE regexp_matches(d, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') GROUP BY pattern""",
)
def historical_epoch(spark, sf):
    return measure.historical_epoch(A.view(spark, sf, _LOG))
