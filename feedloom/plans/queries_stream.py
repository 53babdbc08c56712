"""Streaming operators run to completion over the event and conversation files.

Stateful ones follow a copy of their view that arrives in nine slices of time, some rows a slice late.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.plans import adapters as A
from feedloom.plans import checker as K
from feedloom.plans.queries_turns import _APPROVALS, _ARMED, RULES
from feedloom.plans.registry import CHECKS, query
from feedloom.session import ensure_checkpoint_dir
from feedloom.streaming import streams

SLICES = 8
_DAY = 86_400  # a watermark starts at the epoch, so the times here start a day after it


def stream(spark: SparkSession, sf: str, table: str) -> DataFrame:
    """The table as a stream, be it one file or a folder of files."""
    schema = spark.read.parquet(f"{sf}/{table}.parquet").schema
    # As a pattern: a plain path to a file would be taken for the folder of the stream.
    return spark.readStream.schema(schema).parquet(f"{sf}/{table}.parque[t]")


def stream_view(spark: SparkSession, sf: str, sql: str, table: str) -> DataFrame:
    return spark.sql(sql, **{table: stream(spark, sf, table)})


def new_folder(spark: SparkSession, purpose: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


def late_slices(view: DataFrame, order: str, salt: str, last: str, units: int = 1) -> tuple[DataFrame, str]:
    """(stream, lateness): the view in slices of ``order``, every tenth row one slice late, then one
    row that moves the watermark past all others and is itself never decided.

    ``order`` counts ``units`` to the second; ``last`` is that row's first column.
    """
    spark = view.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/slices-{uuid.uuid4().hex}"
    low, high = view.agg(F.coalesce(F.min(order), F.lit(0)), F.coalesce(F.max(order), F.lit(0))).first()
    width = (high - low) // SLICES + 1
    files = spark.sparkContext.defaultParallelism
    late = (F.pmod(F.xxhash64(salt), F.lit(10)) == 0).cast("long")
    slice_no = F.floor((F.col(order) - low) / width) + late
    for k in range(SLICES + 1):
        view.where(slice_no == k).repartition(files).write.mode("append").parquet(path)
    first = view.columns[0]
    # The watermark stays a lateness behind that row, and the lateness grows with the span of the view.
    values = {order: F.lit(high + 3 * width + 1000 * 86_400 * units), first: F.lit(last)}
    end = spark.range(1).select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in view.schema])
    end.write.mode("append").parquet(path)
    stream = spark.readStream.schema(view.schema).option("maxFilesPerTrigger", files).parquet(path)
    return stream, f"{3 * width // units + 1} seconds"


@query(
    "stream_checks",
    f"WITH r AS ({A.RATINGS}) SELECT event_id, eval_id, pattern, passed FROM {K.fired('r', 'response_preview', 'event_id')}",
)
def stream_checks(spark, sf):
    responses = stream_view(spark, sf, A.RATINGS, "events").select("event_id", "response_preview")
    cores = spark.sparkContext.defaultParallelism
    scored = streams.stream_checks(responses, "response_preview", ["event_id"], cores)
    return streams.run_available(scored).drop("applied")


@query(
    "stream_fires",
    f"WITH f AS (SELECT event_id, response_preview AS t FROM ({A.RATINGS}) r) "
    + " UNION ALL ".join(
        f"SELECT event_id, {K.lit(p)} AS pattern, {K.lit(_ARMED[p])} AS mode FROM f WHERE {cond}"
        for p, cond in K.detector_fires("t")
        if p in _ARMED
    ),
)
def stream_fires(spark, sf):
    armed = spark.createDataFrame(list(_ARMED.items()), "pattern string, mode string")
    responses = stream_view(spark, sf, A.RATINGS, "events").select("event_id", "response_preview")
    return streams.run_available(streams.stream_fires(responses, "response_preview", ["event_id"], armed)).drop("blocked")


@query(
    "stream_policy",
    "SELECT event_id, verdict FROM (" + CHECKS["policy_verdicts"] + ") WHERE verdict <> 'allow'",
)
def stream_policy(spark, sf):
    calls = stream_view(spark, sf, A.TOOL_CALLS, "events").select("event_id", "command")
    return streams.run_available(streams.stream_policy(calls, RULES)).select("event_id", "verdict")


@query(
    "stream_fires_window",
    f"""WITH e AS ({A.ENFORCEMENT}), lim AS (SELECT max(ts) - INTERVAL 10 MINUTE AS wm FROM e),
w AS (SELECT unnest(range(CAST(date_trunc('day', ts) AS TIMESTAMP) - INTERVAL 13 DAY, CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS start, pattern, blocked FROM e)
SELECT start, start + INTERVAL 14 DAY AS "end", pattern, count(*) AS fires, count(*) FILTER (blocked) AS blocked FROM w, lim
WHERE start + INTERVAL 14 DAY <= wm GROUP BY start, pattern""",
)
def stream_fires_window(spark, sf):
    # The wall-clock times are read as UTC whatever the session's time zone is.
    zone = F.current_timezone()
    fires = stream_view(spark, sf, A.ENFORCEMENT, "events").withColumn(
        "ts", F.from_utc_timestamp(F.col("ts").cast("timestamp"), zone)
    )
    out = streams.run_available(streams.fires_window(fires))
    for c in ("start", "end"):
        out = out.withColumn(c, F.to_utc_timestamp(c, zone).cast("timestamp_ntz"))
    return out


@query("stream_rate_limited", CHECKS["rate_limited"])
def stream_rate_limited(spark, sf):
    calls = A.view(spark, sf, _APPROVALS).select(
        "host", "event_id", (F.col("at_s") + _DAY).alias("ts_seconds"), F.lit("gh pr review 1 --approve").alias("command")
    )
    arriving, lateness = late_slices(calls, "ts_seconds", "event_id", "-end-")
    passed = streams.approval_rate_limit(arriving.fillna("gh pr review 1 --approve", "command"), new_folder(spark, "approvals"), lateness)
    marked = passed.select("event_id", F.lit(True).alias("allowed"))
    return calls.join(marked, "event_id", "left").select("event_id", F.coalesce("allowed", F.lit(False)).alias("allowed"))


_EPISODES = """
SELECT concat(event_type, ' ', CAST(event_id % 60 AS STRING)) AS name, concat('body ', CAST(user_id % 40 AS STRING)) AS episode_body,
 event_id, 86400 + event_id * 300 + CAST(floor(value) AS BIGINT) % 7 AS ts_seconds FROM {events}
"""
_HORIZON = 7 * _DAY


def _first_within(rows: str, key: str, tag: str) -> str:
    """Common table expressions that end in ``kept_<tag>``: rows a horizon after the last kept one of their key."""
    return f"""ord_{tag} AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ts_seconds, event_id) AS n FROM {rows}),
walk_{tag}(k, n, event_id, kept, clock) AS (SELECT {key}, n, event_id, true, ts_seconds FROM ord_{tag} WHERE n = 1
 UNION ALL SELECT o.{key}, o.n, o.event_id, o.ts_seconds - w.clock >= {_HORIZON}, CASE WHEN o.ts_seconds - w.clock >= {_HORIZON} THEN o.ts_seconds ELSE w.clock END
 FROM walk_{tag} w JOIN ord_{tag} o ON o.{key} = w.k AND o.n = w.n + 1),
kept_{tag} AS (SELECT ord_{tag}.* EXCLUDE (n) FROM ord_{tag} JOIN walk_{tag} USING (event_id) WHERE kept)"""


@query(
    "stream_dedupe",
    f"""WITH RECURSIVE e AS ({_EPISODES}), {_first_within("e", "episode_body", "h")}, {_first_within("kept_h", "name", "n")}
SELECT event_id, ts_seconds, name, episode_body FROM kept_n""",
)
def stream_dedupe(spark, sf):
    kept = A.view(spark, sf, _EPISODES)
    for by in ("content_hash", "name"):
        arriving, lateness = late_slices(kept, "ts_seconds", "event_id", "-end-")
        arriving = arriving.fillna("-end-", "episode_body")
        kept = streams.run_available(streams.stream_dedupe(arriving, by, _HORIZON, lateness)).select(*kept.columns[:1], "episode_body", "event_id", "ts_seconds")
    return kept


@query(
    "stream_turns",
    f"""WITH tr AS ({A.TRANSCRIPT}), nt AS (SELECT *, sum(CASE WHEN type = 'user' AND trim(text) <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq) AS turn_no FROM tr),
called AS (SELECT session, turn_no, seq, i, list_filter(string_split(tools, ','), lambda x: x <> '')[i] AS tool FROM
 (SELECT *, unnest(range(1, len(list_filter(string_split(tools, ','), lambda x: x <> '')) + 1)) AS i FROM nt WHERE type = 'assistant')),
named AS (SELECT session, turn_no, tool, min(seq * 1000 + i) AS place, count(*) AS n FROM called GROUP BY ALL),
listed AS (SELECT session, turn_no, string_agg(tool, ',' ORDER BY place) AS tools, CAST(sum(n) AS BIGINT) AS n_tools FROM named GROUP BY ALL),
said AS (SELECT session, turn_no, string_agg(substring(text, 1, 2000), chr(10) || '---' || chr(10) ORDER BY seq) FILTER (type = 'tool_result') AS evidence FROM nt GROUP BY ALL)
SELECT session, CAST(turn_no AS BIGINT) AS turn_no, coalesce(n_tools, 0) AS n_tools, coalesce(tools, '') AS tools, right(coalesce(evidence, ''), 12000) AS evidence
FROM said LEFT JOIN listed USING (session, turn_no) WHERE turn_no > 0""",
)
def stream_turns(spark, sf):
    events = A.view(spark, sf, A.TRANSCRIPT).withColumn("seq", F.col("seq").cast("long"))
    arriving, lateness = late_slices(events, "seq", "seq", "-end-")
    arriving = arriving.withColumn("ts", F.timestamp_seconds(F.col("seq") + _DAY)).withColumn("tools", F.filter(F.split("tools", ","), lambda t: t != ""))
    arriving = arriving.withColumn("type", F.coalesce("type", F.lit("user"))).withColumn("text", F.coalesce("text", F.lit("-")))
    return streams.run_available(streams.turn_state(arriving, lateness=lateness))


_STREAM_PROMPTS = f"""
SELECT doc_id, {A.case("doc_id % 7", ["8 - nice", "Great job!", "ok", "tell me more", "10/10 would", "<system-reminder> 9", "7"])} AS prompt,
 CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(1 + doc_id % 9 AS INT) END AS sentiment_rating, CAST((doc_id % 4) / 4.0 AS DOUBLE) AS sentiment_confidence, text AS response FROM {{documents}}
"""


@query(
    "stream_prompt_routes",
    f"""WITH p AS ({_STREAM_PROMPTS}), r AS (SELECT *, CASE WHEN doc_id % 7 IN (0, 1, 6) THEN 'keep' WHEN doc_id % 7 IN (2, 5) THEN 'drop' WHEN sentiment_rating IS NOT NULL AND sentiment_confidence >= 0.5 THEN 'keep'
 WHEN length(trim(response, chr(10) || ' ')) >= 200 THEN 'judge' ELSE 'drop' END AS route FROM p)
SELECT doc_id, route, CASE WHEN route <> 'keep' THEN NULL WHEN doc_id % 7 IN (0, 1) THEN 8 WHEN doc_id % 7 = 6 THEN 7 ELSE sentiment_rating END AS rating,
 CASE WHEN doc_id % 7 IN (0, 6) THEN 'explicit' ELSE 'implicit' END AS source FROM r""",
)
def stream_prompt_routes(spark, sf):
    prompts = stream_view(spark, sf, _STREAM_PROMPTS, "documents")
    routed = streams.route_prompts(prompts).select("doc_id", "route", "rating", "source")
    return streams.run_available(routed)


@query(
    "stream_prompt_sinks",
    f"SELECT *, CASE route WHEN 'keep' THEN 'ratings' ELSE 'judge' END AS sink FROM ({CHECKS['stream_prompt_routes']}) WHERE route IN ('keep', 'judge')",
)
def stream_prompt_sinks(spark, sf):
    prompts = stream_view(spark, sf, _STREAM_PROMPTS, "documents")
    routed = streams.route_prompts(prompts).select("doc_id", "route", "rating", "source")
    base = f"{ensure_checkpoint_dir(spark)}/routes-{uuid.uuid4().hex}"
    streams.write_routes(routed, f"{base}/ratings", f"{base}/judge", f"{base}/checkpoint").awaitTermination()
    read = lambda sink: spark.read.parquet(f"{base}/{sink}").select(*routed.columns, F.lit(sink).alias("sink"))
    return read("ratings").unionByName(read("judge"))


_REMINDERS = """
SELECT event_id, CAST(user_id % 5 AS STRING) AS host, event_id * 1500 + CAST(floor(value) AS BIGINT) % 3 AS at_ms,
 CASE WHEN event_id % 11 = 0 THEN ' ' WHEN event_id % 13 = 0 THEN 'FAILURE PATTERN REMINDER again' ELSE 'fix it' END AS prompt FROM {events}
"""


@query(
    "stream_reminders",
    f"""WITH RECURSIVE e AS (SELECT * FROM ({_REMINDERS}) WHERE trim(prompt) <> '' AND NOT contains(prompt, 'FAILURE PATTERN REMINDER')),
o AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY at_ms, event_id) AS n FROM e),
w(host, n, event_id, allowed, clock) AS (SELECT host, n, event_id, true, at_ms FROM o WHERE n = 1
 UNION ALL SELECT o.host, o.n, o.event_id, o.at_ms - w.clock >= 30000, CASE WHEN o.at_ms - w.clock >= 30000 THEN o.at_ms ELSE w.clock END FROM w JOIN o ON o.host = w.host AND o.n = w.n + 1)
SELECT event_id FROM w WHERE allowed""",
)
def stream_reminders(spark, sf):
    prompts = A.view(spark, sf, _REMINDERS).select("host", "event_id", (F.col("at_ms") + 1000 * _DAY).alias("ts_millis"), "prompt")
    arriving, lateness = late_slices(prompts, "ts_millis", "event_id", "-end-", 1000)
    return streams.reminder_cooldown(arriving.fillna("end", "prompt"), new_folder(spark, "reminders"), lateness).select("event_id")


_SOURCES = """
SELECT concat('source ', CAST(CAST(floor(event_id / 700) AS BIGINT) AS STRING)) AS source, event_id, 86400 + event_id * 600 + CAST(floor(value) AS BIGINT) % 60 AS seconds FROM {events}
"""


@query("stream_flatline", f"SELECT source, max(seconds) * 1000 AS newest_ms FROM ({_SOURCES}) GROUP BY source")
def stream_flatline(spark, sf):
    """Every source falls silent in turn, while the next ones go on."""
    arriving, lateness = late_slices(A.view(spark, sf, _SOURCES), "seconds", "event_id", "-end-")
    return streams.run_available(streams.flatline(arriving.withColumn("ts", F.timestamp_seconds("seconds")), 30, lateness))


_LOGGED = """
SELECT event_id, user_id, event_type, value, CASE WHEN event_id % 17 = 3 THEN 'not json' WHEN event_id % 29 = 5 THEN '[1, 2' END AS odd FROM {events}
"""


@query(
    "drained_log",
    f"""WITH e AS ({_LOGGED}) SELECT 'clean' AS sink, event_id, user_id, event_type, value, NULL AS line FROM e WHERE odd IS NULL
 UNION ALL SELECT 'quarantine', NULL, NULL, NULL, NULL, odd FROM e WHERE odd IS NOT NULL""",
)
def drained_log(spark, sf):
    """All events as JSON lines with broken ones among them, drained in two calls: half of the files come in between."""
    view = A.view(spark, sf, _LOGGED)
    base = new_folder(spark, "log")
    line = F.coalesce("odd", F.to_json(F.struct("event_id", "user_id", "event_type", "value")))
    for half in (0, 1):
        own = view.where(F.pmod(F.xxhash64("event_id"), F.lit(2)) == half).select(line.alias("value"))
        own.repartition(spark.sparkContext.defaultParallelism).write.mode("append").text(f"{base}/in")
        clean, broken = streams.drain_log(spark, f"{base}/in", "event_id long, user_id long, event_type string, value double", f"{base}/out", 5)
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    rows = clean.select(F.lit("clean").alias("sink"), "event_id", "user_id", "event_type", "value", none("string", "line"))
    gone = broken.select(F.lit("quarantine").alias("sink"), none("long", "event_id"), none("long", "user_id"), none("string", "event_type"), none("double", "value"), "line")
    return rows.union(gone)
