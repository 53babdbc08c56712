"""Structured Streaming forms.

Stateless operators reuse the batch Columns, so a stream and a batch run give the same
rows.  Stateful ones decide in the order of event time: rows are held until the watermark is
past them, state is one small record per key, and idle keys leave it.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from feedloom.fixed_values import (
    APPROVAL_GAP_SECONDS,
    EVIDENCE_CHARS,
    EVIDENCE_ITEMS,
    REMINDER_GAP_SECONDS,
    RESULT_CHARS,
    SELF_MARKER,
)
from feedloom.functions import capture, checks, detectors
from feedloom.functions.regex import strip
from feedloom.functions.text import content_hash
from feedloom.operators import policy, ratelimit
from feedloom.session import ensure_checkpoint_dir
from feedloom.sources.readers import parsed_lines


CHAIN_ROWS = 50_000  # at most so many times of a key in a group of ``spaced``, or one bucket of them


# --- running ---------------------------------------------------------------------------------


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process what is there, write it next to the checkpoints, and read it back."""
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def tail_log(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int | None = None) -> DataFrame:
    """Follow a directory of append-only JSON lines; malformed lines become null rows and are dropped."""
    reader = spark.readStream.schema(schema).option("mode", "PERMISSIVE")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.json(path)
    some = F.lit(False)
    for c in rows.columns:
        some = some | F.col(c).isNotNull()
    return rows.where(some)


def drain_log(spark: SparkSession, path: str, schema: str, folder: str, files_per_batch: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Take in what a directory of JSON lines holds now: (clean rows so far, quarantined lines so far).

    A line that is no object of the schema goes to quarantine with its file.  ``folder`` holds both tables and the checkpoint;
    a batch writes folders of its own number, so a replay after a failure leaves no duplicates, and a later call
    takes in the files that came since.
    """
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else spark.readStream
    lines = reader.text(path).select(F.col("value").alias("_line"), F.col("_metadata.file_path").alias("_file")).where(strip(F.col("_line")) != "")
    parsed = parsed_lines(lines, schema, "_line")
    fields = [c for c in parsed.columns if c not in ("_line", "_file", "_corrupt")]
    clean, broken = f"{folder}/clean", f"{folder}/quarantine"

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        batch.where("_corrupt IS NULL").select(*fields).write.mode("overwrite").parquet(f"{clean}/batch={batch_id}")
        batch.where("_corrupt IS NOT NULL").select("_file", "_line").write.mode("overwrite").parquet(f"{broken}/batch={batch_id}")
        batch.unpersist()

    empty = spark.createDataFrame([], parsed.schema)
    save(empty, -1)  # there from the start
    query = parsed.writeStream.foreachBatch(save).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    read = lambda at, columns: spark.read.schema(empty.select(*columns).schema).option("basePath", at).parquet(at).select(*columns)
    return read(clean, fields), read(broken, ["_file", "_line"]).toDF("file", "line")


# --- stateless ---------------------------------------------------------------------------------


def stream_checks(responses: DataFrame, text: str, keep: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Fired checks of each response as it lands.

    ``partitions`` spreads batches that arrive as few large files.
    """
    return checks.score(responses.repartition(partitions) if partitions else responses, text, keep)


def stream_fires(responses: DataFrame, text: str, keep: Sequence[str], armed: DataFrame) -> DataFrame:
    """Detector fires of each response; the armed modes are a static table."""
    return detectors.enforce(responses, text, keep, armed)


def stream_policy(calls: DataFrame, rules: Sequence[policy.Rule]) -> DataFrame:
    """Verdict events for tool calls that are not simply allowed."""
    return policy.policy_verdict(calls, rules).where(F.col("verdict") != "allow")


def route_prompts(prompts: DataFrame) -> DataFrame:
    """Add ``rating, comment, source, confidence, route`` to a stream of prompts.

    Explicit ratings and short praise are rated at once.  System text and very short
    prompts are dropped.  The rest carry the outcome of an outside sentiment step in
    ``sentiment_rating`` and ``sentiment_confidence`` and are kept, judged or dropped.
    """
    p = F.col("prompt")
    staged = prompts.withColumn("_e", capture.explicit_rating(p)).withColumn("_praise", capture.praise_rating(p))
    skipped = capture.is_too_short(p) | capture.is_system_text(p)
    implicit = capture.implicit_route(F.col("sentiment_rating"), F.col("sentiment_confidence"), F.col("response"))
    route = (
        F.when(F.col("_e").isNotNull(), "keep")
        .when(skipped, "drop")
        .when(F.col("_praise").isNotNull(), "keep")
        .otherwise(implicit)
    )
    rating = F.coalesce(F.col("_e.rating"), F.when(~skipped, F.coalesce("_praise", "sentiment_rating")))
    return (
        staged.withColumn("route", route)
        .withColumn("rating", F.when(F.col("route") == "keep", rating))
        .withColumn("comment", F.col("_e.comment"))
        .withColumn("source", F.when(F.col("_e").isNotNull(), "explicit").otherwise("implicit"))
        .withColumn(
            "confidence",
            F.when(F.col("_e").isNotNull(), F.lit(None).cast("double"))
            .when(F.col("_praise").isNotNull(), 0.95)
            .otherwise(F.col("sentiment_confidence")),
        )
        .drop("_e", "_praise")
    )


def write_routes(routed: DataFrame, ratings_path: str, judge_path: str, checkpoint: str):
    """Start a query with two sinks.  A batch overwrites its own folder, so a replay
    after a failure leaves no duplicates."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        batch.where("route = 'keep'").write.mode("overwrite").parquet(f"{ratings_path}/batch={batch_id}")
        batch.where("route = 'judge'").write.mode("overwrite").parquet(f"{judge_path}/batch={batch_id}")
        batch.unpersist()

    save(routed.sparkSession.createDataFrame([], routed.schema), -1)  # there from the start
    return (
        routed.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


# --- windows ----------------------------------------------------------------------------


def fires_window(
    fires: DataFrame, length: str = "14 days", slide: str | None = "1 day", lateness: str = "10 minutes"
) -> DataFrame:
    """Fires per pattern and window; rows later than the watermark are dropped."""
    win = F.window("ts", length, slide) if slide else F.window("ts", length)
    return (
        fires.withWatermark("ts", lateness)
        .groupBy(win, "pattern")
        .agg(F.count(F.lit(1)).alias("fires"), F.count_if("blocked").alias("blocked"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "pattern", "fires", "blocked")
    )


# --- stateful -----------------------------------------------------------------------------------------


def _waiting(held: Sequence, names: Sequence[str], chunks: Iterator[pd.DataFrame], same: int) -> list[tuple]:
    """Rows held so far (a list per column) and new ones in the order of their first two columns, one of those whose
    first ``same`` columns are equal.  Plain tuples: a key has few rows, for which a frame costs more than its rows."""
    rows = list(zip(*held))
    for chunk in chunks:
        rows += zip(*(chunk[n].tolist() for n in names))
    rows.sort(key=lambda r: (r[0], r[1] is None, r[1]))
    return [r for i, r in enumerate(rows) if i == 0 or r[:same] != rows[i - 1][:same]]


def _columns(rows: list[tuple], names: Sequence[str]) -> list[list]:
    return [list(c) for c in zip(*rows)] if rows else [[] for _ in names]


def _gap_filter(gap: int, unit_ms: int, names: Sequence[str]):
    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, *held = state.get if state.exists else (None, *([] for _ in names))
        now = state.getCurrentWatermarkMs()
        rows = _waiting(held, names, () if state.hasTimedOut else chunks, 1)
        at = np.array([r[0] for r in rows], dtype="int64")
        ready, passed = int(np.searchsorted(at, now // unit_ms, side="right")), []
        while (i := 0 if last is None else int(np.searchsorted(at[:ready], last + gap))) < ready:
            passed.append(i)
            last = int(at[i])
        open_at = int(at[ready]) if ready < len(at) else last + gap
        if open_at * unit_ms > now:
            state.update((last, *_columns(rows[ready:], names)))
            state.setTimeoutTimestamp(open_at * unit_ms)
        elif state.exists:
            state.remove()
        if passed:
            yield pd.DataFrame([(key[0], *rows[i]) for i in passed], columns=["key", *names])

    return step


def min_gap(
    events: DataFrame, gap: int, unit_ms: int = 1000, lateness: str = "10 minutes", carry: Sequence[str] = ()
) -> DataFrame:
    """``key, event_id, at`` to the events that pass: at least ``gap`` since the last one of the
    key that passed.  An event that does not pass leaves the clock as it is.

    ``at`` counts units of ``unit_ms`` milliseconds; ``carry`` names columns that go along.  Events
    are held until the watermark is past them and are then decided in the order of their own times, so
    the arrival order makes no difference; the lowest id stands for those of a key at one time.  Events behind the
    watermark do not pass.  A key's state holds its last time and one event for each distinct time the watermark
    has not passed; it goes once the watermark is past the gap.
    """
    names = ["at", "event_id", *carry]
    timed = events.withColumn("ts", F.timestamp_millis(F.col("at") * unit_ms)).withWatermark("ts", lateness)
    rows = timed.select("key", *names, "ts")
    types = dict(rows.dtypes)
    return rows.groupBy("key").applyInPandasWithState(
        _gap_filter(gap, unit_ms, names),
        ", ".join(f"{n} {types[n]}" for n in ["key", *names]),
        "last long, " + ", ".join(f"held_{n} array<{types[n]}>" for n in names),
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def spaced(
    events: DataFrame, gap: int, folder: str, unit_ms: int = 1000, bucket: int | None = None, lateness: str = "10 minutes"
) -> DataFrame:
    """``min_gap`` for keys that may hold most of the stream: run what is available, give all that passed so far.

    A native aggregation on (key, time bucket, time) keeps the lowest id of each time until the watermark is past the
    bucket, so the rows of a hot key lie in many partitions.  Each micro-batch of closed buckets is then reduced to a step
    function per bucket, the functions are chained per key from the last allowed time, and the times are marked in the
    buckets again: no task holds a key's events.  ``folder``, which all executors share, holds the results
    (``passed``), the last allowed times after each batch (``clocks``) and the stream's checkpoint.  A batch writes
    folders of its own number, so a replay changes nothing, and a later call goes on where this one ended.

    ``at`` counts units of ``unit_ms`` milliseconds, ``bucket`` (ten gaps unless given) as many units.  A decision comes when
    its bucket has closed.  A key's last time goes once no open bucket can lie within the gap.
    """
    bucket = bucket or 10 * gap
    spark = events.sparkSession
    timed = events.withColumn("ts", F.timestamp_millis(F.col("at") * unit_ms)).withWatermark("ts", lateness)
    span = F.window("ts", f"{bucket * unit_ms} milliseconds")
    marks = timed.groupBy(span, F.col("key").alias("_key"), F.col("at").alias("_t")).agg(F.min("event_id").alias("_tie"))
    marks = marks.select("_key", "_t", "_tie")
    clock_type = f"_key {dict(marks.dtypes)['_key']}, _last long"

    def decide(batch: DataFrame, batch_id: int) -> None:
        session, closed = batch.sparkSession, batch.persist()
        known = session.read.schema(clock_type).parquet(f"{folder}/clocks/batch={batch_id - 1}") if batch_id else None
        # Sparse buckets go together, so that a group of the chain is worth its fixed cost.
        most = closed.groupBy("_key", F.floor(F.col("_t") / bucket)).count().agg(F.max("count")).first()[0]
        together = max(1, CHAIN_ROWS // (most or 1))
        allowed = ratelimit.allowed_marks(closed, gap, together * bucket, known).join(closed, ["_key", "_t"])
        result = f"{folder}/passed/batch={batch_id}"
        allowed.select(F.col("_key").alias("key"), F.col("_tie").alias("event_id"), F.col("_t").alias("at")).write.mode("overwrite").parquet(result)
        passed = session.read.schema(schema).parquet(result).select(F.col("key").alias("_key"), F.col("at").alias("_last"))
        last = (passed if known is None else passed.unionByName(known)).groupBy("_key").agg(F.max("_last").alias("_last"))
        newest = closed.agg(F.max(F.floor(F.col("_t") / bucket) * bucket)).first()[0]
        if newest is not None:
            last = last.where(F.col("_last") + gap > newest)
        last.write.mode("overwrite").parquet(f"{folder}/clocks/batch={batch_id}")
        closed.unpersist()

    types = dict(marks.dtypes)
    schema = f"key {types['_key']}, event_id {types['_tie']}, at {types['_t']}"
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/passed/batch=-1")  # there from the start
    started = marks.writeStream.outputMode("append").foreachBatch(decide).option("checkpointLocation", f"{folder}/checkpoint")
    started.trigger(availableNow=True).start().awaitTermination()
    passed = spark.read.schema(schema).option("basePath", f"{folder}/passed").parquet(f"{folder}/passed")
    return passed.select("key", "event_id", "at")


def approvals(calls: DataFrame) -> DataFrame:
    """key, event_id, at (seconds) of the approvals among ``calls`` (host, event_id, ts_seconds, command)."""
    flagged = policy.tool_event_flags(
        calls.withColumn("file_path", F.lit("")).withColumn("content", F.lit("")).withColumn("tool_name", F.lit("Bash"))
    ).where("is_approval")
    return flagged.select(F.col("host").alias("key"), "event_id", F.col("ts_seconds").cast("long").alias("at"))


def approval_rate_limit(calls: DataFrame, folder: str, lateness: str = "10 minutes") -> DataFrame:
    """The approvals of each host that are let through; any other within ten seconds after one is denied.

    ``calls``: host, event_id, ts_seconds, command.
    """
    return spaced(approvals(calls), APPROVAL_GAP_SECONDS, folder, 1000, lateness=lateness)


def reminder_cooldown(prompts: DataFrame, folder: str, lateness: str = "10 minutes") -> DataFrame:
    """Prompts that get a reminder: not blank, not the reminder itself, thirty seconds apart.

    ``prompts``: host, event_id, ts_millis, prompt.
    """
    usable = prompts.where((strip(F.col("prompt")) != "") & ~F.col("prompt").contains(SELF_MARKER))
    keyed = usable.select(F.col("host").alias("key"), "event_id", F.col("ts_millis").cast("long").alias("at"))
    return spaced(keyed, REMINDER_GAP_SECONDS * 1000, folder, 1, lateness=lateness)


def stream_dedupe(
    episodes: DataFrame, by: str = "content_hash", horizon: int = 7 * 86_400, lateness: str = "1 hour"
) -> DataFrame:
    """Episodes whose content (or whose ``name``) was not taken within ``horizon`` seconds before.

    ``episodes``: event_id, ts_seconds, name, episode_body.  The two rules have different keys, so
    they are two streams, the second over the files of the first.
    """
    hashed = episodes.withColumn("content_hash", content_hash(F.col("episode_body")))
    keyed = hashed.withColumn("key", F.col(by)).withColumn("at", F.col("ts_seconds").cast("long"))
    passed = min_gap(keyed, horizon, 1000, lateness, ["name", "episode_body"])
    return passed.select("event_id", F.col("at").alias("ts_seconds"), "name", "episode_body")


def _silence(limit_ms: int):
    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            newest = state.get[0]
            state.remove()
            yield pd.DataFrame({"source": [key[0]], "newest_ms": [newest]})
            return
        newest = state.get[0] if state.exists else 0
        for rows in chunks:
            newest = max(newest, int(rows["ms"].max()))
        state.update((newest,))
        state.setTimeoutTimestamp(max(newest + limit_ms, state.getCurrentWatermarkMs() + 1))

    return step


def flatline(ratings: DataFrame, days: int = 2, lateness: str = "1 hour") -> DataFrame:
    """(source, newest_ms): sources whose newest rating is ``days`` old in event time.

    ``ratings``: source, ts.  The watermark is moved by all sources, so one that falls
    silent is reported while others go on.
    """
    timed = ratings.withWatermark("ts", lateness).select("source", "ts", F.unix_millis("ts").alias("ms"))
    return timed.groupBy("source").applyInPandasWithState(
        _silence(days * 86_400_000),
        "source string, newest_ms long",
        "newest long",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


_TURN_COLUMNS = ["ms", "seq", "kind", "text", "tools"]


def _turns(idle_ms: int):
    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turn, n_tools, tools, evidence, last, *held = state.get if state.exists else (0, 0, [], [], None, *([] for _ in _TURN_COLUMNS))
        tools, evidence, done = list(tools), list(evidence), []
        now = state.getCurrentWatermarkMs()
        rows = _waiting(held, _TURN_COLUMNS, () if state.hasTimedOut else chunks, 2)
        ready = bisect_right(rows, now, key=lambda r: r[0])

        def close() -> None:
            if turn > 0:
                done.append((key[0], turn, n_tools, ",".join(tools), "\n---\n".join(evidence)[-EVIDENCE_CHARS:]))

        for ms, _seq, kind, text, called in rows[:ready]:
            if last is not None and ms - last >= idle_ms:
                close()
                turn, n_tools, tools, evidence = 0, 0, [], []
            last = ms
            if kind == "prompt":
                close()
                turn, n_tools, tools, evidence = turn + 1, 0, [], []
            elif kind == "tools":
                named = called.split(",")
                n_tools += len(named)
                tools += [t for t in dict.fromkeys(named) if t not in tools]
            else:
                evidence = [*evidence, text][-EVIDENCE_ITEMS:]
        rest = rows[ready:]
        if last is not None and last + idle_ms <= now:
            close()
            turn, n_tools, tools, evidence, last = 0, 0, [], [], None
        ends = [rest[0][0]] if rest else []
        ends += [last + idle_ms] if last is not None else []
        if ends:
            state.update((turn, n_tools, tools, evidence, last, *_columns(rest, _TURN_COLUMNS)))
            state.setTimeoutTimestamp(min(ends))
        elif state.exists:
            state.remove()
        if done:
            yield pd.DataFrame(done, columns=["session", "turn_no", "n_tools", "tools", "evidence"])

    return step


def turn_state(events: DataFrame, idle_seconds: int = 86_400, lateness: str = "10 minutes") -> DataFrame:
    """Turns, given out when the session's next prompt comes or the session has been idle.

    ``events``: session, ts, seq, type, text, tools.  Rows are held until the watermark is past them
    and then taken in the order of ``ts`` and ``seq``; rows behind the watermark are dropped and a repeated row counts
    once.  After ``idle_seconds`` a session is over; a later row of it starts at turn 1.  The state
    holds the open turn (a count, the distinct tool names in order of first use, at most forty cut results) and
    the cut rows that the watermark has not passed.
    """
    text = F.coalesce("text", F.lit(""))
    tools = F.filter(F.coalesce("tools", F.array().cast("array<string>")), lambda t: t != "")
    said = strip(text) != ""
    kind = (
        F.when((F.col("type") == "user") & said, "prompt")
        .when((F.col("type") == "assistant") & (F.size(tools) > 0), "tools")
        .when((F.col("type") == "tool_result") & said, "result")
    )
    rows = events.withWatermark("ts", lateness).select(
        "session",
        "ts",
        F.unix_millis("ts").alias("ms"),
        F.col("seq").cast("long").alias("seq"),
        kind.alias("kind"),
        F.when(kind == "result", F.substring(text, 1, RESULT_CHARS)).alias("text"),
        F.when(kind == "tools", F.array_join(tools, ",")).alias("tools"),
    )
    return rows.where("kind IS NOT NULL").groupBy("session").applyInPandasWithState(
        _turns(idle_seconds * 1000),
        "session string, turn_no long, n_tools long, tools string, evidence string",
        "turn long, n_tools long, names array<string>, evidence array<string>, last long, "
        "held_ms array<long>, held_seq array<long>, held_kind array<string>, held_text array<string>, held_tools array<string>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
