"""Streams over split files equal the batch operators; state survives batches."""

import json

import pytest
from pyspark.sql import functions as F

from feedloom.functions import checks
from feedloom.operators import ratelimit
from feedloom.plans import adapters
from feedloom.streaming import streams

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def split_events(spark, tmp_path_factory):
    """The rating view as eight files in time order."""
    out = str(tmp_path_factory.mktemp("events"))
    df = adapters.view(spark, SF, adapters.RATINGS).withColumn("ts", F.col("ts").cast("timestamp"))
    df.repartitionByRange(8, "event_id").sortWithinPartitions("event_id").write.mode("overwrite").parquet(out)
    return out


def follow(spark, path, files=1):
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def rows(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


def test_checks_equal_batch(spark, split_events):
    live = streams.run_available(streams.stream_checks(follow(spark, split_events), "response_preview", ["event_id"]))
    batch = checks.score(spark.read.parquet(split_events), "response_preview", ["event_id"])
    assert rows(live, "event_id", "eval_id", "passed") == rows(batch, "event_id", "eval_id", "passed")


def arrive(spark, out, schema, *batches):
    """One file per batch, in order; the event time of the last one closes all others."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(out))
    return follow(spark, str(out))


CALLS = "host string, event_id long, ts_seconds long, command string"
OK = "gh pr review 3 --approve"


def test_rate_limit_does_not_depend_on_arrival(spark, tmp_path):
    """Files filled at random pass the same approvals as the batch operator."""
    base = spark.read.parquet(f"{SF}/events.parquet").selectExpr(
        "CAST(event_id % 2 AS STRING) AS host", "event_id", "1000 + event_id * 3 + CAST(value AS BIGINT) % 2 AS ts_seconds", f"'{OK}' AS command"
    )
    out = tmp_path / "calls"
    for i in range(4):
        base.where(F.pmod(F.xxhash64("event_id"), F.lit(4)) == i).coalesce(1).write.mode("append").parquet(str(out))
    calls = arrive(spark, out, CALLS, [("-", -1, 10**9, OK)])
    live = streams.approval_rate_limit(calls, str(tmp_path / "out"), "1 day")
    batch = ratelimit.rate_limited(base, "host", "ts_seconds", "event_id", 10, 600).where("allowed")
    assert rows(live, "event_id") == rows(batch, "event_id")


def test_rate_limit_drops_what_is_behind_the_watermark(spark, tmp_path):
    first, later = [("h", 1, 100, OK), ("h", 2, 5_000, OK)], [("h", 3, 50, OK), ("h", 4, 5_005, OK), ("h", 5, 5_010, OK)]
    calls = arrive(spark, tmp_path / "c", CALLS, first, [("h", 6, 6_000, OK)], later, [("-", 7, 10**9, OK)])
    live = streams.approval_rate_limit(calls, str(tmp_path / "out"), "20 minutes")
    assert sorted(r["event_id"] for r in live.collect()) == [1, 2, 5, 6]


def test_spacing_goes_on_after_a_restart_and_is_replay_safe(spark, tmp_path):
    """A key whose chain crosses batches, calls and many buckets; a replayed batch changes nothing."""
    schema = "key string, event_id long, at long"
    data = [("hot", k, 100_000 + 7 * k) for k in range(3000)] + [("b", 5000 + k, 100_000 + 1000 * k) for k in range(20)]
    out, folder = tmp_path / "in", str(tmp_path / "out")
    third = len(data) // 3
    for part in (data[:third], data[third : 2 * third]):
        spark.createDataFrame(part, schema).repartition(3).write.mode("append").parquet(str(out))
    streams.spaced(follow(spark, str(out), 2), 10, folder, lateness="2 days")
    spark.createDataFrame(data[2 * third :], schema).repartition(3).write.mode("append").parquet(str(out))
    spark.createDataFrame([("-", -1, 10**8)], schema).write.mode("append").parquet(str(out))
    live = streams.spaced(follow(spark, str(out), 2), 10, folder, lateness="2 days")
    batch = ratelimit.rate_limited(spark.createDataFrame(data, schema), "key", "at", "event_id", 10, 100).where("allowed")
    want = rows(batch, "event_id")
    assert rows(live, "event_id") == want and len(want) == 1520
    again = streams.spaced(follow(spark, str(out), 2), 10, folder, lateness="2 days")
    assert rows(again, "event_id") == want


def test_spacing_of_an_empty_stream(spark, tmp_path):
    (tmp_path / "none").mkdir()
    source = spark.readStream.schema("key string, event_id long, at long").parquet(str(tmp_path / "none"))
    assert streams.spaced(source, 10, str(tmp_path / "out")).count() == 0


def test_reminder_cooldown(spark, tmp_path):
    data = [("h", 1, 1, "a"), ("h", 2, 10_000, "b"), ("h", 3, 20_000, " "), ("h", 4, 30_001, "c"), ("h", 5, 70_000, "FAILURE PATTERN REMINDER x"), ("h", 6, 70_001, "d")]
    schema = "host string, event_id long, ts_millis long, prompt string"
    prompts = arrive(spark, tmp_path / "p", schema, data[3:], data[:3], [("-", 9, 10**12, "z")])
    assert sorted(r["event_id"] for r in streams.reminder_cooldown(prompts, str(tmp_path / "out")).collect()) == [1, 4, 6]


def test_turns_close_on_the_next_prompt_or_when_idle(spark, tmp_path):
    schema = "session string, t long, seq long, type string, text string, tools array<string>"
    later = [("s", 30, 3, "user", "next", None), ("s", 40, 4, "assistant", "x", ["Bash"])]
    early = [("s", 10, 1, "user", "hi", None), ("s", 20, 2, "assistant", None, ["Edit", "Grep", "Edit"]), ("s", 25, 2, "tool_result", "r" * 3000, None)]
    again = [("s", 90_000, 5, "user", "back", None), ("s", 90_000, 5, "user", "back", None), ("s", 90_001, 6, "tool_result", " ", None)]
    events = arrive(spark, tmp_path / "t", schema, later, early, again, [("-", 10**8, 1, "user", "end", None)])
    got = streams.run_available(streams.turn_state(events.withColumn("ts", F.timestamp_seconds("t"))))
    assert sorted(tuple(r) for r in got.collect()) == [
        ("s", 1, 0, "", ""), ("s", 1, 3, "Edit,Grep", "r" * 2000), ("s", 2, 1, "Bash", "")
    ]


def test_window_drops_late_rows(spark, tmp_path):
    out = tmp_path / "f"
    schema = "ts timestamp, pattern string, blocked boolean"
    # A batch judges lateness by the watermark of the batch before it.
    for lines in (["2024-01-01 00:00:00", "2024-01-05 00:00:00"], ["2024-01-06 00:00:00"], ["2024-01-01 12:00:00"], ["2024-01-20 00:00:00"]):
        spark.createDataFrame([(t, "p", True) for t in lines], "ts string, pattern string, blocked boolean").withColumn(
            "ts", F.to_timestamp("ts")
        ).coalesce(1).write.mode("append").parquet(str(out))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(out))
    got = streams.run_available(streams.fires_window(stream, "1 day", None, "10 minutes"))
    assert {(str(r["start"]), r["fires"]) for r in got.collect()} == {("2024-01-01 00:00:00", 1), ("2024-01-05 00:00:00", 1), ("2024-01-06 00:00:00", 1)}


def test_dedupe_by_content_and_by_name(spark, tmp_path):
    schema = "event_id long, ts_seconds long, name string, episode_body string"
    day = 86_400
    early = [(1, day, "n", "same"), (2, day + 3600, "m", "same"), (3, day + 7200, "n", "new")]
    late = [(4, 8 * day, "n", "same"), (5, 8 * day - 1, "o", "same")]
    episodes = arrive(spark, tmp_path / "e", schema, late, early, [(9, 10**9, "-", "-")])
    by = lambda c: sorted(r["event_id"] for r in streams.run_available(streams.stream_dedupe(episodes, c, lateness="8 days")).collect())
    assert by("content_hash") == [1, 3, 4]
    assert by("name") == [1, 2, 4, 5]


def test_flatline_reports_the_silent_source(spark, tmp_path):
    out = tmp_path / "r"
    for batch in ([("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:00:00")], [("b", "2024-01-05 00:00:00")], [("b", "2024-01-05 06:00:00")]):
        spark.createDataFrame(batch, "source string, t string").select("source", F.to_timestamp("t").alias("ts")).coalesce(1).write.mode("append").parquet(str(out))
    got = streams.run_available(streams.flatline(follow(spark, str(out)), 2)).collect()
    assert [r["source"] for r in got] == ["a"]


def test_prompt_routes_write_two_tables_once(spark, tmp_path):
    out = str(tmp_path / "in")
    long = "x" * 250
    data = [("8 - nice", None, None, long), ("Great job!", None, None, long), ("hm", None, None, long), ("tell me more", 3, 0.9, long),
            ("tell me more", None, 0.9, long), ("tell me more", None, 0.9, "short"), ("<system-reminder> 9", None, None, long)]
    spark.createDataFrame(data, "prompt string, sentiment_rating int, sentiment_confidence double, response string").write.parquet(out)
    routed = streams.route_prompts(follow(spark, out, 10))
    kept, judged = str(tmp_path / "kept"), str(tmp_path / "judged")
    query = streams.write_routes(routed, kept, judged, str(tmp_path / "ck"))
    query.awaitTermination()
    assert sorted((r["rating"], r["source"]) for r in spark.read.parquet(kept).collect()) == [(3, "implicit"), (8, "explicit"), (8, "implicit")]
    assert spark.read.parquet(judged).count() == 1


def test_tail_log(spark, tmp_path):
    d = tmp_path / "log"
    d.mkdir()
    (d / "a.jsonl").write_text(json.dumps({"pattern": "p", "mode": "warn"}) + "\n{broken\n")
    got = streams.run_available(streams.tail_log(spark, str(d), "pattern string, mode string"))
    assert [r["pattern"] for r in got.collect()] == ["p"]


@pytest.fixture(scope="module")
def folder_tables(spark, tmp_path_factory):
    """Tables that are folders of files, as a writer other than the test data's leaves them."""
    base = tmp_path_factory.mktemp("tables")
    for t in ("documents", "events"):
        spark.read.parquet(f"{SF}/{t}.parquet").repartition(3).write.parquet(str(base / f"{t}.parquet"))
    return str(base)


@pytest.mark.parametrize("name", ["stream_prompt_sinks", "stream_prompt_routes", "stream_policy"])
def test_streams_read_tables_that_are_folders(spark, folder_tables, name):
    from feedloom.plans.catalog import QUERIES

    got, want = QUERIES[name](spark, folder_tables), QUERIES[name](spark, SF)
    assert rows(got, *want.columns) == rows(want, *want.columns) != []


def test_routes_of_an_empty_stream(spark, tmp_path):
    (tmp_path / "none").mkdir()
    source = spark.readStream.schema("prompt string, sentiment_rating int, sentiment_confidence double, response string").parquet(str(tmp_path / "none"))
    kept, judged = str(tmp_path / "kept"), str(tmp_path / "judged")
    streams.write_routes(streams.route_prompts(source), kept, judged, str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(kept).count() == spark.read.parquet(judged).count() == 0


@pytest.fixture(scope="module")
def far_events(spark, tmp_path_factory):
    """Events whose ids, which stand in for their times, span fifty times as many years."""
    base = tmp_path_factory.mktemp("far")
    events = spark.read.parquet(f"{SF}/events.parquet")
    copies = [events.withColumn("event_id", F.col("event_id") + k * 1_000_000) for k in (0, 1, 2, 6)]
    for c in copies:
        c.coalesce(1).write.mode("append").parquet(str(base / "events.parquet"))
    return str(base)


def test_the_last_row_ends_a_stream_of_many_years(spark, far_events):
    from feedloom.plans import queries_stream
    from feedloom.plans.catalog import QUERIES

    want = adapters.view(spark, far_events, queries_stream._SOURCES).groupBy("source").agg((F.max("seconds") * 1000).alias("newest_ms"))
    assert rows(QUERIES["stream_flatline"](spark, far_events), "source", "newest_ms") == rows(want, "source", "newest_ms")
    kept = adapters.view(spark, far_events, queries_stream._EPISODES)
    for key in ("episode_body", "name"):
        kept = ratelimit.rate_limited(kept, key, "ts_seconds", "event_id", 7 * 86_400, 10**8).where("allowed").drop("allowed")
    assert rows(QUERIES["stream_dedupe"](spark, far_events), "event_id") == rows(kept, "event_id")


def test_spacing_with_buckets_taken_together(spark, tmp_path, monkeypatch):
    """Whole chains in one group, across batches that end inside such a group; ten times as few groups as buckets."""
    from feedloom.operators import ratelimit as operator

    schema = "key string, event_id long, at long"
    data = [("a", k, 100_000 + 3 * k + k % 2) for k in range(2000)] + [("b", 5000 + k, 100_000 + 11 * k) for k in range(500)]
    out, groups = tmp_path / "in", []
    real = operator.allowed_marks

    def seen(marks, gap, bucket, clocks=None):
        groups.append((bucket, marks.count()))
        return real(marks, gap, bucket, clocks)

    monkeypatch.setattr(operator, "allowed_marks", seen)
    data.sort(key=lambda r: r[2])
    for i in range(4):
        spark.createDataFrame(data[i * 625 : (i + 1) * 625], schema).coalesce(1).write.mode("append").parquet(str(out))
    spark.createDataFrame([("-", -1, 10**8)], schema).write.mode("append").parquet(str(out))
    live = streams.spaced(follow(spark, str(out), 1), 10, str(tmp_path / "out"), lateness="30 seconds")
    chains = [bucket for bucket, n in groups if n]
    assert len(chains) > 2 and min(chains) >= 1000
    batch = ratelimit.rate_limited(spark.createDataFrame(data, schema), "key", "at", "event_id", 10, 100).where("allowed")
    assert rows(live, "event_id") == rows(batch, "event_id")
