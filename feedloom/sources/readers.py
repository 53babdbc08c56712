"""Readers: logs, lessons, failure captures, transcripts, fixtures, graphs and corpora."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedloom.fixed_values import FILE_KINDS
from feedloom import schemas
from feedloom.functions.regex import strip
from feedloom.operators.classify import domain_flags
from feedloom.operators.measure import frozen_epoch
from feedloom.operators.policy import COMMAND_TIERS, PATH_TIERS, Rule

_EMPTY = "array<string>"


def read_jsonl(spark: SparkSession, path: str, schema: str, malformed: str = "skip") -> DataFrame:
    """JSON lines with a declared schema; malformed lines are skipped, or raise."""
    mode = {"skip": "DROPMALFORMED", "raise": "FAILFAST"}[malformed]
    return spark.read.schema(schema).option("mode", mode).json(path)


def read_ratings(spark: SparkSession, path: str, malformed: str = "raise") -> DataFrame:
    """Ratings with defaults filled in; rows without a rating are dropped."""
    raw = read_jsonl(spark, path, schemas.RATINGS, malformed)
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    many = lambda c: F.coalesce(F.col(c), F.array().cast(_EMPTY)).alias(c)
    empty_map = F.create_map().cast("map<string, struct<passed: boolean, pattern: string>>")
    return raw.where(F.col("rating").isNotNull()).select(
        text("timestamp"),
        F.substring(F.coalesce("timestamp", F.lit("")), 1, 10).alias("event_date"),
        F.col("rating").cast("double").cast("int").alias("rating"),
        text("session_id"),
        text("source"),
        text("sentiment_summary"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        text("response_preview"),
        text("comment"),
        many("tools_used"),
        many("files_touched"),
        text("repo"),
        text("skill"),
        many("skill_candidates"),
        text("agent"),
        F.coalesce("eval_results", empty_map).alias("eval_results"),
    )


def _field(text: Column, key: str, value: str) -> Column:
    return F.regexp_extract(text, rf"(?m)^\s*{key}:\s*({value})", 1)


def _file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.[^./]+\z", 1)


def read_lessons(spark: SparkSession, path: str) -> DataFrame:
    """Lesson files: front matter, the rule, its evidence and the measurement date."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    t = F.col("value")
    parts = F.split(t, "---", 3)
    body = F.regexp_replace(F.coalesce(F.get(parts, F.lit(2)), t), r"^\n+", "")
    day = r"\d{4}-\d{2}-\d{2}"
    step = files.withColumn("_body", body)
    lines = F.transform(F.split("_body", "\n"), strip)
    is_rule = lambda x: (x != "") & ~x.rlike(r"^(\*\*|#|<!--)")
    evidence = F.transform(
        F.slice(F.filter(lines, lambda x: x.rlike(r"^-\s*\[\d")), 1, 6),
        lambda x: F.substring(strip(F.regexp_replace(x, r"^-\s*\[\d+\]\s*", "")), 1, 200),
    )
    named = _field(t, "pattern", r"\S+")
    from_file = F.regexp_replace(_file_stem(F.col("path")), "^lesson_autogen_", "")
    return step.select(
        F.when(named != "", named).otherwise(from_file).alias("pattern"),
        F.substring(F.coalesce(F.get(F.filter(lines, is_rule), F.lit(0)), F.lit("")), 1, 400).alias("rule"),
        strip(F.element_at(F.split("_body", "\n\n", 2), 1)).alias("first_paragraph"),
        F.coalesce(F.expr(r"try_cast(regexp_extract(value, r'(?m)^\s*occurrence_count:\s*(\d+)', 1) AS INT)"), F.lit(0)).alias(
            "occurrence_count"
        ),
        F.coalesce(F.expr(r"try_cast(regexp_extract(value, r'(?m)^\s*avg_rating:\s*([\d.]+)', 1) AS DOUBLE)"), F.lit(0.0)).alias(
            "avg_rating"
        ),
        _field(t, "first_seen", day).alias("first_seen"),
        _field(t, "last_updated", day).alias("last_updated"),
        frozen_epoch(_field(t, "baseline_date", day), _field(t, "first_seen", day), _field(t, "last_updated", day)).alias(
            "baseline_date"
        ),
        _field(t, "content_version", r"\S+").alias("content_version"),
        F.filter(evidence, lambda x: x != "").alias("evidence"),
        F.substring(strip(F.regexp_extract("_body", r"\*\*Root cause:\*\*\s*(.+)", 1)), 1, 300).alias("root_cause"),
        F.substring(strip(F.regexp_extract("_body", r"\*\*Where it happens:\*\*\s*(.+)", 1)), 1, 200).alias("where_"),
        t.alias("content"),
        "path",
    )


def read_failures(spark: SparkSession, path: str, domain: str = "all") -> DataFrame:
    """Failure captures ``<month>/<slug>/CONTEXT.md`` in the shape of ratings."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "CONTEXT.md").text(
        path, wholetext=True
    )
    named = files.select(
        "value", F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/CONTEXT\.md\z", 1).alias("name")
    )
    review, data = domain_flags(F.col("name"))
    keep = {"all": F.lit(True), "failures": F.lit(True), "pr_review": review, "dag": data}[domain]
    t = F.col("value")
    summary = strip(F.regexp_extract(t, r"(?id)Summary:\s*(.+)", 1))
    spoken = F.substring(F.translate("name", "-_", "  "), 20, 1 << 30)
    happened = strip(F.regexp_extract(t, r"(?s)## What Happened\s*\n\n(.+?)(?=\n---|\n##)", 1))
    # 'yyyy-MM-dd-HHmmss' at the start of the name: the first two dashes become 'T', the rest ':'.
    head = F.substring("name", 1, 19)
    pieces = F.split(head, "-", 3)
    stamp = F.concat(
        F.get(pieces, F.lit(0)), F.lit("T"), F.get(pieces, F.lit(1)), F.lit("T"), F.replace(F.get(pieces, F.lit(2)), F.lit("-"), F.lit(":"))
    )
    return named.where(keep).select(
        F.coalesce(stamp, head).alias("timestamp"),
        F.coalesce(F.expr(r"try_cast(regexp_extract(value, r'(?i)rating:\s*(\d+)', 1) AS INT)"), F.lit(3)).alias("rating"),
        F.col("name").alias("session_id"),
        F.lit("failures_dir").alias("source"),
        F.when(summary != "", F.substring(summary, 1, 120)).otherwise(spoken).alias("sentiment_summary"),
        F.lit(0.9).alias("confidence"),
        F.substring(happened, 1, 200).alias("response_preview"),
        F.lit("").alias("comment"),
    )


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines ``file, line, value``; ``line`` counts from 0 in each file, whatever the splits are.

    Lines of a split come in order, so a line's place in its split is its row number less the first one there; the number
    of lines in the splits before it comes from a prefix sum over one row per split.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row")
    )
    splits = lines.groupBy("file", "_start").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    placed = splits.select("file", "_start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return lines.join(placed, ["file", "_start"]).select("file", (F.col("_before") + F.col("_row") - F.col("_first")).alias("line"), "value")


def parsed_lines(lines: DataFrame, schema: str, text: str = "value") -> DataFrame:
    """Add the fields of JSON lines and ``_corrupt``: the text of a line that is no object of the schema, else null."""
    row = F.from_json(text, f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return lines.withColumn("_row", row).select(*lines.columns, "_row.*")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Transcript rows ``session, seq, type, cwd, text, tools, blocks``.

    Content may be a string or an array of blocks.  ``seq`` is the line's number in its file; malformed lines
    keep their number and give no row (``transcript_quarantine`` lists them).
    """
    lines = parsed_lines(numbered_lines(spark, path).where(strip(F.col("value")) != ""), schemas.TRANSCRIPT_LINE)
    placed = lines.where("_corrupt IS NULL").select("*", _file_stem(F.col("file")).alias("session"))
    seq = F.col("line")
    content = F.col("message.content")
    blocks = F.when(content.startswith("["), F.from_json(content, schemas.BLOCKS))
    step = placed.select("session", seq.alias("seq"), "type", "cwd", content.alias("_content"), blocks.alias("blocks"))
    of_type = lambda kind: F.filter("blocks", lambda b: b["type"] == kind)
    spoken = F.array_join(F.transform(of_type("text"), lambda b: F.coalesce(b["text"], F.lit(""))), " ")
    results = F.array_join(
        F.transform(of_type("tool_result"), lambda b: F.coalesce(b["content"], b["text"], F.lit(""))), "\n"
    )
    text = F.when(F.col("blocks").isNull(), F.coalesce("_content", F.lit(""))).otherwise(spoken)
    only_results = (F.col("type") == "user") & (strip(text) == "") & (F.size(of_type("tool_result")) > 0)
    none = F.array().cast(_EMPTY)
    return step.select(
        "session",
        "seq",
        F.when(only_results, "tool_result").otherwise(F.col("type")).alias("type"),
        "cwd",
        F.when(only_results, results).otherwise(text).alias("text"),
        F.coalesce(F.transform(of_type("tool_use"), lambda b: b["name"]), none).alias("tools"),
        "blocks",
    )


def transcript_quarantine(spark: SparkSession, path: str) -> DataFrame:
    """``session, seq, value`` of the lines that ``read_transcripts`` can't read."""
    lines = parsed_lines(numbered_lines(spark, path).where(strip(F.col("value")) != ""), schemas.TRANSCRIPT_LINE)
    return lines.where("_corrupt IS NOT NULL").select(_file_stem(F.col("file")).alias("session"), F.col("line").alias("seq"), "value")


def transcript_blocks(transcript: DataFrame) -> DataFrame:
    """One row per content block; plain text rows count as one text block."""
    plain = F.array(
        F.named_struct(F.lit("type"), F.lit("text"), F.lit("name"), F.lit(None).cast("string"), F.lit("text"), F.col("text"))
    )
    listed = F.transform(
        "blocks", lambda b: F.named_struct(F.lit("type"), b["type"], F.lit("name"), b["name"], F.lit("text"), b["text"])
    )
    return transcript.select(
        "session", "seq", F.col("type").alias("role"), F.posexplode(F.coalesce(listed, plain)).alias("pos", "_b")
    ).select("session", "seq", "role", "pos", "_b.*")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Held-in or held-out cases, one row each."""
    return (
        spark.read.schema(schemas.CASES).option("multiLine", "true").json(path)
        .select("split", F.inline("cases"))
    )


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(schemas.SCENARIOS).option("multiLine", "true").json(path).select(F.inline("scenarios"))
    none = F.array().cast(_EMPTY)
    return (
        rows.withColumn("must_not_match", F.coalesce("must_not_match", none))
        .withColumn("must_match_any", F.coalesce("must_match_any", none))
        .withColumn("expect", F.coalesce("eval_expect", F.create_map().cast(schemas.EXPECTATION)))
        .drop("eval_expect")
    )


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, hyperedges) of node-link JSON; edges may be called links."""
    raw = spark.read.schema(schemas.GRAPH).option("multiLine", "true").json(path)
    return (
        raw.select(F.inline("nodes")),
        raw.select(F.inline(F.coalesce("edges", "links"))),
        raw.select(F.inline("hyperedges")).withColumnRenamed("nodes", "members"),
    )


MAX_WORDS, MAX_FILES = 2_000_000, 200


def _kind(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)\z", 1))
    kind = F.lit("other")
    for name, suffixes in FILE_KINDS.items():
        kind = F.when(suffix.isin(*suffixes), name).otherwise(kind)
    return kind


def corpus_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Files and words per kind.

    File names and sizes come from metadata alone; words are counted line by line over
    the text kinds, so a large file is split like any other input.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        _kind(F.col("path")).alias("kind"), "length"
    )
    sizes = files.groupBy("kind").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(
        _kind(F.col("_metadata.file_path")).alias("kind"), "value"
    )
    words = (
        lines.where(F.col("kind").isin("code", "docs"))
        .groupBy("kind")
        .agg(F.sum(F.regexp_count("value", F.lit(r"\S+"))).alias("words"))
    )
    return sizes.join(words, "kind", "left").withColumn("words", F.coalesce("words", F.lit(0).cast("long")))


def corpus_warning(inventory: DataFrame) -> DataFrame:
    """One row: totals and whether the corpus is too large to process in one go."""
    return inventory.agg(F.sum("files").alias("files"), F.sum("words").alias("words")).withColumn(
        "too_large", (F.col("words") > MAX_WORDS) | (F.col("files") > MAX_FILES)
    )


def largest_subfolders(spark: SparkSession, path: str, k: int = 5) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    folder = F.regexp_extract("path", r"^(.*)/[^/]+\z", 1)
    return files.groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "folder").limit(k)


def latest_session(spark: SparkSession, path: str, min_bytes: int = 50_000, fallback_bytes: int = 2_000) -> DataFrame:
    """Newest substantial session file: recency plus up to an hour for size.

    Reads file metadata only.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").load(
        path
    ).select("path", "modificationTime", "length")
    bonus = F.least(F.col("length"), F.lit(5_000_000)) / 5_000_000 * 3600
    ranked = files.where(F.col("length") >= fallback_bytes).select(
        "path", "length", (F.col("length") >= min_bytes).alias("_large"), (F.unix_millis("modificationTime") / 1000 + bonus).alias("score")
    )
    return ranked.orderBy(F.desc("_large"), F.desc("score"), "path").limit(1).drop("_large")


def csv_profile(spark: SparkSession, path: str, group: str, value: str) -> dict[str, DataFrame]:
    """Shape, column types, summary statistics and sums per group of a CSV table."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    types = spark.createDataFrame(df.dtypes, "column string, type string")
    shape = df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))
    return {
        "shape": shape,
        "types": types,
        "summary": df.summary(),
        "group_sums": df.groupBy(group).agg(F.sum(value).alias("total")),
    }


# --- configuration ------------------------------------------------------------------------------


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """Pattern taxonomy ``pattern, keyword, ord`` (JSON lines); ``classify`` joins it."""
    return spark.read.schema("pattern string, keyword string, ord int").json(path).where("pattern IS NOT NULL AND keyword IS NOT NULL")


def read_policy(text: str) -> tuple[list[Rule], list[Rule]]:
    """(command rules, path rules) from a policy file in JSON, or in YAML where a parser is installed."""
    try:
        data = json.loads(text)
    except ValueError:
        import yaml  # type: ignore[import-untyped]

        data = yaml.safe_load(text)
    commands = [
        Rule(tier, r["pattern"], r.get("reason", "")) for tier in COMMAND_TIERS for r in (data.get("bash") or {}).get(tier) or []
    ]
    paths = [Rule(tier, p) for tier in PATH_TIERS for p in (data.get("paths") or {}).get(tier) or []]
    return commands, paths
