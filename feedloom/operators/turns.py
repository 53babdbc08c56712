"""Turns of a session: numbering, rated responses, context and evidence.

Transcript rows are ``session, seq, type, text, tools array<string>``.  A session may be
very long, so running counts work on (session, position bucket) and never sort a whole
session in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.fixed_values import RATED_RESPONSE_CAP, SEED_RESEARCH_TOOL, SEED_WRITE_TOOL
from feedloom.functions.detectors import tool_flags
from feedloom.functions.regex import matches, strip
from feedloom.functions.text import durable_hits, is_durable
from feedloom.scale import running_total, top_k

SEQ_BUCKET = 4096  # rows of one session that share a task


def _bucket(seq: str, size: int = SEQ_BUCKET) -> Column:
    return F.floor(F.col(seq) / size)


def starts_turn() -> Column:
    """A user row with text; a row that only carries tool results does not start a turn."""
    return F.col("type").isin("user", "human") & (strip(F.coalesce(F.col("text"), F.lit(""))) != "")


def number_turns(events: DataFrame) -> DataFrame:
    """Add ``turn_no``: user prompts seen so far in the session (0 before the first)."""
    return running_total(
        events, ["session"], _bucket("seq"), ["seq"], {"turn_no": starts_turn().cast("long")}
    )


def _flag_test(flag: str):
    return lambda name: tool_flags(name)[flag]


def _tool_counts(tools: Column) -> list[Column]:
    names = F.coalesce(tools, F.array().cast("array<string>"))
    total = F.sum(F.size(names)).alias("n_tools")
    flagged = []
    for flag in ("research", "graph", "graph_write", "forbidden"):
        flagged.append(F.sum(F.size(F.filter(names, _flag_test(flag)))).alias(f"n_{flag}"))
    return [total, *flagged]


def summarize_turns(numbered: DataFrame) -> DataFrame:
    """One row per turn: last assistant text and tool counts, as partial aggregates."""
    work = numbered.where((F.col("type") == "assistant") & (F.col("turn_no") > 0))
    said = strip(F.coalesce(F.col("text"), F.lit("")))
    return work.groupBy("session", "turn_no").agg(
        F.max_by(F.when(said != "", F.col("text")), F.when(said != "", F.col("seq"))).alias("response"),
        *_tool_counts(F.col("tools")),
    )


def _without_banner(text: Column) -> Column:
    plain = F.regexp_replace(text, r"(?md)^═+[^\n]*\n", "")
    plain = F.regexp_replace(plain, r"(?md)^[🗒️🔧✅📋🗣️🔄📃]+\s*[A-Z][^\n]*\n", "")
    return strip(plain)


def rated_responses(numbered: DataFrame) -> DataFrame:
    """Response each prompt reacts to: the work of the turn before it.

    The last assistant block counts; one under 120 characters takes the block before it
    along.  Results under 40 characters are dropped, longer ones cut at the cap.
    """
    blocks = numbered.where(
        (F.col("type") == "assistant") & (F.col("turn_no") > 0) & (strip(F.coalesce("text", F.lit(""))) != "")
    ).select("session", "turn_no", "seq", strip(F.col("text")).alias("block"))
    last_two = top_k(blocks, ["session", "turn_no"], [F.desc("seq")], 2, "rank")
    joined = last_two.groupBy("session", "turn_no").agg(
        F.max(F.when(F.col("rank") == 1, F.col("block"))).alias("last"),
        F.max(F.when(F.col("rank") == 2, F.col("block"))).alias("previous"),
    )
    text = F.when(
        (F.length("last") < 120) & F.col("previous").isNotNull(), F.concat("previous", F.lit("\n\n"), "last")
    ).otherwise(F.col("last"))
    work = joined.select(
        "session", (F.col("turn_no") + 1).alias("turn_no"), _without_banner(text).alias("response")
    ).where(F.length("response") >= 40)
    prompts = numbered.where(starts_turn()).select("session", "turn_no", "seq", F.col("text").alias("prompt"))
    return prompts.join(work, ["session", "turn_no"]).select(
        "session", "turn_no", "prompt", F.substring("response", 1, RATED_RESPONSE_CAP).alias("response")
    )


def recent_context(events: DataFrame, k: int = 6) -> DataFrame:
    """Last k spoken rows of each session as one text; at most k short rows are collected."""
    said = F.coalesce(F.col("text"), F.lit(""))
    summary = F.regexp_extract(said, r"(?id)SUMMARY:\s*([^\n]+)", 1)
    line = F.when(F.col("type") == "user", F.concat(F.lit("User: "), F.substring(said, 1, 200))).otherwise(
        F.concat(F.lit("Assistant: "), F.when(summary != "", summary).otherwise(F.substring(said, 1, 150)))
    )
    spoken = events.where(
        ((F.col("type") == "user") & (strip(said) != "")) | ((F.col("type") == "assistant") & (said != ""))
    ).select("session", "seq", line.alias("line"))
    last = top_k(spoken, ["session"], [F.desc("seq")], k, "rank")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda r: r["line"])
    return last.groupBy("session").agg(F.array_join(ordered, "\n").alias("context"))


def _newest_text(events: DataFrame, keys: list[str], max_chars: int) -> DataFrame:
    """Rows of each key, newest first, up to the one where the text reaches ``max_chars``.

    Every kept row but tool-only ones adds a character, so what is later collected per
    key is bounded by the cap.
    """
    backwards = running_total(
        events.withColumn("_neg", -F.col("seq")),
        keys,
        _bucket("_neg"),
        ["_neg"],
        {"_through": F.length("_text").cast("long")},
    )
    return backwards.where(F.col("_through") - F.length("_text") < max_chars).drop("_neg", "_through")


def session_signals(events: DataFrame, max_chars: int = 12000) -> DataFrame:
    """Per session: tool counts and the tail of the assistant text, with the durable gate.

    ``seed`` is true when the session wrote nothing to the graph, its tail is durable,
    and it did research or has five durable hits.
    """
    work = events.where(F.col("type") == "assistant").withColumn("_text", strip(F.coalesce("text", F.lit(""))))
    tail = _newest_text(work, ["session"], max_chars)
    names = F.coalesce(F.col("tools"), F.array().cast("array<string>"))
    counts = tail.groupBy("session").agg(
        F.sum(F.size(names)).alias("n_tools"),
        F.sum(F.size(F.filter(names, lambda n: matches(n, SEED_RESEARCH_TOOL)))).alias("research_n"),
        F.coalesce(F.bool_or(F.exists(names, lambda n: matches(n, SEED_WRITE_TOOL))), F.lit(False)).alias("had_write"),
    )
    spoken = tail.where(F.col("_text") != "")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "_text"))), lambda r: r["_text"])
    texts = spoken.groupBy("session").agg(F.right(F.array_join(ordered, "\n\n"), F.lit(max_chars)).alias("tail"))
    joined = counts.join(texts, "session", "left").withColumn("tail", F.coalesce("tail", F.lit("")))
    hits = durable_hits(F.col("tail"))
    return joined.select(
        "session",
        "n_tools",
        "research_n",
        "had_write",
        "tail",
        hits.alias("durable_hits"),
        (~F.col("had_write") & is_durable(F.col("tail")) & ((F.col("research_n") >= 1) | (hits >= 5))).alias("seed"),
    )


def turn_evidence(numbered: DataFrame, per_result: int = 2000, max_chars: int = 12000) -> DataFrame:
    """Tool-result text of each turn: every result cut, joined, the newest part kept."""
    results = numbered.where(
        (F.col("type") == "tool_result") & (strip(F.coalesce("text", F.lit(""))) != "")
    ).withColumn("_text", F.substring("text", 1, per_result))
    kept = _newest_text(results, ["session", "turn_no"], max_chars)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "_text"))), lambda r: r["_text"])
    return kept.groupBy("session", "turn_no").agg(
        F.right(F.array_join(ordered, "\n---\n"), F.lit(max_chars)).alias("evidence")
    )


def turns_with_evidence(numbered: DataFrame, per_result: int = 2000, max_chars: int = 12000) -> DataFrame:
    """Every answered turn with its response, tool counts and the tool results it stands on ('' where there are none)."""
    evidence = turn_evidence(numbered, per_result, max_chars)
    joined = summarize_turns(numbered).join(evidence, ["session", "turn_no"], "left")
    return joined.withColumn("evidence", F.coalesce("evidence", F.lit("")))


def cost_proxy(events: DataFrame, top: int = 10) -> DataFrame:
    """Most expensive sessions by messages, tool calls and text, with the tool ratio.

    The score is tool calls times 200 plus characters over four, a stand-in for tokens.
    """
    names = F.coalesce(F.col("tools"), F.array().cast("array<string>"))
    said = F.coalesce(F.col("text"), F.lit(""))
    per = events.groupBy("session").agg(
        F.count_if(said != "").alias("messages"),
        F.sum(F.size(names)).alias("tool_calls"),
        F.sum(F.length(said)).alias("chars"),
    )
    return (
        per.withColumn("ratio", F.round(F.col("tool_calls") / F.greatest("messages", F.lit(1)), 4))
        .withColumn("over_asserting", F.col("ratio") > 3)
        .withColumn("score", F.col("tool_calls") * 200 + F.floor(F.col("chars") / 4))
        .orderBy(F.desc("score"), "session")
        .limit(top)
    )
