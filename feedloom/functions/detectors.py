"""Stop-time detectors: text rules, arming and turn-level rules."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.fixed_values import (
    ALWAYS_ON,
    CHECK_PATTERNS,
    DETECTOR_DEFAULT_MODES,
    DETECTOR_PATTERNS,
    DURABLE_CLAIM,
    FORBIDDEN_TOOL_NAME,
    GRAPH_TOOL,
    GRAPH_WRITE_TOOL,
    RESEARCH_TOOL,
    RESEARCH_TOOL_THRESHOLD,
    TURN_RULE_DEFAULT_MODES,
)
from feedloom.functions.artifacts import strong_artifact_ascii, weak_artifact_ascii
from feedloom.functions.regex import matches_ascii, strip


def _c(text: Column, name: str) -> Column:
    return matches_ascii(text, CHECK_PATTERNS[name])


def _d(text: Column, name: str) -> Column:
    return matches_ascii(text, DETECTOR_PATTERNS[name])


def _unverified_completion(text: Column) -> Column:
    return _d(text, "completion_claim") & ~strong_artifact_ascii(text)


def _incomplete_analysis(text: Column) -> Column:
    claim = (_c(text, "agree") & _c(text, "technical_claim")) | _d(text, "dismiss")
    return claim & ~(weak_artifact_ascii(text) | _d(text, "research"))


def _unverified_claims(text: Column) -> Column:
    firm = _c(text, "confident_state") | _c(text, "metric_claim")
    return (firm & ~strong_artifact_ascii(text) & ~_c(text, "tagged_uncertain")) | (
        _c(text, "hedge") & ~weak_artifact_ascii(text)
    )


@dataclass(frozen=True)
class DetectorSpec:
    pattern: str
    fires: Callable[[Column], Column]
    default_mode: str


def _spec(pattern: str, fires: Callable[[Column], Column]) -> DetectorSpec:
    return DetectorSpec(pattern, fires, DETECTOR_DEFAULT_MODES[pattern])


DETECTORS: tuple[DetectorSpec, ...] = (
    _spec("unverified_completion", _unverified_completion),
    _spec("incomplete_analysis", _incomplete_analysis),
    _spec("unverified_claims", _unverified_claims),
    _spec("duplicate_approval", lambda t: _c(t, "dup_approve")),
    _spec("blind_retry", lambda t: _c(t, "retry") & ~_c(t, "diagnosis")),
    _spec("tool_misuse", lambda t: _c(t, "jira_mcp")),
    _spec("guardrail_bypass", lambda t: _d(t, "guardrail_named") & _d(t, "guardrail_skipped")),
)


def armed_modes(
    escalated: DataFrame, overrides: DataFrame, detectors: Sequence[DetectorSpec] = DETECTORS
) -> DataFrame:
    """(pattern, mode) of detectors in force.

    Armed are escalated and always-on patterns that have a detector; an override
    replaces the default mode and ``off`` disarms.
    """
    spark = escalated.sparkSession
    known = spark.createDataFrame([(d.pattern, d.default_mode) for d in detectors], "pattern string, default_mode string")
    always = spark.createDataFrame([(p,) for p in ALWAYS_ON], "pattern string")
    wanted = escalated.select("pattern").unionByName(always).distinct()
    return (
        known.join(wanted, "pattern", "left_semi")
        .join(overrides.select("pattern", F.col("mode").alias("_override")), "pattern", "left")
        .select("pattern", F.coalesce("_override", "default_mode").alias("mode"))
        .where(F.col("mode") != "off")
    )


def enforce(
    df: DataFrame, text: str, keep: Sequence[str], armed: DataFrame, detectors: Sequence[DetectorSpec] = DETECTORS
) -> DataFrame:
    """One row per (response, fired detector) with its mode.

    The mode table holds at most one row per detector, a size fixed by the registry,
    so it is broadcast.
    """
    staged = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    hits = [F.when(d.fires(F.col("_text")), F.lit(d.pattern)) for d in detectors]
    fired = staged.select(*keep, F.explode_outer(F.array_compact(F.array(*hits))).alias("pattern"))
    return (
        fired.where(F.col("pattern").isNotNull())
        .join(F.broadcast(armed), "pattern")
        .select(*keep, "pattern", "mode", (F.col("mode") == "block").alias("blocked"))
    )


def _override_mode(rule: str, overrides: dict[str, str] | None) -> str:
    return (overrides or {}).get(rule, TURN_RULE_DEFAULT_MODES.get(rule, DETECTOR_DEFAULT_MODES.get(rule, "block")))


def tool_flags(name: Column) -> dict[str, Column]:
    """Boolean Columns over one tool name, to be counted per turn."""
    return {
        "research": matches_ascii(name, RESEARCH_TOOL),
        "graph": matches_ascii(name, GRAPH_TOOL, ignore_case=False),
        "graph_write": matches_ascii(name, GRAPH_WRITE_TOOL, ignore_case=False),
        "forbidden": matches_ascii(name, FORBIDDEN_TOOL_NAME),
    }


def turn_rule_fires(turns: DataFrame, keep: Sequence[str], overrides: dict[str, str] | None = None) -> DataFrame:
    """Turn-level rules over ``response, n_tools, n_research, n_graph, n_graph_write, n_forbidden``.

    silent_completion   the turn used a tool and said less than 15 characters
    graph_bypass        two research tools or more and no graph lookup
    writeback_skipped   same, with durable claims over 200 characters and no graph write
    tool_misuse         a forbidden tool was called by name
    """
    said = F.coalesce(F.col("response"), F.lit(""))
    said_length = F.length(strip(said))
    researched = F.col("n_research") >= RESEARCH_TOOL_THRESHOLD
    rules = {
        "silent_completion": (said_length < 15) & (F.col("n_tools") > 0),
        "graph_bypass": researched & (F.col("n_graph") == 0),
        "writeback_skipped": researched
        & (F.col("n_graph_write") == 0)
        & (said_length > 200)
        & matches_ascii(said, DURABLE_CLAIM),
        "tool_misuse": F.col("n_forbidden") > 0,
    }
    hits = []
    for rule, fired in rules.items():
        mode = _override_mode(rule, overrides)
        if mode != "off":
            hits.append(F.when(fired, F.struct(F.lit(rule).alias("pattern"), F.lit(mode).alias("mode"))))
    out = turns.select(*keep, F.inline_outer(F.array_compact(F.array(*hits))))
    return out.where(F.col("pattern").isNotNull()).withColumn("blocked", F.col("mode") == "block")
