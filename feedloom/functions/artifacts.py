"""Paper-trace predicates: does a response carry evidence for what it claims?"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.fixed_values import ARTIFACT_PATTERNS as P
from feedloom.functions.regex import count_matches, matches, matches_ascii

FENCE = "```"


# What an expression can't match without; these run first and are far cheaper.
_DIGIT = r"(?U)\d"
_SUFFIX_SIGN = r"(?iU)\.[a-z]"


def _url(text: Column) -> Column:
    return text.contains("://") & text.rlike(P["url"])


def _weak(text: Column, like) -> Column:
    fence = text.contains(FENCE)
    return (
        fence
        | _url(text)
        | (text.contains("/") & like(text, P["path"]))
        | (text.contains(".") & text.rlike(_SUFFIX_SIGN) & like(text, P["file_name"]))
        | like(text, P["exit_or_verdict"])
        | (text.rlike(_DIGIT) & like(text, P["any_count"]) & like(text, P["count_context"]))
    )


def _tool_backed(text: Column, like) -> Column:
    """The evidence shapes both dialects share."""
    fence = text.contains(FENCE)
    return (
        (F.size(F.split(text, FENCE)) >= 3)
        | _url(text)
        | (
            text.rlike(_DIGIT)
            & (
                like(text, P["exit_number"])
                | (like(text, P["pass_fail_count"]) & like(text, P["runner"]))
                | (like(text, P["metric_count"]) & like(text, P["metric_tool"]))
            )
        )
        | (like(text, P["named_tool"]) & (like(text, P["output_word"]) | fence))
    )


def weak_artifact(text: Column) -> Column:
    """Path, URL, fence or verdict word: enough for a hedge."""
    return _weak(text, matches)


def weak_artifact_ascii(text: Column) -> Column:
    return _weak(text, matches_ascii)


def strong_artifact(text: Column) -> Column:
    """Evidence a completion claim needs; a bare path or count is not enough."""
    data_rows = F.size(
        F.filter(
            F.split(text, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"),
            lambda line: line.rlike(r"(?U)^\s*\|") & ~line.contains("---"),
        )
    )
    return (
        _tool_backed(text, matches)
        | (text.contains("|") & (data_rows >= 3) & matches(text, P["table_identifier"]))
        | (
            text.contains("`")
            & (count_matches(text, P["bullet"], ignore_case=False) >= 2)
            & (count_matches(text, P["code_token"], ignore_case=False) >= 2)
        )
        | (text.rlike(_DIGIT) & matches(text, P["tests_narrative"]))
    )


def strong_artifact_ascii(text: Column) -> Column:
    """Stop-time form, without the table, bullet-list and narrative shapes."""
    return _tool_backed(text, matches_ascii)
