"""Policy verdicts over tool calls.

Rules are configuration of a few dozen lines, so they are compiled into one CASE chain per
row: no join, the first rule that matches in tier order wins, and the same Columns work on
a stream.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.fixed_values import (
    APPROVAL_COMMAND,
    ENV_PREFIX,
    GIT_PUSH,
    PROMOTION_BRANCH,
    WORKFLOW_CHANNEL,
)
from feedloom.functions.regex import contains_any, matches_ascii
from feedloom.functions.text import symbols

COMMAND_TIERS = {"trusted": "allow", "blocked": "block", "confirm": "confirm", "alert": "alert"}
PATH_TIERS = {
    "zeroAccess": ("block", ("read", "write", "delete")),
    "readOnly": ("block", ("write", "delete")),
    "confirmWrite": ("confirm", ("write",)),
    "noDelete": ("block", ("delete",)),
}


@dataclass(frozen=True)
class Rule:
    tier: str
    pattern: str
    reason: str = ""


def without_env_prefix(command: Column) -> Column:
    """Drop leading VAR=value assignments, which would hide the command."""
    return F.regexp_replace(command, ENV_PREFIX, "")


def _command_matches(command: Column, pattern: str) -> Column:
    try:
        re.compile(pattern)
    except re.error:
        return F.lower(command).contains(pattern.lower())
    return matches_ascii(command, pattern)


def policy_verdict(calls: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add ``verdict`` and ``reason`` for ``command``: trusted, blocked, confirm, alert, else allow."""
    command = without_env_prefix(F.coalesce(F.col("command"), F.lit("")))
    staged = calls.withColumn("_command", command)
    chain = F.struct(F.lit("allow").alias("verdict"), F.lit(None).cast("string").alias("reason"))
    for tier in reversed(COMMAND_TIERS):
        for rule in reversed([r for r in rules if r.tier == tier]):
            reason = F.lit(None).cast("string") if tier == "trusted" else F.lit(rule.reason)
            outcome = F.struct(F.lit(COMMAND_TIERS[tier]).alias("verdict"), reason.alias("reason"))
            chain = F.when(_command_matches(F.col("_command"), rule.pattern), outcome).otherwise(chain)
    return staged.withColumn("_v", chain).select(*calls.columns, "_v.verdict", "_v.reason")


def _expand(path: str, home: str) -> str:
    return path.replace("~", home, 1) if path.startswith("~") else path


def path_regex(pattern: str, home: str) -> str:
    """``**`` crosses directories, ``*`` does not; a plain path covers what lies below it."""
    full = _expand(pattern, home)
    if "*" not in pattern:
        return "^" + re.escape(full.rstrip("/")) + r"(/.*)?\z" if not full.endswith("/") else "^" + re.escape(full)
    out = []
    for piece in re.split(r"(\*\*|\*)", full):
        out.append({"**": ".*", "*": "[^/]*"}.get(piece, re.escape(piece)))
    return "^" + "".join(out) + r"\z"


def path_verdict(calls: DataFrame, rules: Sequence[Rule], home: str) -> DataFrame:
    """Add ``verdict`` and ``reason`` for ``file_path`` under ``action`` (read, write, delete)."""
    path = F.when(F.col("file_path").startswith("~"), F.concat(F.lit(home), F.substring("file_path", 2, 1 << 30))).otherwise(
        F.col("file_path")
    )
    labels = {
        "zeroAccess": "Zero access path: ",
        "readOnly": "Read-only path: ",
        "confirmWrite": "Writing to protected file requires confirmation: ",
        "noDelete": "Cannot delete protected path: ",
    }
    chain = F.struct(F.lit("allow").alias("verdict"), F.lit(None).cast("string").alias("reason"))
    for tier in reversed(PATH_TIERS):
        verdict, actions = PATH_TIERS[tier]
        for rule in reversed([r for r in rules if r.tier == tier]):
            outcome = F.struct(F.lit(verdict).alias("verdict"), F.lit(labels[tier] + rule.pattern).alias("reason"))
            hit = F.col("action").isin(*actions) & path.rlike("(?s)" + path_regex(rule.pattern, home))
            chain = F.when(hit, outcome).otherwise(chain)
    return calls.withColumn("_v", chain).select(*calls.columns, "_v.verdict", "_v.reason")


def glob_regex(glob: str, home: str) -> str:
    """Shell-style match where ``*`` and ``?`` also cross directories."""
    out = []
    for piece in re.split(r"(\*+|\?|\[[^\]]+\])", _expand(glob, home)):
        if piece.startswith("*"):
            out.append(".*")
        elif piece == "?":
            out.append(".")
        elif piece.startswith("[") and len(piece) > 2:
            out.append("[" + ("^" + piece[2:] if piece[1] == "!" else piece[1:]))
        else:
            out.append(re.escape(piece))
    return "(?s)^" + "".join(out) + r"\z"


def surface_allowed(
    path: Column, allow: Sequence[dict], deny: Sequence[str], home: str, actor: str | None = None
) -> Column:
    """Deny wins; an unknown path is denied; an actor must be listed where the entry names actors."""
    denied = F.lit(False)
    for glob in deny:
        denied = denied | path.rlike(glob_regex(glob, home))
    allowed = F.lit(False)
    for entry in allow:
        if not entry.get("glob"):
            continue
        who = entry.get("who") or []
        if actor and who and actor not in who:
            continue
        allowed = allowed | path.rlike(glob_regex(entry["glob"], home))
    return allowed & ~denied


def tool_event_flags(calls: DataFrame) -> DataFrame:
    """Add one boolean per reminder or gate that reacts to a tool call."""
    command = F.coalesce(F.col("command"), F.lit(""))
    path = F.coalesce(F.col("file_path"), F.lit(""))
    content = F.coalesce(F.col("content"), F.lit(""))
    tool = F.lower(F.coalesce(F.col("tool_name"), F.lit("")))
    push = (
        matches_ascii(command, GIT_PUSH, ignore_case=False)
        & ~command.contains("no-mistakes")
        & ~matches_ascii(command, PROMOTION_BRANCH, ignore_case=False)
    )
    workflow = path.rlike(r"(?s)\.github/workflows/.*\.ya?ml\z") & content.rlike(WORKFLOW_CHANNEL)
    return (
        calls.withColumn("push_blocked", push)
        .withColumn("workflow_blocked", workflow)
        .withColumn("pr_text_reminder", contains_any(command, ["git push", "gh pr create"]))
        .withColumn("stacked_reminder", contains_any(command, ["gh stack", "gh-stack"]))
        .withColumn(
            "feedback_reminder",
            contains_any(command, ["gh pr view", "pr comments", "discussion_r", "issuecomment"])
            | contains_any(path, ["CLAUDE.md", "AGENTS.md", "errors-and-lessons.md"]),
        )
        .withColumn("verify_reminder", contains_any(tool, ["write", "edit"]) & (path != ""))
        .withColumn("is_approval", matches_ascii(command, APPROVAL_COMMAND, ignore_case=False))
    )


def ungrounded_symbols(docs: DataFrame, keep: Sequence[str], text: str, known: DataFrame) -> DataFrame:
    """Framework-like names in a text that the known-symbol table does not list."""
    named = docs.select(*keep, F.explode(symbols(F.coalesce(F.col(text), F.lit("")))).alias("symbol"))
    return named.join(known.select("symbol").distinct(), "symbol", "left_anti")
