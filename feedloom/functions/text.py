"""Small text operators: tokens, categories, seeding, audits, ids and symbols."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.fixed_values import (
    ALGORITHM_WORDS,
    CONSTRAINT_MARKERS,
    HOW_MARKERS,
    INTENT_MARKERS,
    LEARNING_WORDS,
    SEED_DURABLE,
    SEED_SKIP_ONLY,
    SYMBOL,
    SYSTEM_WORDS,
)
from feedloom.functions.regex import any_regex, ascii_regex, count_matches, matches, matches_ascii, strip


def tokens(text: Column, stopwords: list[str]) -> Column:
    """Distinct lower-case words of four letters or more, without stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z]{4,})"), F.lit(1))
    if not stopwords:
        return F.array_distinct(words)
    return F.array_except(words, F.array(*[F.lit(w) for w in stopwords]))


def _any(text: Column, patterns: list[str]) -> Column:
    return matches_ascii(text, any_regex(patterns))


def learning_category(content: Column, comment: Column | None = None) -> Column:
    text = F.lower(F.concat_ws(" ", content, F.coalesce(comment, F.lit("")) if comment is not None else F.lit("")))
    return (
        F.when(_any(text, ALGORITHM_WORDS), "ALGORITHM")
        .when(_any(text, SYSTEM_WORDS), "SYSTEM")
        .otherwise("ALGORITHM")
    )


def is_learning(text: Column) -> Column:
    score = F.lit(0)
    for pattern in LEARNING_WORDS:
        score = score + matches_ascii(text, pattern).cast("int")
    return score >= 2


def durable_hits(text: Column) -> Column:
    return count_matches(F.coalesce(text, F.lit("")), SEED_DURABLE)


def is_durable(text: Column) -> Column:
    body = strip(F.coalesce(text, F.lit("")))
    return (F.length(body) >= 280) & ~matches(body, SEED_SKIP_ONLY) & (durable_hits(text) >= 3)


def compress_episode(text: Column, max_chars: int = 3500) -> Column:
    """Keep the most durable paragraphs within ``max_chars``.

    Paragraphs are visited by falling hit count.  One that does not fit is skipped, and
    the visit ends once 70 % is filled, so this is a fold and not a running sum.
    """
    paragraphs = F.filter(F.transform(F.split(text, r"\n{2,}"), strip), lambda p: p != "")
    ranked = F.filter(
        F.transform(
            paragraphs, lambda p, i: F.struct((-durable_hits(p)).alias("neg_hits"), i.alias("pos"), p.alias("body"))
        ),
        lambda r: r["neg_hits"] < 0,
    )
    ordered = F.array_sort(ranked)
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("kept"))

    def visit(acc: Column, r: Column) -> Column:
        size = F.length(r["body"])
        full = acc["used"] >= F.lit(max_chars * 0.7)
        take = ~full & (acc["used"] + size <= max_chars)
        return F.struct(
            F.when(take, acc["used"] + size).otherwise(acc["used"]).alias("used"),
            F.when(take, F.concat(acc["kept"], F.array(r["body"]))).otherwise(acc["kept"]).alias("kept"),
        )

    kept = F.aggregate(ordered, start, visit)["kept"]
    body = F.substring(F.array_join(kept, "\n\n"), 1, max_chars)
    return F.when(F.size(kept) > 0, body).otherwise(F.right(text, F.lit(max_chars)))


def high_signal(text: Column, min_bytes: int = 900) -> Column:
    """A meeting or stand-up extract worth ingesting."""
    return (
        (F.octet_length(text) >= min_bytes)
        & (F.regexp_count(text, F.lit(r"(?md)^- ")) >= 4)
        & (F.size(F.split(text, "None detected")) - 1 < 6)
    )


def how_intent(text: Column) -> Column:
    """struct of recipe, intent and constraint marker counts, line count and the flag."""

    def total(patterns: list[str]) -> Column:
        n = F.lit(0)
        for pattern in patterns:
            n = n + matches(text, pattern).cast("int")
        return n

    how, intent, constraint = total(HOW_MARKERS), total(INTENT_MARKERS), total(CONSTRAINT_MARKERS)
    lines = F.size(F.split(text, "\n"))
    flagged = ((lines > 120) & (how >= 2) & (intent == 0) & (constraint == 0)) | (
        (how >= 3) & (intent <= 1) & (constraint == 0) & (lines > 80)
    )
    return F.struct(
        lines.alias("lines"),
        how.alias("how_hits"),
        intent.alias("intent_hits"),
        constraint.alias("constraint_hits"),
        flagged.alias("flagged"),
        F.when(flagged, "review_for_deprecation_or_intent_rewrite").otherwise("monitor").alias("recommendation"),
    )


def bullet_id(pattern: Column, rule: Column) -> Column:
    digest = F.sha1(F.concat(pattern, F.lit("|"), F.substring(rule, 1, 120)))
    return F.concat(F.lit("b_"), F.substring(pattern, 1, 40), F.lit("_"), F.substring(digest, 1, 10))


def content_version(rule: Column) -> Column:
    return F.substring(F.sha1(strip(rule)), 1, 10)


def content_hash(body: Column) -> Column:
    """Identity of an episode: its first 800 characters."""
    return F.substring(F.sha2(F.substring(body, 1, 800), 256), 1, 16)


def symbols(text: Column) -> Column:
    """Framework-like class names."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(ascii_regex(SYMBOL, ignore_case=False)), F.lit(0)))
