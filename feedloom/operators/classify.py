"""Failure-pattern classification by keyword.

A taxonomy is a mapping, compiled into expressions, or a table ``pattern, keyword, ord`` of any size,
which is joined.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.fixed_values import DATA_NAME_WORDS, DATA_TAXONOMY, REVIEW_NAME_WORDS, REVIEW_TAXONOMY
from feedloom.functions.regex import contains_any
from feedloom.scale import latest_by_key

Taxonomy = Mapping[str, Sequence[str]]
OTHER = "other"
GRAM = 4  # characters that a text and a keyword are joined on


def merged_taxonomy(general: Taxonomy) -> dict[str, list[str]]:
    """General, review and data taxonomies; a later one replaces a pattern of the same name."""
    return {**{k: list(v) for k, v in general.items()}, **REVIEW_TAXONOMY, **DATA_TAXONOMY}


def matched_patterns(low: Column, taxonomy: Taxonomy) -> Column:
    """Patterns with a keyword that occurs literally in the text, given in lower case.

    Keywords are plain text even where they look like an expression.
    """
    hits = [F.when(contains_any(low, list(words)), F.lit(p)) for p, words in taxonomy.items()]
    return F.array_compact(F.array(*hits))


def taxonomy_table(spark: SparkSession, general: DataFrame) -> DataFrame:
    """As ``merged_taxonomy``, for a general taxonomy that is a table."""
    own = [(p, k, n) for n, (p, words) in enumerate(merged_taxonomy({}).items()) for k in words]
    fixed = spark.createDataFrame(own, "pattern string, keyword string, place int")
    first = F.col("ord").cast("long")
    kept = general.join(fixed.select("pattern").distinct(), "pattern", "left_anti").select("pattern", "keyword", first.alias("ord"))
    return kept.unionByName(fixed.select("pattern", "keyword", (F.col("place") + F.lit(1 << 40)).alias("ord")))


def _grams(text: Column, n: int) -> Column:
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
    grams = F.array_distinct(F.transform(places, lambda i: F.substring(text, i, n)))
    return F.filter(grams, lambda g: F.length(g) == n)


def _table_patterns(texts: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(_sig, _found) for distinct texts (_sig, _text): patterns with a keyword in the text, by their first ``ord``.

    Text and keyword meet on one gram of the keyword, the one that fewest keywords hold; a keyword
    shorter than a gram is met on all of itself.  A gram row holds the text's digest alone; the text is joined back, once,
    for the keywords it may hold.
    """
    order = taxonomy.groupBy("pattern").agg(F.min("ord").alias("_place"))
    words = taxonomy.where("keyword <> ''").select("pattern", "keyword").distinct()
    lengths = [r[0] for r in words.select(F.least(F.length("keyword"), F.lit(GRAM))).distinct().collect()]  # GRAM values at most
    found = None
    for n in sorted(lengths):
        own = words.where(F.least(F.length("keyword"), F.lit(GRAM)) == n)
        spelled = own.select("pattern", "keyword", F.explode(_grams(F.col("keyword"), n)).alias("gram"))
        common = spelled.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
        rare = F.min_by("gram", F.struct("df", "gram")).alias("gram")
        keyed = spelled.join(common, "gram").groupBy("pattern", "keyword").agg(rare)
        sought = texts.select("_sig", F.explode(_grams(F.col("_text"), n)).alias("gram"))
        near = sought.join(keyed, "gram").select("_sig", "pattern", "keyword")
        hits = near.join(texts, "_sig").where(F.contains("_text", "keyword")).select("_sig", "pattern")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = texts.where("false").select("_sig", F.lit("").alias("pattern"))
    placed = found.distinct().join(order, "pattern").groupBy("_sig")
    listed = F.array_sort(F.collect_list(F.struct("_place", "pattern")))
    return placed.agg(F.transform(listed, lambda r: r["pattern"]).alias("_found"))


def _with_found(staged: DataFrame, taxonomy: Taxonomy | DataFrame) -> DataFrame:
    """Add ``_found`` to rows with ``_text``; equal texts are looked up once."""
    if not isinstance(taxonomy, DataFrame):
        return staged.withColumn("_found", matched_patterns(F.col("_text"), taxonomy))
    signed = staged.withColumn("_sig", F.sha2("_text", 256))
    found = _table_patterns(signed.select("_sig", "_text").distinct(), taxonomy)
    joined = signed.join(found, "_sig", "left").drop("_sig")
    return joined.withColumn("_found", F.coalesce("_found", F.array().cast("array<string>")))


def or_other(patterns: Column) -> Column:
    return F.when(F.size(patterns) > 0, patterns).otherwise(F.array(F.lit(OTHER)))


def _joined(columns: Sequence[str], df: DataFrame) -> Column:
    parts = []
    for name in columns:
        if name not in df.columns:
            parts.append(F.lit(""))
        elif dict(df.dtypes)[name].startswith("array"):
            parts.append(F.coalesce(F.array_join(name, " "), F.lit("")))
        else:
            parts.append(F.coalesce(F.col(name), F.lit("")))
    return F.concat_ws(" ", *parts)


def latest_overrides(reclass: DataFrame) -> DataFrame:
    """Last non-empty override per (session_id, timestamp)."""
    usable = reclass.where(
        (F.size("patterns") > 0) & (F.col("session_id") != "") & (F.col("timestamp") != "")
    ).select("session_id", "timestamp", "patterns", "seq")
    return latest_by_key(usable, ["session_id", "timestamp"], [F.col("seq")]).select(
        "session_id", "timestamp", F.col("patterns").alias("_override")
    )


def classify(ratings: DataFrame, taxonomy: Taxonomy | DataFrame, reclass: DataFrame | None = None) -> DataFrame:
    """Add ``patterns``: the override, else keyword matches plus failed checks, else ``other``."""
    text = _joined(
        ["sentiment_summary", "comment", "response_preview", "skill", "tools_used", "files_touched", "repo"], ratings
    )
    staged = _with_found(ratings.withColumn("_text", F.lower(text)), taxonomy)
    found = F.col("_found")
    if "eval_results" in ratings.columns:
        failed = F.transform(
            F.filter(
                F.map_values(F.coalesce(F.col("eval_results"), F.create_map().cast(ratings.schema["eval_results"].dataType))),
                lambda r: (~r["passed"]) & (r["pattern"] != ""),
            ),
            lambda r: r["pattern"],
        )
        found = F.array_distinct(F.concat(found, failed))
    found = or_other(found)
    if reclass is None:
        return staged.withColumn("patterns", found).drop("_text", "_found")
    joined = staged.join(latest_overrides(reclass), ["session_id", "timestamp"], "left")
    return joined.withColumn("patterns", F.coalesce("_override", found)).drop("_override", "_text", "_found")


def classify_for_source(df: DataFrame, source: str, general: Taxonomy | DataFrame) -> DataFrame:
    """The lesson generator's narrower classifier: three text fields, no override, no checks."""
    if source == "failures":
        taxonomy = taxonomy_table(df.sparkSession, general) if isinstance(general, DataFrame) else merged_taxonomy(general)
    else:
        taxonomy = {"ratings": general, "pr_review": REVIEW_TAXONOMY, "dag": DATA_TAXONOMY}[source]
    text = _joined(["sentiment_summary", "comment", "response_preview"], df)
    staged = _with_found(df.withColumn("_text", F.lower(text)), taxonomy)
    return staged.withColumn("patterns", or_other(F.col("_found"))).drop("_text", "_found")


def domain_flags(name: Column) -> tuple[Column, Column]:
    """(is_review, is_data) by name keyword."""
    low = F.lower(name)
    return contains_any(low, REVIEW_NAME_WORDS), contains_any(low, DATA_NAME_WORDS)
