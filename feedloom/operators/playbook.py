"""Playbook curation and lesson retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.fixed_values import (
    REAL_VERDICTS,
    STOPWORDS_REMINDER,
    VERDICT_COUNTERS,
    VERDICT_PRIORITY,
    VERDICT_WEIGHT,
    WORST_ORDER,
)
from feedloom.functions.lessons import injection_section
from feedloom.functions.text import bullet_id, tokens
from feedloom.operators.similarity import bullet_groups, greedy_survivors
from feedloom.scale import prefix_sums, top_k
from feedloom.session import cut_lineage, lean


def _lookup(table: dict, key: Column, default) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))


def deciding_verdict() -> Column:
    """The rating verdict if it is an outcome, else the check's, else the judge's."""
    real = lambda c: F.when(F.col(c).isin(REAL_VERDICTS), F.col(c))
    return F.coalesce(real("verdict"), real("obj_verdict"), real("judge_verdict"), F.col("verdict"), F.lit("pending"))


def bullets(lessons: DataFrame, scores: DataFrame, min_quality: int = 2) -> DataFrame:
    """Score each lesson as a playbook bullet.

    ``lessons``: pattern, rule, section, quality, occurrence_count; ``scores``: verdicts.
    """
    joined = lessons.join(scores.select("pattern", "verdict", "obj_verdict", "judge_verdict"), "pattern", "left")
    step = joined.withColumn("verdict", deciding_verdict()).drop("obj_verdict", "judge_verdict")
    v, q, n = F.col("verdict"), F.col("quality"), F.coalesce("occurrence_count", F.lit(0))
    helpful = _lookup({k: c[0] for k, c in VERDICT_COUNTERS.items()}, v, 0) + F.when(
        q >= 3, F.floor(n / 3)
    ).when(q >= 2, F.floor(n / 6)).otherwise(0)
    return step.select(
        bullet_id(F.col("pattern"), F.col("rule")).alias("id"),
        "pattern",
        F.col("rule").alias("description"),
        "verdict",
        helpful.cast("long").alias("helpful"),
        _lookup({k: c[1] for k, c in VERDICT_COUNTERS.items()}, v, 0).cast("long").alias("harmful"),
        (_lookup(VERDICT_PRIORITY, v, 0) + F.least(q, F.lit(4)) * 2).alias("priority"),
        "quality",
        injection_section(v, F.col("section"), q, F.col("rule"), min_quality).alias("section"),
    )


def playbook_rank(rows: DataFrame) -> DataFrame:
    return rows.orderBy(
        F.desc("priority"), F.desc("quality"), F.desc("harmful"), F.desc("helpful"), "pattern"
    )


def playbook_cap(rows: DataFrame, n: int) -> DataFrame:
    """First n bullets: seeds, then flat or regressed ones, then active sections, then the rest."""
    seed = F.coalesce(F.col("seed"), F.lit(False))
    rank = (
        F.when(seed, 0)
        .when(F.col("verdict").isin("regressed", "flat") & (F.col("section") != "deferred"), 1)
        .when(F.col("section").isin("strategy", "pitfall", "formula"), 2)
        .otherwise(3)
    )
    return (
        rows.withColumn("class", rank)
        .orderBy("class", F.desc("priority"), F.desc("quality"), F.desc("harmful"), F.desc("helpful"), "pattern")
        .limit(n)
    )


def dedupe_signal() -> Column:
    """Order of the greedy merge: quality first, then how much the bullet has shown."""
    return (
        F.col("quality") * 10
        + F.col("helpful")
        + F.col("harmful")
        + F.col("priority")
        + F.when(F.coalesce(F.col("seed"), F.lit(False)), 50).otherwise(0)
        + F.when(F.col("verdict").isin("regressed", "flat"), 20).otherwise(0)
    )


def one_per_pattern(rows: DataFrame) -> DataFrame:
    """The rows with ``_id``, ``_rank`` and ``_merged`` after the rule for bullets of the same pattern, read from written tables.

    In order of rank, a bullet that is no seed gives way to the first one of its pattern; where it has the better
    quality and the first one is no seed, the first one takes over all its fields but not its place.  Seeds stay
    bullets of their own.  Counters of bullets that give way are not added.  ``_rank`` is the signal, the pattern and the place in the
    pattern, which stands for the description: ranks are shuffled often.
    """
    seed = F.coalesce(F.col("seed"), F.lit(False))
    # In one pattern, the signal and the description decide.
    place = F.struct((-dedupe_signal()).alias("s"), F.col("description").alias("d"))
    own = rows.select("pattern", seed.alias("_seed"), place.alias("_place"), F.struct(*rows.columns).alias("_row"), (-F.col("quality")).alias("_q"))
    plain = ~F.col("_seed")
    first = own.groupBy("pattern").agg(
        F.min_by(F.struct("_row", "_seed", F.col("_place.s").alias("_s")), F.struct("_place", plain)).alias("_first"),
        F.min_by(F.when(plain, F.col("_row")), F.when(plain, F.struct("_q", "_place"))).alias("_best"),
        F.count_if(plain).alias("_plain"),
    )
    taken = F.when(F.col("_best.quality") > F.col("_first._row.quality"), F.col("_best")).otherwise(F.col("_first._row"))
    # Written once, the texts last: each use below reads only its columns.
    row = F.when(~F.col("_first._seed"), taken).alias("_row")
    first = cut_lineage(first.select(F.col("pattern").alias("_id"), "_first._seed", "_first._s", "_plain", row).select("_id", "_seed", "_s", "_plain", "_row.*"))
    rank = lambda s, n: F.struct(F.col(s).alias("s"), F.col("pattern").alias("p"), n.cast("long").alias("n")).alias("_rank")
    leading = first.where(~F.col("_seed")).select("_id", rank("_s", F.lit(0)), (F.col("_plain") - 1).alias("_merged"), *rows.columns)
    seeds = prefix_sums(own.where("_seed").select("pattern", "_place", "_row"), ["pattern"], ["_place"], {"_n": F.lit(1).cast("long")})
    given_way = first.where("_seed").select(F.col("_id").alias("_of"), "_plain")
    seeds = seeds.join(given_way, (F.col("pattern") == F.col("_of")) & (F.col("_n") == 1), "left").select(
        F.concat("pattern", F.lit("\u0000"), F.col("_n").cast("string")).alias("_id"), F.col("_place.s").alias("_s"), "_n",
        F.coalesce("_plain", F.lit(0)).alias("_merged"), "_row.*",
    )
    seeds = cut_lineage(seeds).select("_id", rank("_s", F.col("_n")), "_merged", *rows.columns)
    return leading.unionByName(seeds)


def dedupe_bullets(rows: DataFrame) -> DataFrame:
    """Merge similar bullets into the strongest one; counters add up.

    Bullets of one pattern are settled first (``one_per_pattern``).  A survivor takes over the wording of a better bullet it
    absorbs.  Similarity is taken on the original wording and not compared again after that.
    """
    with lean(rows.sparkSession):
        return _merged(one_per_pattern(rows))


def _merged(signal: DataFrame) -> DataFrame:
    ranked = signal.select(F.col("_id").alias("id"), F.col("_rank").alias("rank"))
    members, edges = bullet_groups(signal.select(F.col("_id").alias("id"), "pattern", "description", F.col("_rank").alias("rank")))
    leaders = ranked.join(members.select(F.col("leader").alias("id")).distinct(), "id", "left_semi")
    survivor = members.join(greedy_survivors(leaders, edges).withColumnRenamed("id", "leader"), "leader").select(
        F.col("id").alias("_id"), F.col("survivor").alias("_survivor")
    )
    joined = signal.join(survivor, "_id")
    own = F.col("_id") == F.col("_survivor")
    best = F.min_by(
        F.struct("description", "quality", own.alias("own")), F.struct((-F.col("quality")).alias("q"), (~own).alias("o"), F.col("_rank").alias("r"))
    )
    merged = joined.groupBy("_survivor").agg(
        F.sum("helpful").alias("helpful"),
        F.sum("harmful").alias("harmful"),
        (F.count(F.lit(1)) - 1 + F.sum("_merged")).alias("merged"),
        best.alias("_best"),
    )
    keep = signal.drop("helpful", "harmful", "_rank", "_merged").withColumnRenamed("_id", "_survivor")
    # The strongest wording of the group is kept, except that a seed keeps its own.
    swap = ~F.coalesce(F.col("seed"), F.lit(False)) & ~F.col("_best.own")
    return (
        keep.join(merged, "_survivor")
        .withColumn("description", F.when(swap, F.col("_best.description")).otherwise(F.col("description")))
        .withColumn("quality", F.when(swap, F.col("_best.quality")).otherwise(F.col("quality")))
        .withColumn("id", bullet_id(F.col("pattern"), F.col("description")))
        .drop("_best", "_survivor")
    )


def lesson_text(pattern: Column, rule: Column) -> Column:
    return F.concat(F.replace(pattern, F.lit("_"), F.lit(" ")), F.lit(" "), rule)


def rank_lessons(prompts: DataFrame, lessons: DataFrame, scores: DataFrame, k: int = 3) -> DataFrame:
    """Best k lessons per prompt: shared words plus a weight by verdict; resolved ones never.

    ``prompts``: prompt_id, text; ``lessons``: pattern, text.  Works on an inverted index.
    Lessons are a small dimension, so its word lists are what gets broadcast, and only
    while they stay under the session's broadcast limit.
    """
    p = prompts.select("prompt_id", F.explode(tokens(F.col("text"), STOPWORDS_REMINDER)).alias("token"))
    weighted = lessons.join(scores.select("pattern", "verdict"), "pattern", "left").withColumn(
        "verdict", F.coalesce("verdict", F.lit("pending"))
    )
    words = weighted.where(F.col("verdict") != "resolved").select(
        "pattern", "verdict", F.explode(tokens(F.col("text"), STOPWORDS_REMINDER)).alias("token")
    )
    scored = (
        p.join(words, "token")
        .groupBy("prompt_id", "pattern", "verdict")
        .agg(F.count(F.lit(1)).alias("overlap"))
        .withColumn("score", F.col("overlap") + _lookup(VERDICT_WEIGHT, F.col("verdict"), 0))
        .where(F.col("score") > 0)
    )
    return top_k(scored, ["prompt_id"], [F.desc("score"), F.col("pattern")], k)


def worst_lessons(lessons: DataFrame, scores: DataFrame, k: int = 3) -> DataFrame:
    """Lessons shown whatever the prompt: regressed, then flat, then pending."""
    v = F.coalesce(F.col("verdict"), F.lit("pending"))
    order = _lookup(WORST_ORDER, v, 99)
    return (
        lessons.join(scores.select("pattern", "verdict"), "pattern", "left")
        .withColumn("verdict", v)
        .withColumn("order", order)
        .where(F.col("order") < 99)
        .orderBy("order", "pattern")
        .limit(k)
    )


def floor_lessons(ranked: DataFrame, worst: DataFrame) -> DataFrame:
    """(prompt_id, pattern): always-on lessons a prompt did not already get.

    ``worst`` is limited to a handful of rows, so it is attached as one array.
    """
    wanted = worst.agg(F.collect_list("pattern").alias("_w"))
    per_prompt = ranked.groupBy("prompt_id").agg(F.collect_set("pattern").alias("_got"))
    return per_prompt.select("prompt_id", F.explode(F.array_except(wanted.scalar(), F.col("_got"))).alias("pattern"))


def sync_priority(scores: DataFrame, escalated: DataFrame, n: int = 8) -> DataFrame:
    """Patterns to publish: escalated ones, then flat or regressed ones with evidence; at most n."""
    e = escalated.select("pattern", F.lit(0).alias("_k"))
    strong = scores.where(F.col("after_n") >= 5)
    r = strong.where(F.col("verdict") == "regressed").select("pattern", F.lit(1).alias("_k"))
    f = strong.where(F.col("verdict").isin("flat", "regressed")).select("pattern", F.lit(2).alias("_k"))
    order = e.unionByName(r).unionByName(f).groupBy("pattern").agg(F.min("_k").alias("_k"))
    return order.orderBy("_k", "pattern").limit(n).join(scores, "pattern").where(
        ~F.col("verdict").isin("pending", "no-baseline", "undated")
    ).drop("_k")


def verdict_triples(scores: DataFrame, as_of: str) -> DataFrame:
    """(subject, predicate, object, fact, as_of) per lesson with an outcome."""
    fact = F.format_string(
        "Behavioral pattern '%s' has verdict '%s' (delta: %+.4f) as of " + as_of, F.col("pattern"), F.col("verdict"), F.col("delta")
    )
    return scores.where(
        ~F.col("verdict").isin("pending", "stale-pending", "no-baseline", "undated", "no-eval", "no-judge")
    ).select(
        F.concat(F.lit("lesson_"), "pattern").alias("subject"),
        F.lit("HAS_VERDICT").alias("predicate"),
        F.col("verdict").alias("object"),
        fact.alias("fact"),
        F.lit(as_of).alias("as_of"),
    )
