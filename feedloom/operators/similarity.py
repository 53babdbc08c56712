"""Exact token-set similarity at scale.

All pairs with Jaccard similarity of at least ``threshold`` are found without comparing
all pairs: identical sets are collapsed first (a group of copies costs one row), sets meet
under keys of which two similar ones must share one (``setkeys``), pairs whose signatures
differ in too many bits go, and the rest is compared on whole sets.

A job's shuffle files go when its table is written, and sets meet a few sizes at a time, so the
disk in use follows the sets and the largest step, not the sum of all steps.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.fixed_values import (
    BULLET_THRESHOLD,
    DIVERSITY_THRESHOLD,
    FAMILY_DISCOUNT,
    MERGE_THRESHOLD,
    STOPWORDS_LESSONS,
    STOPWORDS_PLAYBOOK,
    TEMPLATE_NAME_THRESHOLD,
)
from feedloom.functions.lessons import is_template_rule
from feedloom.functions.text import tokens
from feedloom.operators import setkeys
from feedloom.session import cut_lineage, lean, passing, written

SLICE_TOKENS = 1_000_000  # sets with fewer tokens in all meet in one go
_SLACK = setkeys.SLACK
_GAP = "\u0001"  # between the tokens of a set that is held as one text


def jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / union).otherwise(0.0)


def collapse_copies(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distinct sets, members): ``sets`` are ``id, tokens``; the lowest id represents copies."""
    distinct, members = _numbered(sets)
    return distinct.select("rep", F.split("text", _GAP).alias("tokens")), members


def _as_text(tokens_: Column) -> list[Column]:
    """(n, text) of a set: the number of its tokens and the tokens in order, as one text."""
    return [F.size(tokens_).alias("n"), F.concat_ws(_GAP, F.sort_array(tokens_)).alias("text")]


def _numbered(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distinct, members): distinct sets as ``no, rep, n, text, bits``; members as ``id, rep``."""
    keyed = sets.where(F.size("tokens") > 0).select("id", *_as_text(F.col("tokens")))
    with lean(sets.sparkSession):
        keyed, drop = passing(keyed.withColumn("_sig", F.unhex(F.sha2("text", 256))), "sets")
        distinct = _distinct(keyed)
        members = cut_lineage(keyed.select("id", "_sig").join(distinct.select("_sig", "rep"), "_sig").select("id", "rep"))
    drop()
    return distinct.drop("_sig"), members


def _distinct(keyed: DataFrame) -> DataFrame:
    """Distinct sets of ``id, n, text, _sig`` as ``no, _sig, rep, n, text, bits``, written; the lowest id is ``rep``."""
    one = keyed.groupBy("_sig").agg(F.min("id").alias("rep"), F.any_value(F.struct("n", "text")).alias("_set"))
    hashed = one.select(F.monotonically_increasing_id().alias("no"), "_sig", "rep", "_set.*", _hashes(F.col("_set.text")).alias("hashes"))
    types = dict(one.dtypes)
    schema = f"no long, _sig {types['_sig']}, rep {types['rep']}, n int, text string, bits binary"
    return written(hashed.mapInArrow(setkeys.signed, schema), "distinct")


def _hashes(text: Column) -> Column:
    return F.transform(F.split(text, _GAP), lambda t: F.xxhash64(t))


def _rare_first(distinct: DataFrame) -> np.ndarray:
    """The order of tokens in sets (``rep, text``), rare ones first: the place of each bucket of their hashes.

    Sets are counted by bucket, so the table has the same size for any vocabulary.
    """
    buckets = distinct.select(F.explode(_hashes(F.col("text"))).alias("hash")).select(
        F.col("hash").bitwiseAND(setkeys.BUCKETS - 1).cast("int").alias("bucket")
    )
    with lean(distinct.sparkSession):
        table, drop = passing(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "counts")
        counted = table.toArrow()
    drop()
    counts = np.zeros(setkeys.BUCKETS, np.int64)
    counts[np.asarray(counted.column("bucket"))] = np.asarray(counted.column("n"))
    return setkeys.order_of(counts, setkeys.RARE)


def _slices(distinct: DataFrame, threshold: float) -> list[tuple[int, int]]:
    """Levels (first, last) that meet in one go: about a third of all tokens, or one level that holds more."""
    if not setkeys.levels(threshold):
        return [(0, 0)]
    level = F.floor(F.log2("n") + _SLACK)
    held = {r.level: r.tokens for r in distinct.groupBy(level.alias("level")).agg(F.sum("n").alias("tokens")).collect()}
    most, out, sum_ = max(sum(held.values()) / 3, SLICE_TOKENS), [], 0
    for k in range(max(held, default=-1) + 2):  # the largest sets give out keys one level up, where no one waits
        tokens_ = held.get(k, 0)
        if out and sum_ + tokens_ <= most:
            out[-1], sum_ = (out[-1][0], k), sum_ + tokens_
        else:
            out, sum_ = [*out, (k, k)], tokens_
    return out


def _candidates(distinct: DataFrame, place: np.ndarray, threshold: float, low: int, high: int) -> DataFrame:
    """(a, b): pairs of the levels ``low`` to ``high`` that share a key early enough and have signatures close enough."""
    sized = distinct
    if setkeys.levels(threshold):
        sized = distinct.where((F.col("n") >= 2 ** max(low - 1, 0)) & (F.col("n") < 2 ** (high + 1)))
    rows = sized.select("no", _hashes(F.col("text")).alias("hashes")).mapInArrow(
        setkeys.key_rows(place, threshold, low, high), "key long, prior long, no long, n int, before int, up boolean"
    )
    side = lambda x: rows.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("prior", "no", "n", "before", "up")])
    need = F.ceil((F.col("n_a") + F.col("n_b")) * (threshold / (1 + threshold)) - _SLACK)
    met = (
        side("a")
        .join(side("b"), "key")
        # Equal keys before this one: there the pair has met already.
        .where((F.col("no_a") < F.col("no_b")) & (F.col("prior_a") != F.col("prior_b")) & ~(F.col("up_a") & F.col("up_b")))
        .where((F.col("before_a") <= F.col("n_a") - need) & (F.col("before_b") <= F.col("n_b") - need))
        .select(F.col("no_a").alias("a"), F.col("no_b").alias("b"))
        .distinct()
    )
    bits = lambda x: sized.select(F.col("no").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits_{x}"))
    return met.join(bits("a"), "a").join(bits("b"), "b").select("a", "b", "na", "nb", "bits_a", "bits_b").mapInArrow(
        setkeys.maybe_alike(threshold), "a long, b long"
    )


def similar_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, score), a < b.  Copies appear once, against the lowest id of their group."""
    distinct, members = _numbered(sets)
    return _scored(distinct, threshold).unionByName(
        members.where(F.col("id") != F.col("rep")).select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("score"))
    )


def _scored(distinct: DataFrame, threshold: float) -> DataFrame:
    """(a, b, score) of numbered distinct sets, a and b their representatives."""
    # A number stands for an id, often a long text, in each row below.
    place = _rare_first(distinct.select(F.col("no").alias("rep"), "text"))
    with lean(distinct.sparkSession):
        parts = [passing(_candidates(distinct, place, threshold, *levels), "candidates") for levels in _slices(distinct, threshold)]
        candidates = reduce(DataFrame.unionByName, [table for table, _ in parts])
        left = distinct.select(F.col("no").alias("a"), F.col("text").alias("_ta"))
        right = distinct.select(F.col("no").alias("b"), F.col("text").alias("_tb"))
        words = lambda x: F.split(x, _GAP)
        # Generators keep the filter above them, so a set is split and the overlap computed once per pair.
        both = candidates.join(left, "a").join(right, "b").select(
            "a", "b", F.explode(F.array(F.struct(words("_ta").alias("a"), words("_tb").alias("b")))).alias("_s")
        )
        shared = F.size(F.array_intersect("_s.a", "_s.b"))
        counted = both.select("a", "b", F.explode(F.array(F.struct(shared.alias("c"), (F.size("_s.a") + F.size("_s.b")).alias("n")))).alias("_o"))
        score = F.col("_o.c") / (F.col("_o.n") - F.col("_o.c"))
        alike = cut_lineage(counted.select("a", "b", score.alias("score")).where(F.col("score") >= threshold))
    for _, drop in parts:
        drop()
    name = lambda x: distinct.select(F.col("no").alias(x), F.col("rep").alias(f"_{x}"))
    named = alike.join(name("a"), "a").join(name("b"), "b")
    return named.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), "score")


def _oriented(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """Survivor and loser of each pair: more occurrences survive, the lower id on a tie."""
    wa = weights.select(F.col("id").alias("a"), F.col("occurrence_count").alias("_na"))
    wb = weights.select(F.col("id").alias("b"), F.col("occurrence_count").alias("_nb"))
    first = F.col("_na") >= F.col("_nb")
    return (
        pairs.join(wa, "a")
        .join(wb, "b")
        .withColumn("survivor", F.when(first, F.col("a")).otherwise(F.col("b")))
        .withColumn("loser", F.when(first, F.col("b")).otherwise(F.col("a")))
        .withColumn("survivor_n", F.greatest("_na", "_nb"))
        .withColumn("loser_n", F.least("_na", "_nb"))
    )


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Near-copies among ``id, text, occurrence_count``."""
    sets = docs.select("id", tokens(F.col("text"), STOPWORDS_LESSONS).alias("tokens"))
    out = _oriented(similar_pairs(sets, threshold), docs)
    return out.select("survivor", "loser", F.round("score", 3).alias("score"), "survivor_n", "loser_n")


def merge_candidates(lessons: DataFrame, threshold: float = MERGE_THRESHOLD) -> DataFrame:
    """Lessons to merge: similar rules or similar names, as all pairs of a small dimension.

    For a large corpus use ``near_duplicates``, which lists a copy once.

    Two boilerplate rules share only boilerplate, so between them the name alone decides,
    at a stricter bar.  ``lessons``: pattern, rule, occurrence_count.
    """
    name = tokens(F.replace(F.col("pattern"), F.lit("_"), F.lit(" ")), STOPWORDS_LESSONS)
    prepared = lessons.select(
        F.col("pattern").alias("id"),
        "occurrence_count",
        tokens(F.col("rule"), STOPWORDS_LESSONS).alias("rule_tokens"),
        name.alias("name_tokens"),
        is_template_rule(F.col("rule")).alias("template"),
    )

    def expand(column: str) -> DataFrame:
        """Every pair at the bar.  A group of copies is joined back through its representative."""
        sets = prepared.select("id", F.col(column).alias("tokens"))
        distinct, members = collapse_copies(sets)
        reps = similar_pairs(distinct.select(F.col("rep").alias("id"), "tokens"), threshold).select("a", "b")
        own = distinct.select(F.col("rep").alias("a"), F.col("rep").alias("b"))
        links = reps.unionByName(own)
        ma = members.select(F.col("rep").alias("a"), F.col("id").alias("x"))
        mb = members.select(F.col("rep").alias("b"), F.col("id").alias("y"))
        both = links.join(ma, "a").join(mb, "b").where(F.col("x") != F.col("y"))
        return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    pairs = expand("rule_tokens").unionByName(expand("name_tokens")).distinct()
    left = prepared.select(*[F.col(c).alias(f"l_{c}") for c in prepared.columns])
    right = prepared.select(*[F.col(c).alias(f"r_{c}") for c in prepared.columns])
    full = pairs.join(left, pairs.a == left.l_id).join(right, pairs.b == right.r_id)
    both_templates = F.col("l_template") & F.col("r_template")
    by_rule = F.when(both_templates, 0.0).otherwise(jaccard(F.col("l_rule_tokens"), F.col("r_rule_tokens")))
    by_name = jaccard(F.col("l_name_tokens"), F.col("r_name_tokens"))
    scored = full.select("a", "b", by_rule.alias("rule_overlap"), by_name.alias("name_overlap"), both_templates.alias("_t"))
    score = F.when(
        F.col("_t"), F.when(F.col("name_overlap") >= TEMPLATE_NAME_THRESHOLD, F.col("name_overlap")).otherwise(0.0)
    ).otherwise(F.greatest("rule_overlap", "name_overlap"))
    kept = scored.withColumn("score", score).where(F.col("score") >= threshold)
    weights = prepared.select("id", "occurrence_count")
    return _oriented(kept, weights).select(
        "survivor",
        "loser",
        F.round("rule_overlap", 3).alias("rule_overlap"),
        F.round("name_overlap", 3).alias("name_overlap"),
        F.round("score", 3).alias("score"),
        "survivor_n",
        "loser_n",
    )


def diversity_check(lessons: DataFrame, threshold: float = DIVERSITY_THRESHOLD, top: int = 20) -> DataFrame:
    """Rule pairs so alike that the playbook loses variety."""
    sets = lessons.select(F.col("pattern").alias("id"), tokens(F.col("rule"), []).alias("tokens"))
    return (
        similar_pairs(sets, threshold)
        .select("a", "b", F.round("score", 3).alias("jaccard"))
        .orderBy(F.desc("jaccard"), "a", "b")
        .limit(top)
    )


def name_overlap(generated: DataFrame, written: DataFrame, shared: int = 2) -> DataFrame:
    """Generated patterns and hand-written names with enough words in common."""
    words = lambda c: F.explode(tokens(F.replace(F.col(c), F.lit("_"), F.lit(" ")), []))
    g = generated.select("pattern", words("pattern").alias("token"))
    w = written.select("name", words("name").alias("token"))
    return (
        g.join(w, "token").groupBy("pattern", "name").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= shared)
    )


def bullet_groups(bullets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, edges) for the greedy merge of ``id, pattern, description, rank``.

    Bullets with the same words and the same name family are linked to the same others,
    so the best-ranked one leads and the rest follow it: ``members`` map id to
    leader.  ``edges`` link leaders alike enough to merge; two patterns of one family need less overlap.
    """
    words = tokens(F.col("description"), STOPWORDS_PLAYBOOK)
    keyed = bullets.select("id", "pattern", "rank", F.element_at(F.split("pattern", "_"), 1).alias("family"), *_as_text(words))
    sig = F.when(F.col("n") > 0, F.sha2("text", 256)).otherwise(F.concat(F.lit("-"), "id"))
    low = BULLET_THRESHOLD - FAMILY_DISCOUNT
    with lean(bullets.sparkSession):
        keyed, drop = passing(keyed.withColumn("_sig", sig), "bullets")
        leaders = cut_lineage(
            keyed.groupBy("_sig", "family").agg(F.min_by("id", "rank").alias("leader"), F.min_by("pattern", "rank").alias("lead_pattern"))
        )
        members = cut_lineage(keyed.select("id", "_sig", "family").join(leaders, ["_sig", "family"]).select("id", "leader"))
        distinct = _distinct(keyed.where(F.col("n") > 0).select(F.col("_sig").alias("id"), "n", "text", "_sig"))
        drop()
        across = _scored(distinct, low)
    side = lambda x: leaders.select(F.col("_sig").alias(x), F.col("leader").alias(f"_l{x}"), F.col("family").alias(f"_f{x}"), F.col("lead_pattern").alias(f"_p{x}"))
    la, lb = side("a"), side("b")
    same_family = (F.col("_fa") == F.col("_fb")) & (F.length("_fa") >= 4) & (F.col("_pa") != F.col("_pb"))
    bar = F.when(same_family, F.lit(low)).otherwise(F.lit(BULLET_THRESHOLD))
    linked = across.join(la, "a").join(lb, "b").where(F.col("score") >= bar).select(F.col("_la").alias("a"), F.col("_lb").alias("b"))
    # Equal words under different family names.
    twins = la.join(lb, F.col("a") == F.col("b")).where(F.col("_fa") < F.col("_fb"))
    return members, linked.unionByName(twins.select(F.col("_la").alias("a"), F.col("_lb").alias("b")))


def greedy_survivors(ranked: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, survivor) after a greedy pass by rank.

    An item is kept unless it is linked to a kept item of better rank; a dropped item goes
    to its best kept neighbour.  Each round settles every item whose better neighbours are
    settled, and writes its state so that lost executors cost one round at most.
    """
    r = ranked.select("id", "rank")
    ra = r.select(F.col("id").alias("a"), F.col("rank").alias("_ra"))
    rb = r.select(F.col("id").alias("b"), F.col("rank").alias("_rb"))
    first = F.col("_ra") < F.col("_rb")
    directed = cut_lineage(
        edges.join(ra, "a")
        .join(rb, "b")
        .select(
            F.when(first, F.col("a")).otherwise(F.col("b")).alias("better"),
            F.when(first, F.col("b")).otherwise(F.col("a")).alias("id"),
            F.least("_ra", "_rb").alias("better_rank"),
        )
    )
    # Only linked items need rounds; all others are kept at once.
    linked = directed.select("id").unionByName(directed.select(F.col("better").alias("id"))).distinct()
    state = cut_lineage(linked.withColumn("status", F.lit("open")))
    while state.where("status = 'open'").take(1):
        above = (
            directed.join(state.select(F.col("id").alias("better"), F.col("status").alias("_s")), "better")
            .groupBy("id")
            .agg(F.bool_or(F.col("_s") == "kept").alias("_kept"), F.bool_or(F.col("_s") == "open").alias("_open"))
        )
        status = (
            F.when(F.col("status") != "open", F.col("status"))
            .when(F.coalesce("_kept", F.lit(False)), "dropped")
            .when(F.coalesce("_open", F.lit(False)), "open")
            .otherwise("kept")
        )
        state = cut_lineage(state.join(above, "id", "left").select("id", status.alias("status")))
    kept = state.where("status = 'kept'").select(F.col("id").alias("better"))
    target = directed.join(kept, "better", "left_semi").groupBy("id").agg(F.min_by("better", "better_rank").alias("_t"))
    settled = state.join(target, "id", "left").select(
        "id", F.when(F.col("status") == "kept", F.col("id")).otherwise(F.col("_t")).alias("survivor")
    )
    alone = r.join(linked, "id", "left_anti").select("id", F.col("id").alias("survivor"))
    return settled.unionByName(alone)
