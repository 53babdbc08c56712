"""Personal data: fixed patterns and information-theoretic sanitisation, in DataFrame operations alone.

Patterns (email, ip, card, phone) give the base spans.  Offsets come from one expression per kind that
starts where the last match ended, skips as little as possible and then matches; its pieces' lengths add
up to the matches' ends.  All repeated groups are possessive, so long texts need no deep stack.

Then the corpus tells which ordinary terms reveal a protected entity.  An entity is a kind (any
phone number) or a value (one phone number).  A term and an entity occur together where one distinct text holds
both, wherever they stand in it.  With n(t) the texts that hold a term outside base spans, n(e) those that hold an entity,
n(t, e) those with both and N all distinct texts, the disclosure of e by t is PMI(t, e) / IC(e) =
log(n(t, e) N / (n(t) n(e))) / log(N / n(e)): 1 where the term is only ever found together with the entity, 0
where it is as frequent there as elsewhere.  A term in at least ``SUPPORT`` texts with the entity whose
disclosure reaches ``GENERALISE`` is generalised to its class ([WORD], [NAME], [NUMBER]) wherever it
stands in a text that holds that entity; from ``REMOVE`` on it is removed.  Where most texts hold an entity, a rare
term is together with it by chance alone: terms stay if that has a probability (Chernoff's bound) over ``CHANCE``.

Copies of a text count once.  All counts cover the whole corpus.  A text
without base spans is left alone.  Null texts count as empty; repeated rows get the same result; an empty table gives an empty
result; other columns are kept by ``sanitised`` and not read by ``found``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedloom.llm.arrays import bound, running, with_parts
from feedloom.llm.common import table, written

KINDS = ("email", "ip", "card", "phone", "term")
#: Expression of each kind, what may not stand before a match that does not follow another, and a cheap sign.
EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"(?<![A-Za-z0-9._%+-])"
IP = r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"(?<![0-9])"
CARD = r"[0-9](?:[\x20-]?[0-9])++", ""
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]", ""
TERM = r"[\p{L}\p{N}]++", r"(?<![\p{L}\p{N}])"
CARD_SIGN = r"[0-9](?:[\x20-]?[0-9]){11}"
IP_SIGN = r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"
SUPPORT, GENERALISE, REMOVE, CHANCE = 5, 0.9, 0.99, 1e-3
TAGS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]")
SPAN = "struct<start:long,kind:int,end:long,value:string>"


def matches(text: Column, pattern: tuple[str, str], kind: int, offset: Column | None = None) -> Column:
    """Array of (start, kind, end, value) of leftmost non-overlapping matches."""
    body, before = pattern
    rule = F.lit(rf"\G(?s)(|.*?{before})({body})")
    lengths = F.transform(F.regexp_extract_all(text, rule, F.lit(0)), lambda x: F.length(x).cast("long"))
    first = F.lit(0).cast("long") if offset is None else offset.cast("long")
    ends = running(lengths, first, lambda at, n: at + n)
    values = F.regexp_extract_all(text, rule, F.lit(2))
    pair = lambda e, v: F.struct((e - F.length(v)).alias("start"), F.lit(kind).alias("kind"), e.alias("end"), v.alias("value"))
    return F.zip_with(ends, values, pair)


def small_part(part: Column) -> Column:
    digits = F.regexp_replace(part, "^0+", "")
    return (F.length(digits) <= 3) & (F.coalesce(digits.try_cast("int"), F.lit(0)) <= 255)


def luhn(value: Column) -> Column:
    digits = F.reverse(F.regexp_replace(value, "[^0-9]", ""))
    places = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.struct(i.alias("i"), F.substr(digits, i, F.lit(1)).cast("int").alias("d")))
    doubled = lambda x: F.when(x["i"] % 2 == 1, x["d"]).otherwise(x["d"] * 2 - F.when(x["d"] > 4, 9).otherwise(0))
    return F.length(digits).between(12, 19) & (F.aggregate(places, F.lit(0), lambda a, x: a + doubled(x)) % 10 == 0)


def base_spans(text: Column) -> Column:
    """All base spans by start, then kind as listed."""
    none = F.array().cast(f"array<{SPAN}>")
    some = lambda sign, spans: F.when(sign, spans).otherwise(none)
    digits = lambda v: F.length(F.regexp_replace(v, "[^0-9]", ""))
    return F.array_sort(
        F.concat(
            some(F.contains(text, F.lit("@")), matches(text, EMAIL, 0)),
            some(text.rlike(IP_SIGN), F.filter(matches(text, IP, 1), lambda s: F.forall(F.split(s["value"], r"\."), small_part))),
            some(text.rlike(CARD_SIGN), F.filter(matches(text, CARD, 2), lambda s: digits(s["value"]).between(12, 19) & luhn(s["value"]))),
            some(F.contains(text, F.lit("+")), F.filter(matches(text, PHONE, 3), lambda s: digits(s["value"]).between(9, 15))),
        )
    )


def annotated(docs: DataFrame) -> DataFrame:
    """The rows with _base (base spans) and _content (a digest of the text)."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumn("_base", base_spans(text)).withColumn("_content", F.when(F.size("_base") > 0, F.md5(text)))


def merged(spans: Column) -> Column:
    """Overlapping base spans, ordered by start, as one interval each: start, end and by, the tags of its kinds."""
    tag = lambda s: F.array(F.get(F.array(*[F.lit(t) for t in TAGS]), s["kind"]))
    state = lambda opens, start, end, tags: F.struct(opens.alias("opens"), start.alias("start"), end.alias("end"), tags.alias("tags"))

    def step(last: Column, s: Column) -> Column:
        wider = state(F.lit(False), last["start"], F.greatest(last["end"], s["end"]), F.array_union(last["tags"], tag(s)))
        return F.when(s["start"] < last["end"], wider).otherwise(state(F.lit(True), s["start"], s["end"], tag(s)))

    nothing = state(F.lit(False), F.lit(0).cast("long"), F.lit(0).cast("long"), F.array().cast("array<string>"))
    ended = lambda all_: F.filter(all_, lambda x, i: F.coalesce(F.get(all_, i + 1)["opens"], F.lit(True)))

    def over(spans: Column) -> Column:
        after = F.zip_with(spans, F.slice(spans, F.lit(2), F.greatest(F.lit(0), F.size(spans) - 1)), lambda s, t: F.coalesce(t["start"] >= s["end"], F.lit(True)))
        alone = F.transform(spans, lambda s: state(F.lit(True), s["start"], s["end"], tag(s)))
        return F.when(F.forall(after, lambda x: x), alone).otherwise(bound(running(spans, nothing, step), ended))

    return F.transform(bound(spans, over), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.array_join(x["tags"], "").alias("by")))


def clear_gaps(text: Column) -> Column:
    """Array of (start, end) of what lies between base spans, less the letters and digits that touch a span's own."""

    def between(spans: Column) -> Column:
        n = F.size(spans)
        end_of = lambda i: F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(F.lit(0).cast("long"))
        start_of = lambda i: F.when(i < n, F.get(spans, i)["start"]).otherwise(F.length(text).cast("long"))
        return F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(end_of(i).alias("start"), start_of(i).alias("end")))

    def cut(part: Callable[[Column, Column], Column], size: Column) -> Column:
        own = lambda g: part(g["start"], g["end"] - g["start"])
        sign = lambda at: part(at, F.lit(1)).rlike(TERM[0])
        left = lambda g: F.when((g["start"] > 0) & sign(g["start"] - 1), F.length(F.regexp_extract(own(g), "^" + TERM[0], 0))).otherwise(0)
        right = lambda g: F.when((g["end"] < size) & sign(g["end"]), F.length(F.regexp_extract(own(g), TERM[1] + TERM[0] + r"\z", 0))).otherwise(0)
        gaps = F.transform(bound(merged(F.col("_base")), between), lambda g: F.struct((g["start"] + left(g)).alias("start"), g["end"].alias("end")))
        return F.transform(gaps, lambda g: F.struct(g["start"].alias("start"), (g["end"] - right(g)).alias("end")))

    return with_parts(text, cut)


def terms_of(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TERM[0]), F.lit(0)), F.lower)


def clear_terms(text: Column) -> Column:
    held = lambda part, _: F.transform("_gaps", lambda g: terms_of(part(g["start"], g["end"] - g["start"])))
    return F.array_distinct(F.flatten(with_parts(text, held)))


def personal_texts(rows: DataFrame) -> DataFrame:
    """_content, text, _base, _gaps and kinds (a bit for each kind), a row per distinct text with base spans."""
    own = rows.where("_content IS NOT NULL").select("_content", "text", "_base").dropDuplicates(["_content"])
    has = lambda k: F.when(F.exists("_base", lambda s: s["kind"] == k), 1 << k).otherwise(0)
    return own.select("_content", "text", "_base", clear_gaps(F.col("text")).alias("_gaps"), (has(0) + has(1) + has(2) + has(3)).alias("kinds"))


def term_counts(docs: DataFrame, own: DataFrame) -> DataFrame:
    """term and n, the distinct texts that hold it outside base spans; the empty term stands for all of them."""
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).distinct()
    words = texts.select(F.explode(F.array_distinct(F.concat(F.array(F.lit("")), terms_of(F.col("text"))))).alias("term"), F.lit(1).alias("x"))
    hidden = own.select(F.explode(F.array_except(terms_of(F.col("text")), clear_terms(F.col("text")))).alias("term"), F.lit(-1).alias("x"))
    return words.union(hidden).groupBy("term").agg(F.sum("x").alias("n")).where("n > 0")


def disclosures(pairs: DataFrame, total: int, least: float) -> DataFrame:
    """pairs (n, n_e, n_te and more) with their disclosure, where it reaches ``least`` and is no matter of chance."""
    n, n_e, n_te, all_texts = F.col("n").cast("double"), F.col("n_e").cast("double"), F.col("n_te").cast("double"), F.lit(float(max(total, 1)))
    share = F.least(F.lit(1.0), F.log(n_te * all_texts / (n * n_e)) / F.log(all_texts / n_e))
    apart = F.when(n > n_te, (n - n_te) * F.log((1 - n_te / n) / (1 - n_e / all_texts))).otherwise(0.0)
    unlikely = n_te * F.log(n_te * all_texts / (n * n_e)) + apart >= -math.log(CHANCE)
    return pairs.where((F.col("n_e") < total) & (F.col("n_te") * F.lit(total) > F.col("n") * F.col("n_e")) & unlikely).withColumn("disclosure", share).where(F.col("disclosure") >= least)


def disclosing(docs: DataFrame, own: DataFrame, terms: DataFrame, values: DataFrame, support: int = SUPPORT, least: float = GENERALISE) -> tuple[DataFrame, DataFrame]:
    """Terms that reveal a kind (kind, term, disclosure) and terms that reveal a value (kind, value, term, disclosure)."""
    counts = written(term_counts(docs, own), "terms")
    total = (counts.where("term = ''").first() or [None, 0])[1]
    bit = lambda k: F.col("kinds").bitwiseAND(F.lit(1 << k)) > 0
    n_kinds = [F.count(F.when(bit(k), 1)).alias(f"n{k}") for k in range(4)]
    by_kind = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"n{k}").alias("n_te")) for k in range(4)]))
    joint = terms.groupBy("term").agg(F.count("*").alias("texts"), *n_kinds).where(F.col("texts") >= support)
    joint = written(joint.join(counts, "term"), "joint")
    sizes = own.agg(*n_kinds).select(by_kind.alias("k")).select("k.kind", F.col("k.n_te").alias("n_e"))  # rows of the driver would start Python workers
    kinds = joint.select("term", "n", by_kind.alias("k")).select("term", "n", "k.*").where(F.col("n_te") >= support)
    kinds = disclosures(kinds.join(F.broadcast(sizes), "kind"), total, least).select("kind", "term", "disclosure")
    often = values.groupBy("kind", "value").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= support)
    # n_te is at most n_e, so a term in more texts than this can't reach the least disclosure of the value
    reach = F.col("n") <= F.pow(F.lit(float(max(total, 1))), F.lit(1 - least)) * F.pow(F.col("n_e").cast("double"), F.lit(least)) * 1.000001
    held = values.join(often, ["kind", "value"])
    rare = terms.join(joint.select("term", "n"), "term").join(held.select("_content").distinct(), "_content", "left_semi")
    pairs = rare.join(held, "_content").where(reach).groupBy("kind", "value", "term").agg(F.count("*").alias("n_te"), F.first("n").alias("n"), F.first("n_e").alias("n_e"))
    pairs = disclosures(pairs.where(F.col("n_te") >= support), total, least).select("kind", "value", "term", "disclosure")
    return written(kinds, "disclosing"), written(pairs, "disclosing")


def placed(own: DataFrame) -> DataFrame:
    """_content, term, start and end of every term outside base spans."""
    held = lambda part, _: F.transform("_gaps", lambda g: F.struct(g["start"].alias("at"), part(g["start"], g["end"] - g["start"]).alias("gap")))
    gaps = own.select("_content", F.explode(with_parts(F.col("text"), held)).alias("g")).select("_content", "g.*")
    rule = F.lit(r"([^\p{L}\p{N}]*+)(" + TERM[0] + ")")
    parts = F.arrays_zip(F.regexp_extract_all("gap", rule, F.lit(1)).alias("before"), F.regexp_extract_all("gap", rule, F.lit(2)).alias("term"))
    pieces = gaps.select("_content", "at", F.posexplode(parts).alias("k", "p")).select("_content", "at", "k", "p.term", (F.length("p.before") + F.length("p.term")).alias("n"))
    ends = F.sum("n").over(Window.partitionBy("_content", "at").orderBy("k"))
    spans = pieces.select("_content", "term", (F.col("at") + ends).cast("long").alias("end"))
    return spans.select("_content", F.lower("term").alias("term"), (F.col("end") - F.length("term")).alias("start"), "end")


def term_spans(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """_content and _terms, the spans of disclosing terms of each text."""
    own = written(personal_texts(rows), "texts")
    terms = written(own.select("_content", "kinds", F.explode(clear_terms(F.col("text"))).alias("term")), "text-terms")
    entity = F.array_distinct(F.transform("_base", lambda s: F.struct(s["kind"].alias("kind"), F.lower(s["value"]).alias("value"))))
    values = own.select("_content", F.explode(entity).alias("e")).select("_content", "e.*")
    by_kind, by_value = disclosing(docs, own, terms, values)
    of_kind = F.expr("kinds & shiftleft(1, kind)") > 0
    hits = terms.join(by_kind, "term").where(of_kind).select("_content", "term", "disclosure")
    beside = values.join(by_value, ["kind", "value"]).select("_content", "term", "disclosure")
    hits = hits.union(beside.join(terms.select("_content", "term"), ["_content", "term"]))
    hits = written(hits.groupBy("_content", "term").agg(F.max("disclosure").alias("disclosure")), "hits")
    found = placed(own.join(hits.select("_content").distinct(), "_content", "left_semi")).join(hits, ["_content", "term"])
    span = F.struct("start", F.lit(4).alias("kind"), "end", F.col("disclosure").cast("string").alias("value"))
    return written(found.groupBy("_content").agg(F.sort_array(F.collect_list(span)).alias("_terms")), "term-spans")


def joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def all_spans() -> Column:
    return F.array_sort(F.concat("_base", F.coalesce("_terms", F.array().cast(f"array<{SPAN}>"))))


def found(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = annotated(docs)
    kept = written(rows.select("doc_id", "_base", "_content", F.when(F.size("_base") > 0, F.col("text")).alias("text")), "personal")
    marked = kept.select("doc_id", "_base", "_content").join(term_spans(docs, kept), "_content", "left")
    number = lambda k: F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long")
    return marked.select(
        "doc_id",
        number(0).alias("n_email"),
        number(1).alias("n_ip"),
        number(2).alias("n_card"),
        number(3).alias("n_phone"),
        F.sha2(joined(F.col("_base")), 256).alias("base_sha256"),
        joined(all_spans()).alias("spans"),
    )


def replacement(term: Column, disclosure: Column) -> Column:
    """What stands for a term."""
    wider = F.when(term.rlike("^[0-9]+$"), "[NUMBER]").when(term.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")
    return F.when(disclosure >= REMOVE, "").otherwise(wider)


def sanitised(docs: DataFrame) -> DataFrame:
    """The rows of docs with base spans replaced by tags and disclosing terms generalised or removed.

    Base spans that overlap are replaced as one interval, by the tags of all its kinds.  Columns may have any names.
    """
    rows = annotated(docs.select(F.struct("*").alias("row"), "text"))
    slim = written(rows.where("_content IS NOT NULL").select("text", "_base", "_content"), "personal")
    marked = rows.join(term_spans(docs, slim), "_content", "left")

    def clean(part: Callable[[Column, Column], Column], size: Column) -> Column:
        by = lambda s: replacement(part(s["start"], s["end"] - s["start"]), s["value"].cast("double"))
        hidden = F.transform(F.coalesce("_terms", F.array().cast(f"array<{SPAN}>")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), by(s).alias("by")))

        def joined_up(spans: Column) -> Column:
            before = lambda i: F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))
            piece = lambda s, i: F.concat(part(before(i), s["start"] - before(i)), s["by"])
            rest = F.substr("text", (F.coalesce(F.get(spans, F.size(spans) - 1)["end"], F.lit(0)) + 1).cast("int"), size)
            return F.when(F.size(spans) > 0, F.concat(F.array_join(F.transform(spans, piece), ""), rest)).otherwise(F.col("text"))

        return bound(F.array_sort(F.concat(merged(F.col("_base")), hidden)), joined_up)

    text = F.when((F.size("_base") > 0) | F.col("_terms").isNotNull(), with_parts(F.col("text"), clean)).otherwise(F.col("text"))
    return marked.select(F.col("row").withField("text", text).alias("row")).select("row.*")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return found(table(spark, sf_dir, "documents"))
