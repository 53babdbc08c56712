"""Long, repetitive and oddly named inputs of the operators for training text."""

import random
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from feedloom.llm import chat, decontamination, language, minhash, packing, pii, secrets
from feedloom.llm.arrays import bound, running, with_parts
from feedloom.llm.tokens import byte_level

DOCS = "doc_id long, text string"


# --- arrays ---------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 2000])
def test_running_and_parts(spark, n):
    rng = random.Random(n)
    values = [rng.randrange(100) for _ in range(n)]
    text = "".join(rng.choice("aé😀 \n") for _ in range(n))
    df = spark.createDataFrame([(values, text)], "v array<long>, text string")
    sums = running(F.col("v"), F.lit(5).cast("long"), lambda a, x: a + x)
    cut = with_parts(F.col("text"), lambda part, size: F.array(part(F.lit(n // 2), F.lit(40)), part(F.lit(0), F.lit(n)), size.cast("string")))
    got = df.select(sums.alias("s"), cut.alias("c"), bound(F.size("v"), lambda k: k + k).alias("b")).first()
    assert got.s == [5 + sum(values[: k + 1]) for k in range(n)]
    assert got.c == [text[n // 2 : n // 2 + 40], text, str(n)] and got.b == 2 * n


# --- personal data and secrets ----------------------------------------------------------------


def test_many_spans_in_one_text_take_linear_time(spark):
    n = 30_000
    df = spark.createDataFrame([(1, "a@b.c " * n), (2, "x " * 5)], DOCS)
    start = time.time()
    got = {r.doc_id: r for r in pii.found(df).collect()}
    clean = {r.doc_id: r.text for r in pii.sanitised(df).collect()}
    assert time.time() - start < 60
    assert got[1].n_email == n and got[1].spans.endswith(f",email:{6 * n - 6}:{6 * n - 1}")
    assert clean == {1: "[EMAIL] " * n, 2: "x " * 5}


def test_overlaps_in_a_long_text_are_merged_as_in_a_short_one(spark):
    piece = "see x@a.b-4111 1111 1111 1111. 10.0.0.0 4111 1111 1111 1111 a@b.c 10.0.0.1 é "
    one = pii.sanitised(spark.createDataFrame([(1, piece)], DOCS)).first().text
    many = pii.sanitised(spark.createDataFrame([(1, piece * 700)], DOCS)).first().text
    assert many == one * 700 and one == "see [EMAIL][CARD]. [IP][CARD] [EMAIL] [IP] é "


def test_sanitised_keeps_columns_of_any_name(spark):
    names = "text string, _base long, _content string, _terms int, _apart long, row string, kinds int, `term` string, doc_id long"
    rows = [("mail a@b.c now", 1, "c", 2, 3, "r", 4, "t", 7), (None, 1, "c", 2, 3, "r", 4, "t", 8), ("", None, None, None, None, None, None, None, None), ("mail a@b.c now", 1, "c", 2, 3, "r", 4, "t", 7)]
    df = spark.createDataFrame(rows, names)
    got = pii.sanitised(df)
    assert got.schema.names == df.schema.names
    want = [("mail [EMAIL] now" if r[0] and "@" in r[0] else r[0], *r[1:]) for r in rows]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


def test_parts_of_mixed_runs_that_overlap(spark):
    rng = random.Random(2)
    runs = sorted((a := rng.randrange(3000), a + rng.randrange(1, 9)) for _ in range(1000))
    want = []
    for a, b in runs:
        if want and a < want[-1][1]:
            want[-1][1] = max(want[-1][1], b)
        else:
            want.append([a, b])
    df = spark.createDataFrame([([{"start": a, "end": b} for a, b in runs],), ([],)], "runs array<struct<start:long,end:long>>")
    got = [[[x.start, x.end] for x in r.a] for r in df.select(secrets.apart(F.col("runs")).alias("a")).collect()]
    assert got == [want, []]


# --- decontamination -------------------------------------------------------------------------


def test_repetitive_text_in_bounded_memory():
    passages = decontamination.Passages([("ha", "ha " * 330), ("no", "something else that is long enough")])
    tracemalloc.start()
    found = passages.within(decontamination.folded("ha " * 60_000)[0])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == {0: (0, 0, 989)} and most < 200e6


def test_slices_of_hits_give_the_same_bands(monkeypatch):
    rng = random.Random(4)
    text = decontamination.folded("".join(rng.choice("ab ") for _ in range(3000)))[0]
    passages = decontamination.Passages([(k, "".join(map(chr, text[k : k + 90]))) for k in range(0, 2900, 200)])
    whole = passages.bands(text)
    monkeypatch.setattr(decontamination, "HITS", 50)
    assert passages.bands(text) == whole and whole


def test_blocks_copies_and_long_texts_of_decontamination(spark, monkeypatch):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    passage = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(6)]
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 250)
    monkeypatch.setattr(decontamination, "SEGMENT", 500)
    items = [(k, passage[k % 6]) for k in range(9)] + [(50, None), (51, "")]
    long = " ".join(rng.choice(words) for _ in range(400))
    docs = [(1, f"{long} {passage[0].upper()} {long}"), (1, f"{long} {passage[0].upper()} {long}"), (2, f"x {passage[1][:60]}Q{passage[1][61:]}!"), (3, long), (4, None), (None, passage[2])]
    df = spark.createDataFrame([(*d, "i", "s") for d in docs], "doc_id long, text string, passage string, start string")
    benchmark = spark.createDataFrame([(*i, 9) for i in items], "item_id long, text string, block long")
    got = sorted((tuple(r) for r in decontamination.contaminated(df, benchmark).collect()), key=str)
    want = []
    for doc, text in docs:
        for item, p in items:
            at = (text or "").lower().find(p) if p else -1
            if at >= 0:
                want.append((doc, item, at, at + len(p), 0))
            elif doc == 2 and item in (1, 7):
                want.append((doc, item, 2, 2 + len(passage[1]), 1))
    assert got == sorted(want, key=str)
    left = decontamination.uncontaminated(df, benchmark)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [3, 4]
    assert decontamination.contaminated(df, benchmark.where("false")).count() == 0
    assert decontamination.contaminated(df.where("false"), benchmark).count() == 0


def test_rows_stay_in_spark_when_passages_are_looked_for(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 30)  # several blocks
    passage = ["the first passage of the benchmark", "a second passage of the benchmark"]
    items = spark.createDataFrame(list(enumerate(passage)), "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {passage[0]}"), (2, f"{passage[1]} y"), (3, "nothing of it"), (4, None), (None, passage[0])], DOCS)
    docs = docs.withColumn("waited", F.make_interval(days=F.lit(3)))  # a type that can't go to Python
    left = decontamination.uncontaminated(docs, items)
    assert left.schema == docs.schema
    got = left.select("doc_id", "text", F.col("waited").cast("string").alias("waited")).collect()
    assert sorted(map(tuple, got)) == [(3, "nothing of it", "3 days"), (4, None, "3 days")]



# --- chat ------------------------------------------------------------------------------------


def test_prefixes_are_rendered_whole_one_after_the_other():
    calls = []

    def template(turns):
        calls.append(len(turns))
        return chat.marked_turns(turns)

    turns = [("user", f"t{k}") for k in range(8)]
    rows = chat.pieces_of(template, turns, None)
    assert calls == [k for k in range(1, 9) for _ in range(2)]
    assert "".join(r[1] for r in rows) == chat.marked_turns(turns) and not any(r[-1] for r in rows)


def test_the_registered_query_renders_whole_prefixes(spark, monkeypatch):
    """A template that changes what stands before turn 5 is seen in the query's own path."""

    def rewriting(turns):
        return ("" if len(turns) < 6 else "!") + chat.marked_turns(turns)

    made = []
    real = chat.formatted

    def formatted(conversations, *args, **options):
        made.append(options)
        return real(conversations, rewriting, **options)

    monkeypatch.setattr(chat, "formatted", formatted)
    back = []
    monkeypatch.setattr(chat, "read_back", lambda pieces: back.append(pieces) or pieces)
    marks = chat.op6_chat(spark, "/root/testdata/sf0.001").where("rewrites").select("seq").distinct().collect()
    assert [r.seq for r in marks] == [5] and made == [{}]


def test_chat_keeps_to_its_own_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", "a", "p", 5), (1, 1, "assistant", "b" * 200_000, "p", 5)], "conv_id long, turn long, role string, text string, piece string, seq int")
    back = chat.read_back(chat.formatted(df)).first()
    assert (back.n_turns, back.loss_chars) == (2, 200_000)


# --- packing ---------------------------------------------------------------------------------


def test_every_column_of_the_packing_against_the_library(spark):
    import zlib

    import duckdb

    from feedloom.llm.queries import QUERIES
    from feedloom.llm.tokens import ByteLevelIds

    sf = "/root/testdata/sf0.001"
    tokenizer = ByteLevelIds("byte_bpe_50k.json").tokenizer
    docs = duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{sf}/documents.parquet'").fetchall()
    ids = {k: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for k, t in docs}
    pieces, sequences = {}, {}
    for r in QUERIES["op4_packing"](spark, sf).collect():
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.length > 0
        assert r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for k, own in ids.items():
        at = 0
        for start, length in sorted(pieces[k]):
            assert start == at
            at += length
        assert at == len(own)
    total = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
        total += at
    assert total == sum(map(len, ids.values())) and len(sequences) <= -(-total // 1024) + 8


# --- added spans of secrets ---------------------------------------------------------------------


def test_discoveries_by_a_direct_loop():
    """The Benjamini-Hochberg rule over binned p-values, per stratum, against the rule over all p-values."""
    rng = random.Random(9)
    for _ in range(20):
        runs = [(rng.randrange(5), min(secrets.BINS, int(rng.expovariate(0.2) * rng.choice([1, 1, 8])))) for _ in range(400)]
        counts = {}
        for r in runs:
            counts[r] = counts.get(r, 0) + 1
        least = secrets.thresholds(counts)
        for s in range(5):
            p = sorted(10 ** (-b / secrets.PER_DECADE) for k, b in runs if k == s)
            passing = [x for i, x in enumerate(p, 1) if x * len(p) <= secrets.RATE * i]
            want = sum(x <= passing[-1] for x in p) if passing else 0
            assert sum(k == s and b >= least[s] for k, b in runs) == want


def test_battery_tells_random_from_text_and_patterns():
    rng = random.Random(10)
    passed = [secrets.battery([rng.randrange(62) for _ in range(48)], 62) > secrets.ALPHA for _ in range(300)]
    assert sum(passed) >= 290
    assert secrets.battery(list(range(48)), 62) < secrets.ALPHA and secrets.battery([1, 60] * 24, 62) < secrets.ALPHA


# --- memory of Python workers -------------------------------------------------------------------


@pytest.mark.parametrize("step", [minhash._prints, minhash._facts])
def test_words_of_a_task_are_given_back(step):
    texts = [" ".join(f"w{i}x{k}" for k in range(300)) for i in range(400)]
    batch = pa.record_batch([pa.array(range(400)), pa.array(texts)], ["doc_id", "text"])
    most = 0
    for out in step(5)(iter([batch])):
        most = max(most, len(minhash._words.young))
    assert 0 < most <= 50_000 and not minhash._words.young and not minhash._words.old


def test_chunks_of_a_packing_task_are_given_back(monkeypatch):
    class Plan:
        """Gives the function of the worker instead of a table."""

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    class Task:
        get = classmethod(lambda cls: cls)
        partitionId = staticmethod(lambda: 0)  # noqa: N815

    monkeypatch.setattr(packing, "TaskContext", Task)
    monkeypatch.setattr(packing, "F", type("Columns", (), {"col": staticmethod(lambda name: type("C", (), {"cast": lambda s, t: s, "alias": lambda s, n: s})())}))
    run = corpus_pipeline.packing(None, Plan(), "")
    batch = pa.record_batch([pa.array([1, 2]), pa.array(["some words here", "more words there"])], ["doc_id", "text"])
    first, again = (pa.Table.from_batches(run(iter([batch]))).to_pylist() for _ in range(2))
    encoder = byte_level("byte_bpe_50k.json")
    assert first == again and {r["doc_id"] for r in first} == {1, 2}
    assert not any(held.young or held.old for held in (encoder.words, encoder.first, encoder.spaced))


def test_text_vectors_need_few_n_grams_at_once(monkeypatch):
    """The vectors multiplied at once stay small, and the parts make no difference."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäöü ") for _ in range(400)) for _ in range(80)]
    sizes, of = [], language.Grams.of
    monkeypatch.setattr(language.Grams, "of", lambda self, codes: sizes.append(len(codes)) or of(self, codes))
    got = language.text_vectors(texts)
    assert max(sizes) <= 512 < sum(sizes)
    monkeypatch.setattr(language, "PART", 1 << 20)
    assert np.array_equal(got, language.text_vectors(texts))


def test_personal_data_starts_no_python_workers(spark, monkeypatch):
    rows = [(i, f"write to user{i}@example.com about reference blue{i % 2}") for i in range(12)] + [(20 + i, "nothing here") for i in range(12)]
    docs = spark.createDataFrame(rows, DOCS)

    def refused(*args, **kwargs):
        raise AssertionError("rows of the driver are read by Python workers")

    monkeypatch.setattr(type(spark), "createDataFrame", refused)
    texts = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert texts[20] == "nothing here" and all("@" not in texts[i] and "[EMAIL]" in texts[i] for i in range(12)) and len(texts) == 24
