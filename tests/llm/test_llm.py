"""The operators for training text against brute force, exact round trips and held-out accuracy."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.llm import chat, decontamination, language, minhash, packing, pii, secrets, token_counts, token_files, topk
from feedloom.llm.common import shared_folder
from feedloom.llm.queries import CHECKS, QUERIES
from feedloom.llm.tokens import ByteLevelIds, Remembered, WordCounts

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
ODD = [
    "", " ", "  ", "a  b", " a", "a \n b", "it's 'll don't", "x\n\n y  ", "日本語 text", "½ cup ² n", "İstanbul", "a<|endoftext|>b",
    "<|startoftext|> Hi", "\x1c a", "a_b __ c1 12", "naïve café—“q” …", "tab\tx  \n", "ﬁ é É", "A b", "'S 'T it'S", "Ünï 12,5 €", "word " * 3000,
]


@pytest.fixture(scope="module")
def documents():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_against_sql(spark, con, name):
    from tests.compare import table

    df = QUERIES[name](spark, SF)
    cur = con.execute(CHECKS[name])
    assert table(df.columns, rows(df)) == table([d[0] for d in cur.description], cur.fetchall())


def test_names():
    assert {re.match(r"op\d+|pipeline", n)[0] for n in QUERIES} == {*(f"op{k}" for k in range(1, 14)), "pipeline"}


# --- tokens ---------------------------------------------------------------------------------


def test_ids_and_counts_are_the_librarys(documents):
    ids, counts = ByteLevelIds("byte_bpe_50k.json"), WordCounts("word_bpe_49k.json", {"word": 1})
    rng = random.Random(3)
    noise = ["".join(rng.choice("ab é'1. \n,ß") for _ in range(40)) for _ in range(200)]
    for text in [*ODD, *noise, *list(documents.values())[:60]]:
        assert np.frombuffer(ids.ids(text), "<u2").tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids
        assert counts.count(text) == len(counts.tokenizer.encode(text, add_special_tokens=False).ids)


def test_cache_is_bounded():
    held = Remembered(len, limit=10)
    assert [held["x" * k] for k in range(100)] == list(range(100))
    assert len(held.young) <= 10 and len(held.old) <= 10
    assert held.all(["a", "bb", "a"]) == [1, 2, 1]


@pytest.mark.parametrize("texts", [[], [(3, "b c"), (1, None), (2, ""), (3, "b c"), (None, "a")]])
def test_token_files_round_trip(spark, texts):
    folder = shared_folder(spark, "test-files")
    token_files.write(spark.createDataFrame(texts, DOCS), folder, "byte_bpe_50k.json")
    tokenizer = ByteLevelIds("byte_bpe_50k.json").tokenizer
    want, at = [], 0
    for doc_id, text in sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(rows(token_files.digests(spark, folder)), key=lambda r: r[1]) == want


def test_token_counts(spark):
    texts = [(1, None), (2, ""), (3, "Hello world"), (3, "Hello world"), (4, "word " * 3000), (5, "日本語")]
    tokenizer = WordCounts("word_bpe_49k.json").tokenizer
    want = [(i, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in texts]
    docs = spark.createDataFrame([(i, t, 7) for i, t in texts], DOCS + ", n_tokens int")
    assert sorted(rows(token_counts.count_tokens(docs, "word_bpe_49k.json"))) == sorted(want)
    assert rows(token_counts.count_tokens(docs.where("false"), "word_bpe_49k.json")) == []


# --- packing --------------------------------------------------------------------------------


def test_differencing_is_near_equal():
    rng = random.Random(1)
    for windows in (1, 2, 7, 40):
        sizes = [rng.randint(1, 300) for _ in range(windows * 9)]
        dealt = packing.differencing(sizes, windows)
        assert sorted(x for w in dealt for x in w) == list(range(len(sizes)))
        sums = [sum(sizes[x] for x in w) for w in dealt]
        assert len(dealt) == windows and max(sums) - min(sums) <= 60


@pytest.mark.parametrize("cut", [True, False])
def test_pack_keeps_to_the_window(cut):
    rng = random.Random(2)
    for lengths in ([], [1], [1024], [1025, 1023], [rng.randint(1, 3000) for _ in range(300)]):
        pieces = packing.pack(lengths, 1024, cut)
        for i, n in enumerate(lengths):
            own = sorted((s, k) for x, s, k, _, _ in pieces if x == i)
            assert [s for s, _ in own] == [sum(k for _, k in own[:j]) for j in range(len(own))] and sum(k for _, k in own) == n
        by = {}
        for _, _, n, q, at in pieces:
            by.setdefault(q, []).append((at, n))
        sums = []
        for own in by.values():
            own.sort()
            assert [a for a, _ in own] == [sum(n for _, n in own[:j]) for j in range(len(own))]
            sums.append(sum(n for _, n in own))
        assert max(sums, default=0) <= 1024
        if cut and lengths:
            assert len(sums) == -(-sum(lengths) // 1024)


def test_packed_documents(spark):
    assert rows(packing.pack_documents(spark.createDataFrame([], DOCS), "byte_bpe_50k.json")) == []
    got = rows(packing.pack_documents(spark.createDataFrame([(1, None), (2, "a b"), (2, "a b")], DOCS).coalesce(1), "byte_bpe_50k.json"))
    assert sorted((r[0], r[2], r[4]) for r in got) == [(1, 1, 1), (2, 3, 3), (2, 3, 3)]


# --- search ---------------------------------------------------------------------------------


def test_search_with_gaps_ties_and_copies(spark):
    rng = random.Random(4)
    data = [(k, [float(rng.randint(-2, 2)) for _ in range(4)]) for k in range(300)]
    data += [(k, [1.0, 1.0, 0.0, 0.0]) for k in range(300, 420)]
    data += [(500, None), (501, [1.0, None, 1.0, 1.0]), (502, [float("nan")] * 4), (503, [float("inf")] * 4), (None, [1.0] * 4), (504, []), (600, [2.0]), (700, [])]
    df = spark.createDataFrame([(k, v, 1) for k, v in data], "vec_id long, embedding array<float>, score int")
    good = {k: np.array([int(np.floor(1024 * x)) for x in v] + [0] * (4 - len(v)), dtype=int) for k, v in data if k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in (k for k in good if k % 100 == 0):
        best = sorted((-int(good[q] @ v), k) for k, v in good.items() if k != q)[:10]
        want += [(q, r + 1, k, -s) for r, (s, k) in enumerate(best)]
    assert sorted(rows(topk.search(df, F.col("vec_id") % 100 == 0))) == sorted(want)
    assert rows(topk.search(df.where("false"), F.col("vec_id") % 100 == 0)) == []


@pytest.mark.parametrize("scale", [1, 40_000, 1 << 40])
def test_search_in_query_blocks(spark, monkeypatch, scale):
    """Small blocks, small batches of visits, and components of two, four and eight bytes."""
    monkeypatch.setattr(topk, "BLOCK", 7)
    monkeypatch.setattr(topk, "OUT_BYTES", 300)
    rng = random.Random(14)
    data = {k: np.array([rng.randint(-2, 2) for _ in range(4)]) for k in range(300)}
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in data.items()], "vec_id long, embedding array<float>")
    want = []
    for q in range(0, 300, 3):
        best = sorted((-int(data[q] @ v), k) for k, v in data.items() if k != q)[:10]
        want += [(q, r + 1, k, -s) for r, (s, k) in enumerate(best)]
    scaled = [(q, r, k, s * scale * scale) for q, r, k, s in want]
    if scale < 1 << 40:
        assert sorted(rows(topk.search(df, F.col("vec_id") % 3 == 0, scale=scale))) == sorted(scaled)
    else:
        with pytest.raises(Exception, match="64 bits"):
            topk.search(df, F.col("vec_id") % 3 == 0, scale=scale).collect()


def test_search_of_empty_vectors_alone(spark):
    df = spark.createDataFrame([(0, []), (1, []), (2, None)], "vec_id long, embedding array<float>")
    assert sorted(rows(topk.search(df, F.col("vec_id") % 100 == 0))) == [(0, 1, 1, 0)]


# --- personal data --------------------------------------------------------------------------

PII_KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: luhn(v)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= sum(c.isdigit() for c in v) <= 15),
)


def luhn(value):
    digits = [int(c) for c in value if c.isdigit()][::-1]
    return 12 <= len(digits) <= 19 and sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def digest(text, kinds):
    spans = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m[0]))
    return hashlib.sha256(",".join(f"{kinds[k][0]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


def test_personal_data_base_spans(spark):
    rng = random.Random(5)
    noise = ["".join(rng.choice("a1.@+ -_5é(4)") for _ in range(80)) for _ in range(300)]
    texts = [*ODD, *noise, "x" * 50_000 + "@", "1 " * 20_000, "9" * 30_000, "a@b.c_d@e.f a@b.c@d.e", "1.2.3.4.5 256.1.1.1 001.2.3.4", "4111 1111 1111 1111"]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate([*texts, None])], DOCS + ", spans int")
    got = {r.doc_id: r.base_sha256 for r in pii.found(docs).collect()}
    assert got == {k: digest(t or "", PII_KINDS) for k, t in enumerate([*texts, None])}
    assert rows(pii.found(docs.where("false"))) == []


def test_personal_data_terms(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("aeioulnr") for _ in range(6)) for _ in range(400)]
    filler = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(k, f"{filler(20)} Rosebud +1 (555) 555-{1000 + k} {filler(20)}") for k in range(12)] + [(100 + k, filler(40)) for k in range(40)]
    docs.append((200, "Nothing here. " * 3))
    df = spark.createDataFrame(docs, DOCS)
    spans = {r.doc_id: r.spans for r in pii.found(df).collect()}
    clean = {r.doc_id: r.text for r in pii.sanitised(df).collect()}
    for k, text in docs[:12]:
        at = text.index("Rosebud")
        assert f"term:{at}:{at + 7}" in spans[k] and "Rosebud" not in clean[k] and "[PHONE]" in clean[k]
    assert all(spans[k] == "" and clean[k] == t for k, t in docs[12:])


def test_overlapping_personal_data_is_masked_whole(spark):
    texts = ["10.0.0.0 4111 1111 1111 1111", "see x@a.b-4111 1111 1111 1111.", "a@b.c and 10.0.0.1", "x 10.0.0.0 4111 1111 1111 1111 y a@b.c z"]
    clean = {r.doc_id: r.text for r in pii.sanitised(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    assert clean == {0: "[IP][CARD]", 1: "see [EMAIL][CARD].", 2: "[EMAIL] and [IP]", 3: "x [IP][CARD] y [EMAIL] z"}


def test_personal_data_terms_far_from_the_entity(spark):
    rng = random.Random(16)
    words = ["".join(rng.choice("aeioulnr") for _ in range(6)) for _ in range(400)]
    filler = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(k, f"Dear Rosebud, {filler(40)} Ann4111 1111 1111 1111 a@b.c-4111 1111 1111 1111 {filler(40)} {'rosebud' * (k % 2)}") for k in range(12)]
    docs += [(100 + k, f"{filler(40)} +1 (555) 555-0199 {filler(20)} Xanadu" if k < 6 else f"{filler(30)} +1 (555) 555-{1000 + k}") for k in range(30)]
    docs += [(200 + k, filler(60)) for k in range(60)] + [(300 + k, docs[0][1]) for k in range(3)] + [(400, "Rosé " * 3), (401, None)]
    df = spark.createDataFrame(docs, DOCS)
    spans = {r.doc_id: r.spans.split(",") for r in pii.found(df).collect()}
    clean = {r.doc_id: r.text for r in pii.sanitised(df).collect()}
    for name, chosen in (("rosebud", [*range(12), 300, 301, 302]), ("xanadu", range(100, 106))):
        for k in chosen:
            places = [m.start() for m in re.finditer(name, dict(docs)[k].lower())]
            assert places and all(f"term:{at}:{at + len(name)}" in spans[k] for at in places) and name not in clean[k].lower()
    assert all(clean[k] == t for k, t in docs if k >= 200 and k not in (300, 301, 302))
    assert all(clean[k].startswith("Dear") is False and "Ann[CARD]" in clean[k] for k in range(12))


# --- chat -----------------------------------------------------------------------------------


def test_escape_round_trip():
    rng = random.Random(7)
    for _ in range(500):
        text = "".join(rng.choice("<|\\a>") for _ in range(12))
        assert chat.unescaped(chat.escaped(text)) == text and "<|" not in chat.escaped(text)


def forgetful(turns):
    """A template that drops all earlier assistant texts."""
    last = len(turns) - 1
    return "".join(f"[{r}]{'' if r == 'assistant' and k < last else t}\n" for k, (r, t) in enumerate(turns))


def test_chat_spans_and_rewrites(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|>"), (1, 2, "user", None), (1, 2, "user", None), (None, 0, None, "x"), (2, 5, "assistant", "")]
    turns += [(3, k, "assistant" if k % 2 else "user", f"t{k}") for k in range(150)]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, offset int")
    pieces = chat.formatted(df)
    whole = {}
    for r in sorted(pieces.collect(), key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.seq)):
        assert r.offset == len(whole.get(r.conv_id, ""))
        whole[r.conv_id] = whole.get(r.conv_id, "") + r.piece
        assert not r.rewrites
    assert whole[1] == chat.marked_turns([("user", "hi"), ("assistant", "<|im_end|>"), ("user", ""), ("user", "")])
    assert whole[3] == chat.marked_turns([(r, t) for c, _, r, t in turns if c == 3])
    back = {r.conv_id: r for r in chat.read_back(pieces).collect()}
    assert back[1].loss_sha256 == hashlib.sha256(b"<|im_end|>").hexdigest() and back[1].n_turns == 4 and back[3].n_turns == 150
    marks = {(r.conv_id, r.seq): r.rewrites for r in chat.formatted(df.where("conv_id = 3 AND turn < 4"), forgetful).collect()}
    assert marks == {(3, 0): False, (3, 1): False, (3, 2): True, (3, 3): False}
    assert rows(chat.read_back(chat.formatted(df.where("false")))) == []


def numbered(turns):
    """A template that refuses turns out of order and numbers them."""
    assert all(r == ("assistant" if k % 2 else "user") for k, (r, _) in enumerate(turns))
    return "".join(f"{k}[{r}]{t}\n" for k, (r, t) in enumerate(turns))


@pytest.mark.parametrize("lookback", [None, 0, 3])
def test_chat_of_long_conversations_by_whole_prefixes(spark, lookback):
    turns = [("assistant" if k % 2 else "user", f"t{k}") for k in range(90)]
    df = spark.createDataFrame([(1, k, *t) for k, t in enumerate(turns)], "conv_id long, turn long, role string, text string")
    pieces = sorted(chat.formatted(df, numbered, lookback=lookback).collect(), key=lambda r: r.seq)
    assert "".join(r.piece for r in pieces) == numbered(turns) and not any(r.rewrites for r in pieces)
    assert all(r.piece[r.text_start : r.text_end] == t and r.offset == len(numbered(turns[:k])) for k, (r, (_, t)) in enumerate(zip(pieces, turns)))
    late = lambda ts: f"<{ts[0][1] if len(ts) < 80 else 'gone'}>" + "".join(t for _, t in ts)
    assert [r.seq for r in chat.formatted(df, late, lookback=lookback).collect() if r.rewrites] == [79]
    assert chat.pieces_of(chat.marked_turns, turns, lookback) == chat.rendered(chat.marked_turns, turns, None)


# --- secrets --------------------------------------------------------------------------------

SECRET_KINDS = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", None),
    ("access", r"AKIA[A-Z0-9]+", lambda v: len(v) >= 20),
    ("hex", r"[0-9a-f]+", lambda v: len(v) >= 24),
)


def test_secrets(spark, documents):
    rng = random.Random(8)
    token = lambda n: "".join(rng.choice(secrets.ENCODINGS[4][1]) for _ in range(n))
    planted = [(1000 + k, f"some plain words {token(48)} and more of them") for k in range(20)]
    texts = [*documents.items(), *planted, (1, None), (2, ""), (3, "PASSWORD = abc123x ſecret: abcdefgh toKen:12"), (4, "a" * 100_000), (5, "AKIA" * 9 + " " + "ab12" * 8)]
    docs = spark.createDataFrame(texts, DOCS)
    got = secrets.scan(docs).collect()
    by_text = dict(texts[len(documents) :])
    for r in got:
        if r.doc_id in by_text:
            text = by_text[r.doc_id] or ""
            spans = sorted(
                (m.start(), k, m.end())
                for k, (n, p, ok) in enumerate(SECRET_KINDS)
                for m in re.finditer(p, text)
                if (len(m[2]) >= 6 if n == "assign" else ok(m[0]))
            )
            said = ",".join(f"{SECRET_KINDS[k][0]}:{a}:{b}" for a, k, b in spans)
            if r.base_sha256 != hashlib.sha256(said.encode()).hexdigest():
                assert r.doc_id in documents  # an id used twice here
    assert sum(r.n_random > 0 for r in got if r.doc_id >= 1000) >= 18
    assert sum(r.n_random for r in got if r.doc_id < 1000) <= 2
    assert rows(secrets.scan(docs.where("false"))) == []


def test_secrets_in_mixed_runs(spark, documents):
    rng = random.Random(18)
    token = lambda n: "".join(rng.choice(secrets.ENCODINGS[4][1]) for _ in range(n))
    tokens = [token(48) for _ in range(20)]
    mixed = [f"see org/reset_password/{t} now" if k % 2 else f"see x/api-v1/{t} now" for k, t in enumerate(tokens)]
    texts = [*documents.items(), *((1000 + k, t) for k, t in enumerate(mixed))]
    got = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(texts, DOCS)).collect() if r.doc_id >= 1000}
    found = 0
    for k, t in enumerate(tokens):
        at = mixed[k].index(t)
        own = [tuple(map(int, s.split(":")[1:])) for s in got[1000 + k].spans.split(",") if s.startswith("random")]
        assert got[1000 + k].n_random == len(own) <= 1
        found += any(a <= at and e == at + 48 for a, e in own)
    assert found >= 18
    assert secrets.parts_of("ab/cd") == [(0, 5)]
    assert secrets.parts_of("a/" + "b" * 16 + "_" + "c" * 16 + "==") == [(0, 18), (19, 37), (2, 37)]


# --- near-duplicates ------------------------------------------------------------------------


def test_components(spark):
    from feedloom.llm.components import components

    chain = [(k, k + 1) for k in range(60)]
    star = [(100, 101 + k) for k in range(50)]
    edges = spark.createDataFrame([*chain, *star, (7, 7), (None, 3)], "a long, b long")
    assert dict(rows(components(edges))) == {**{k: 0 for k in range(61)}, **{100 + k: 100 for k in range(51)}}
    assert rows(components(edges.where("false"))) == []


def brute_components(texts, words, threshold):
    sets = {i: set(minhash.shingle_set(t or "", words).tolist()) for i, t in texts}
    label = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return {i: (len(sets[i]), label[i]) for i in ids}


def test_near_duplicates_of_edited_families(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(3000)]
    texts = []
    for family in range(4):
        base = [rng.choice(words) for _ in range(120)]
        for k in range(60):
            own = list(base)
            for _ in range(rng.randint(0, 16)):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append((family * 100 + k, " ".join(own)))
    texts += [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, texts[0][1].upper()), (906, "é two"), (907, "É two")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(texts, DOCS), words=2).collect()}
    assert got == brute_components(texts, 2, 80)
    assert rows(minhash.near_duplicates(spark.createDataFrame([], DOCS))) == []


# --- language -------------------------------------------------------------------------------


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(400)
    found = language.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in found)


def test_language_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "12 ?!", None), (5, "the dog", None)], DOCS + ", lang string")
    pred = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs, language.fit(docs, F.col("doc_id") < 5)).collect()}
    assert pred[3] == pred[4] == ("und", 0.0) and pred[5][0] == "en"
    none = language.predict(docs, language.fit(docs, F.col("doc_id") < 0)).collect()
    assert {r.lang_pred for r in none} == {"und"}


# --- decontamination ------------------------------------------------------------------------


def edits(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        now = [i + 1]
        for j, x in enumerate(text):
            now.append(min(row[j] + (c != x), row[j + 1] + 1, now[j] + 1))
        row = now
    return min(row)


def test_decontamination_against_full_alignment(spark):
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet' ORDER BY 1").fetchall()[:12]
    rng = random.Random(10)
    texts, want = [], set()
    for item, passage in items:
        m = len(decontamination.folded(passage)[0])
        k = decontamination.budget(m, decontamination.Q, decontamination.RATE)
        for e in (0, k // 2, k, k + 3):
            own = list(passage)
            for _ in range(e):
                p, kind = rng.randrange(len(own)), rng.random()
                own[p : p + 1] = [] if kind < 0.3 else ["q"] if kind < 0.7 else [own[p], "z"]
            texts.append((len(texts), "Words before. " + "".join(own).upper() + " -- and after."))
            codes = decontamination.folded(texts[-1][1])[0].tolist()
            for other, t in items:
                c = decontamination.folded(t)[0].tolist()
                d = edits(c, codes) if other == item else 99
                if d <= decontamination.budget(len(c), decontamination.Q, decontamination.RATE):
                    want.add((texts[-1][0], other, d))
    texts += [(500, None), (501, ""), (502, "tiny passage here"), (503, "tinypassage")]
    benchmark = spark.createDataFrame([*items, (90, None), (91, ""), (92, "Tiny")], "item_id long, text string")
    docs = spark.createDataFrame(texts, DOCS)
    got = {(r.doc_id, r.item_id, r.edits) for r in decontamination.contaminated(docs, benchmark).collect()}
    assert got == want | {(502, 92, 0)}
    clean = {r.doc_id for r in decontamination.uncontaminated(docs, benchmark).collect()}
    assert clean == {i for i, _ in texts} - {i for i, _, _ in got}
    assert rows(decontamination.contaminated(docs, benchmark.where("false"))) == []


# --- pipeline -------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(9000, None, "en", "s", 0), (9001, "?? 12", "en", "s", 5), (None, "some words without an id", None, None, None)], docs.schema)
    docs = docs.union(extra).union(docs.limit(3))
    benchmark = [t for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, kept[-1], SF).write.parquet(str(tmp_path / name))
        kept.append(spark.read.parquet(str(tmp_path / name)))
    assert all(k.columns == docs.columns for k in kept[:-1])
    texts = [{(r.doc_id, r.text) for r in k.collect()} for k in kept[:-1]]
    assert texts[0] - texts[1] == {(9000, None), (9001, "?? 12")}
    ided = [(i, t) for i, t in texts[1] if i is not None]
    labels = brute_components(ided, 5, 80)
    assert {i for i, _ in texts[2]} == {i for i, (_, label) in labels.items() if i == label} | {None}
    assert kept[2].count() == len(texts[2])
    assert texts[2] - texts[3] == {(i, t) for i, t in texts[2] if any(b in t for b in benchmark)}
    assert {i for i, _ in texts[4]} == {i for i, _ in texts[3]} and not any("@mail" in t for _, t in texts[4])
    assert {r.doc_id for r in kept[5].select("doc_id").distinct().collect()} == {i for i, _ in texts[4]}
    empty = docs.where("false")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, SF).count() == 0


def test_pipeline_language_without_labels(spark):
    import corpus_pipeline

    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 4 == 2)
    for lang in (None, "en"):
        docs = spark.createDataFrame([(held, "the cat and the dog", lang), (200, "der Hund", None), (201, None, None), (202, "12 ?!", None)], DOCS + ", lang string")
        kept = corpus_pipeline.language(spark, docs, SF)
        assert kept.columns == docs.columns and {r.doc_id: r.lang for r in kept.collect()} == {held: lang, 200: lang}
