"""Language ID, language-model scores, packing, sharding, substring dedup."""

import collections
import functools
import math
import random
import struct
import tracemalloc
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import langid, lm, packing, sharding, substring
from tests.llm.conftest import prose, words

# --- language ID


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    held = [(r["lang"], got[r["doc_id"]]["lang_pred"]) for r in docs.filter("lang is not null").collect() if got[r["doc_id"]]["held_out"]]
    assert len(held) > 30 and sum(a == b for a, b in held) / len(held) > 0.9
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got) and all(0 <= r["score"] <= 1 for r in got.values())


def test_languages_of_odd_texts(spark, nothing):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(v) for _ in range(20)), lang) for i in range(60) for lang, v in [("en", ["the", "and", "with"]), ("de", ["der", "und", "mit"]), ("fr", ["le", "et", "avec"])][i % 3 : i % 3 + 1]]
    odd = [(100, None, "en"), (101, "", None), (102, "12 34 ...", "de"), (103, "the and", None), (None, "der und mit", "de"), (104, "le et " * 400_000, "fr")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(df).collect()}
    assert got[100] == got[101] == got[102] == ("und", 0.0) and got[103][0] == "en" and got[None][0] == "de" and got[104][0] == "fr"
    assert langid.identify(nothing).count() == 0
    unlabelled = langid.identify(spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")).first()
    assert (unlabelled["lang_pred"], unlabelled["score"]) == ("und", 0.0)


def test_features_of_pieces(monkeypatch):
    text = "Ça et là, words 12 and more words. " * 40
    whole = langid.features([text, "b"])
    monkeypatch.setattr(langid, "PIECE", 100)
    pieces = langid.features([text, "b"])
    assert np.abs(whole - pieces).max() < 0.02 and abs(float((whole[0] ** 2).sum()) - 1) < 1e-5


def test_families_part_before_languages():
    assert langid.family("en") == langid.family("de") == "germanic" and langid.family("fr") == langid.family("es") == "romance" and langid.family("xx") == "xx"
    model = langid.fit(np.eye(langid.DIM, dtype=np.float32)[:8], ["en", "de", "fr", "es"] * 2)
    assert ("family", "germanic", "romance") in model["pairs"] and ("lang", "de", "en") in model["pairs"] and ("lang", "en", "fr") not in model["pairs"]


# --- language model


def brute_katz(rows):
    tok = [(i, [*words(t), 0]) for i, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in tok]
    uni, bi, n = collections.Counter(), collections.Counter(), 0
    for (_, t), h in zip(tok, held):
        if not h:
            uni.update(t)
            bi.update(zip([1, *t[:-1]], t))
            n += 1
    total, v = sum(uni.values()), len(uni)
    cc = collections.Counter(bi.values())
    d = lm.discounts([cc[r] for r in range(1, lm.K + 2)])
    dis = lambda c: d[c] if c <= lm.K else 1.0
    share = lambda w: (uni[w] + 0.1) / (total + 0.1 * (v + 1))
    after = collections.defaultdict(list)
    for (h, w), c in bi.items():
        after[h].append((w, c))

    def prob(h, w):
        c = n if h == 1 else uni[h]
        if not c:
            return share(w)
        used = sum(dis(x) * x / c for _, x in after[h])
        scale = c / (c + 1) if used > 1 - 1e-9 else 1.0
        if bi[h, w]:
            return scale * dis(bi[h, w]) * bi[h, w] / c
        return (1 - scale * used) / (1 - sum(share(x) for x, _ in after[h])) * share(w)

    for h in [1, *list(uni)[:5], "never"]:  # the probabilities after a history, and of an unknown word, sum to 1
        assert sum(prob(h, w) for w in uni) + prob(h, "never seen") == pytest.approx(1)
    return [(i, hd, len(t), sum(uni[w] > 0 for w in t), total, sum(math.log10(share(w)) for w in t), sum(math.log10(prob(h, w)) for h, w in zip([1, *t[:-1]], t))) for (i, t), hd in zip(tok, held)]


@pytest.mark.parametrize("cell,bucket", [(7 << 20, 700_000), (6000, 30)])
def test_scores(spark, corpus, cell, bucket):
    rows = [*corpus, (None, "one two"), (100, "again the same id")]
    got = sorted((tuple(r) for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), cell_bytes=cell, bucket=bucket).collect()), key=lambda r: (str(r[0]), r[2], r[5]))
    want = sorted(brute_katz(rows), key=lambda r: (str(r[0]), r[2], r[5]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)


def test_scores_without_training(spark, nothing):
    assert lm.score(nothing).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = lm.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == pytest.approx(0) and r["score"] == pytest.approx(0)


def test_discounts():
    d = lm.discounts([100, 40, 20, 12, 8, 6])
    assert all(0 < x < 1 for x in d[1:]) and (lm.discounts([0] * 6)[1:] > 0).all()


# --- packing


def test_packing_round_trip(spark, corpus):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    odd = ["Hello, wörld. 's I'll 3.14,x ... ,. a. b, É. É, 'S don't", "K. ́x", "H̱. x", "ΑΣ. Σ", "x.,  y. ", "İ. ǅ, ß.", "end.", "<|endoftext|>. A", "a" * 300 + ". " + "b" * 200]
    rows = [*corpus, *enumerate(odd, 9000), (9100, prose(random.Random(5), 9000))]
    pieces = packing.pack_documents(spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, start int").repartition(4)).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_seq[p["sequence_id"]].append(p)
    assert set(by_doc) == {i for i, _ in rows}
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p["start"]):
            part = ids[at : at + p["length"]]
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += p["length"]
        assert at == len(ids)
    sizes = []
    for seq in by_seq.values():
        at = 0
        for p in sorted(seq, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        sizes.append(at)
    assert max(sizes) <= 4096 and sum(s < 4096 for s in sizes) <= 1


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 5), max_size=8), st.integers(0, 60))
def test_fill_comes_closest(counts, room):
    got = dict(packing.fill(counts, sorted(counts, reverse=True), room))
    reach = {0}
    for n, c in counts.items():
        reach = {r + n * j for r in reach for j in range(c + 1)}
    assert all(0 < c <= counts[n] for n, c in got.items()) and sum(n * c for n, c in got.items()) == max(r for r in reach if r <= room)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_pack_keeps_every_item(sizes):
    items = [(i, 0, n, 0, n) for i, n in enumerate(sizes)]
    packed = list(packing.pack(items, 30))
    assert sorted(x for s in packed for x in s) == items and all(0 < sum(x[2] for x in s) <= 30 for s in packed)


UNITS = [*"abcABZz09'’.,;<|> \t\n\r\x0b\x0c\x00\x7f×÷éÉßçª²½“…\u0338\u0331\u0301İıǅΣσς가ᄀ日①٣क\u093c\u0958\u200d😀^_-/\x85", "'s", "'re", "'LL", "<|endoftext|>", "word"]


@functools.cache
def _chunks():
    return packing.Chunks(packing.tokenizer_path())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(UNITS), max_size=14).map("".join), max_size=8))
def test_ids_are_those_of_the_tokenizer(texts):
    chunks = _chunks()
    want = [chunks.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert chunks.ids(texts) == [struct.pack(f"<{len(ids)}I", *ids) for ids in want]


def test_a_worker_remembers_few_units():
    rng = random.Random(3)
    chunks, most = packing.Chunks(packing.tokenizer_path()), 0
    tracemalloc.start()
    for _ in range(25):
        chunks.ids([" ".join("".join(rng.choices("abcdefghij", k=12)) for _ in range(20_000))])
        most = max(most, tracemalloc.get_traced_memory()[0])
    tracemalloc.stop()
    assert most < 50e6


def test_packing_nothing(nothing):
    assert packing.pack_documents(nothing).count() == 0


# --- sharding


def test_shards(spark, corpus):
    rows = [*corpus, (None, "x"), (100, "repeated id")] + [(7000 + i, "copy") for i in range(200)]
    got = sharding.shard(spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, shard string").repartition(3)).collect()
    assert len(got) == len(rows) and {r["law"] for r in got} == {"bytes"} and all(r["grown_shard"] is None for r in got)
    text = {i: t for i, t in rows if i not in (None, 100)}
    of_text = collections.defaultdict(set)
    for r in got:
        if r["doc_id"] in text:
            raw = (text[r["doc_id"]] or "").encode()
            assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw)
            of_text[raw].add(r["shard"])
    assert all(len(s) == 1 for s in of_text.values())
    total = collections.Counter()
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    for r in got:
        total[r["shard"]] += r["size"]
    assert max(total.values()) - min(total.values()) <= 40


def test_slots_of_one_row_many_times(spark):
    rows = [(None, "the same")] * 300 + [(7, "another")] * 200 + [(i, f"text {i}") for i in range(100)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == 600 and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert len({r["shard"] for r in got if r["doc_id"] is None}) == len({(r["shard"]) for r in got if r["doc_id"] == 7 and r["size"] == 8}) == 1


def test_shards_in_cells(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_GROUPS", 20)
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randrange(1, 60))) for i in range(300)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    total = collections.Counter()
    for r in got:
        total[r["shard"]] += r["size"]
    assert len(got) == 300 and max(total.values()) - min(total.values()) < 0.01 * sum(total.values())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1000), max_size=40), st.integers(2, 5))
def test_differencing_is_a_partition(sizes, k):
    to = sharding.difference([[s] + [0] * (k - 1) for s in sizes], k)
    sums = [0] * k
    for s, places in zip(sizes, to, strict=True):
        assert sorted(places) == list(range(k))
        sums[places[0]] += s
    assert sum(sums) == sum(sizes) and (not sizes or max(sums) - min(sums) <= max(sizes))


def test_no_shards_of_nothing(nothing):
    assert sharding.shard(nothing).count() == 0


# --- substring dedup


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=30), st.integers(1, 5))
def test_compact_windows_hold_each_subsequence_once(a, shortest):
    a = np.array(a, dtype=np.uint64)
    windows = substring.compact_windows(a, shortest)
    for i in range(len(a)):
        for k in range(i + shortest - 1, len(a)):
            held = [(l, c, r) for l, c, r in windows if l <= i <= c <= k <= r]
            assert len(held) == 1 and a[held[0][1]] == a[i : k + 1].min()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 9), max_size=60), st.integers(1, 5))
def test_compact_windows_of_long_texts_are_those_of_the_tree(a, shortest):
    a = np.array(a, dtype=np.uint64)
    assert sorted(map(tuple, substring.compact_windows(a, shortest, 0).tolist())) == sorted(map(tuple, substring.compact_windows(a, shortest).tolist()))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 30), st.integers(0, 12), st.integers(0, 50), st.integers(0, 9), st.integers(-1, 2)), max_size=25))
def test_agreed_intervals_place_by_place(windows):
    rows = [(p, l, l + n, o, o + m, h) for p, l, n, o, m, h in windows]
    want = []
    for p in range(3):
        mine = [r for r in rows if r[0] == p]
        held = [len({r[5] for r in mine if r[1] <= i <= r[2]}) >= 2 for i in range(45)]
        begins = [i for i in range(45) if held[i] and not (i and held[i - 1])]
        for b in begins:
            e = next(i for i in range(b, 45) if not held[i]) - 1
            over = [r for r in mine if r[1] <= e and r[2] >= b]
            if e - b + 1 >= 4:
                want.append((p, b, e, min(r[3] for r in over), max(r[4] for r in over)))
    got = substring.agreed(*np.array(rows, dtype=np.int64).reshape(-1, 6).T, 4, 2)
    assert sorted(zip(*(x.tolist() for x in got), strict=True)) == sorted(want)


def test_repeated_passages(spark, nothing):
    rng = random.Random(9)
    shared, other = prose(rng, 60), prose(rng, 55)
    near = shared.split(" ")
    near[30] = "changed"
    rows = [(i, prose(rng, 200)) for i in range(20)]
    rows += [(100 + i, f"{prose(rng, 40 + i)} {shared} {prose(rng, 30)}") for i in range(5)] + [(200, f"{prose(rng, 70)} {' '.join(near)} {prose(rng, 70)}")]
    rows += [(300, other), (301, f"{prose(rng, 10)} {other}"), (302, other[: len(other) // 2]), (303, None), (304, ""), (None, shared), (305, f"{other} {prose(rng, 20)} {shared}")]
    got = {r["doc_id"]: r for r in substring.repeated(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, doc int").repartition(4)).collect()}
    assert len(got) == len(rows)
    clean = [*range(20), 302, 303, 304, None]
    assert not any(got[i]["repeated"] for i in clean) and all(got[i]["n_repeated"] == 0 for i in clean)
    assert all(got[i]["repeated"] and 60 <= got[i]["n_repeated"] <= 64 for i in range(100, 105)) and got[200]["repeated"]
    assert got[300]["n_repeated"] == 55 and got[301]["n_repeated"] == 55 and got[305]["n_passages"] == 2 and got[303]["n_words"] == 0
    assert substring.repeated(nothing).count() == 0


def test_substring_of_the_corpus_finds_every_long_exact_repeat(documents, corpus):
    got = {r["doc_id"]: r["n_repeated"] for r in substring.repeated(documents).collect()}
    where = collections.defaultdict(set)
    for i, t in corpus:
        w = words(t)
        for s in range(len(w) - 49):
            where[tuple(w[s : s + 50])].add(i)
    for ids in where.values():
        if len(ids) > 1:
            assert all(got[i] >= 50 for i in ids)


def test_passages_around_a_line_that_their_documents_repeat(spark):
    # The passage begins or ends with a line that both documents hold at other places too.
    rng = random.Random(5)
    rows = []
    for i in range(0, 60, 2):
        line, rest = prose(rng, 25, 9000), prose(rng, 28, 9000)
        shared = f"{line} {rest}" if i % 4 else f"{rest} {line}"
        rows += [(i + k, " ".join([prose(rng, 30, 9000), line, prose(rng, 60, 9000), line, prose(rng, 60, 9000), shared, prose(rng, 60, 9000), line, prose(rng, 60, 9000)])) for k in (0, 1)]
    got = {r["doc_id"]: r["n_repeated"] for r in substring.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i, _ in rows if got[i] < 53] == []


def test_passages_that_hold_a_line_of_many_earlier_documents(spark):
    rng = random.Random(6)
    rows = []
    for i in range(0, 4000, 100):
        line = prose(rng, 38, 9000)
        rows += [(i + k, f"{prose(rng, 80, 9000)} {line} {prose(rng, 80, 9000)}") for k in range(12)]
        shared = f"{prose(rng, 8, 9000)} {line} {prose(rng, 8, 9000)}"
        rows += [(i + k, f"{prose(rng, 80, 9000)} {shared} {prose(rng, 80, 9000)}") for k in (50, 51)]
    got = {r["doc_id"]: r["n_repeated"] for r in substring.repeated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert [i for i, _ in rows if i % 100 >= 50 and got[i] < 54] == [] and not any(got[i] for i, _ in rows if i % 100 < 50)


def test_only_the_words_of_spans_go_on():
    texts = [" a b\tc d e f g ", None, "h i", "é j k l m n o p".encode()[:-1] + b"\xff", "q r s t u v"]
    spans = [[[1, 2, 0, 0], [0, 0, 5, 5]], [[0, 3, 0, 0]], [[0, 0, 1, 1], [4, 9, 0, 0]], [[0, 9, 0, 0]], []]
    column = pa.array([t.encode() if isinstance(t, str) else t for t in texts], pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(range(5)), pa.array(spans, pa.list_(pa.list_(pa.int32()))), column], names=["doc", "other", "spans", "text"])
    (got,) = substring._cut([batch.slice(0, 5)])
    assert got.column(3).to_pylist() == [[b"b\tc d e f g", b"a b\tc d e"], [b""], [b"h i", b""], [texts[3]], []] and got.column(2).to_pylist() == spans


def test_packing_of_letters_that_are_composed(spark):
    from quillon.llm.packing import Chunks, tokenizer_path

    chunks = Chunks(tokenizer_path())
    odd = [c for c in map(chr, range(0x80, 0x30000)) if not 0xD800 <= ord(c) < 0xE000 and unicodedata.normalize("NFC", c) != c]
    texts = [t for c in odd for t in (c, f"{c}.", f"a{c}b", f"word a{c} {c}. x")]
    assert len(odd) > 59 and "\u0958" in odd
    want = [chunks.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert chunks.ids(texts) == [b"".join(i.to_bytes(4, "little") for i in ids) for ids in want]


def test_texts_that_are_not_utf8(spark):
    rows = [(i, f"some words of a text {i}", "en" if i % 2 else "de") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("text", F.concat(F.unhex(F.lit("ff80")).cast("string"), "text"))
    assert {r["lang_pred"] for r in langid.identify(df).collect()} <= {"en", "de"}
    assert packing.pack_documents(df).select("doc_id").distinct().count() == 12
    assert lm.score(df).count() == 12 and substring.repeated(df).count() == 12


def test_language_beside_columns_of_the_same_names(spark):
    df = spark.createDataFrame([(1, "one text", "en", 0.5, "x")], "doc_id long, text string, lang string, score double, lang_pred string")
    assert langid.identify(df).columns == ["doc_id", "held_out", "lang_pred", "score"]
    with pytest.raises(ValueError, match="already"):
        langid.with_language(df, F.lit(True))
    assert langid.with_language(df, F.lit(True), new=("l", "s")).select("score", "lang_pred").first() == (0.5, "x")


def test_tokenizing_takes_little_memory():
    rng = random.Random(3)
    vocabulary = prose(rng, 2000, 10**5).split(" ")
    texts = pa.array([" ".join(rng.choice(vocabulary) for _ in range(300)) for _ in range(3000)], pa.string())
    chunks = packing.Chunks(packing.tokenizer_path())
    before = sum(len(ids) for part in chunks.streams(texts) for ids in part)  # and units are remembered
    tracemalloc.start()
    try:
        assert sum(len(ids) for part in chunks.streams(texts) for ids in part) == before
        assert tracemalloc.get_traced_memory()[1] < 80e6  # slices of twice the size with all arrays kept took 138 MB
    finally:
        tracemalloc.stop()
