"""The Jaccard join and line dedup against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import common, jaccard, lines, setjoin
from tests.llm.conftest import edited, prose, shingles, words


def brute_components(rows):
    sets = {}
    for i, t in rows:
        sets.setdefault(shingles(t), []).append(i)
    classes = [s for s in sets if s]
    root = {s: s for s in classes}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for i, a in enumerate(classes):
        for b in classes[:i]:
            if 100 * len(a & b) >= 80 * len(a | b):
                root[find(a)] = find(b)
    least = {}
    for s in classes:
        least[find(s)] = min(least.get(find(s), 10**9), *sets[s])
    return sorted((i, len(shingles(t)), least[find(shingles(t))] if shingles(t) else i) for i, t in rows)


def result(df):
    return sorted(tuple(r) for r in df.collect())


#: Limits that are small enough for each path: lists in parts, long lists, lists of which only the nearest are told.
PATHS = [{}, {"SHORT": 2, "SKETCHED": 2, "NEAR": 1, "PART": 40}, {"SHORT": 2, "HOT": 2, "CELL": 50, "BUCKET": 20}, {"SHORT": 1, "SKETCHED": 100}]


def limited(monkeypatch, limits):
    """The limits hold in the workers too: functions are sent with the module's values."""
    for name, v in limits.items():
        monkeypatch.setattr(setjoin, name, v)


@pytest.mark.parametrize("limits", PATHS)
def test_components(documents, corpus, monkeypatch, limits):
    limited(monkeypatch, limits)
    assert result(jaccard.groups(documents).select("doc_id", "n_shingles", "component_id")) == brute_components(corpus)


def test_components_with_and_without_enumeration(documents, corpus, monkeypatch):
    want = brute_components(corpus)
    for light in (0, 6, 12):
        monkeypatch.setattr(jaccard, "boundary", lambda sizes, light=light: light)
        assert result(jaccard.groups(documents).select("doc_id", "n_shingles", "component_id")) == want


def test_boundary_follows_the_counts():
    by = lambda **n: [n.get(f"n{i}", 0) for i in range(64)]
    assert jaccard.boundary(by(n12=10**6)) < 12 and jaccard.boundary(by(n1=100, n2=100, n3=50)) >= 3 and jaccard.boundary([0] * 64) < 64


def test_empty_null_and_repeated(spark, nothing):
    assert jaccard.groups(nothing).collect() == []
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (7, None), (None, None), (9, "")]
    got = sorted(map(tuple, jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string")).drop("text_hash", "first").collect()), key=str)
    assert got == sorted([(None, 2, None), (5, 2, 5), (5, 2, 5), (7, 0, 7), (None, 0, None), (9, 0, 9)], key=str)


def test_long_chain_is_one_component(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i, i + 60))) for i in range(0, 90, 3)]
    got = result(jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string")).drop("text_hash", "first"))
    assert got == brute_components(rows) and {r[2] for r in got} == {0}


def test_components_of_edges(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (3, 4), (4, 1), (20, 20), (-5, 9)], "x long, y long")
    assert sorted(map(tuple, common.components(edges, "x", "y").collect())) == [(-5, -5), (1, 1), (2, 1), (3, 1), (4, 1), (8, -5), (9, -5)]


def brute_lines(rows):
    """doc_id: numbers of the lines that go. Lines are sets of words."""
    seen, gone = [], {}
    for i, t in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        for n, line in enumerate(t.split("\n")):
            s = shingles(line, 1)
            if s:
                if any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                    gone.setdefault(i, []).append(n)
                seen.append(s)
    return gone


@pytest.mark.parametrize("limits", PATHS)
def test_lines(documents, corpus, monkeypatch, limits):
    limited(monkeypatch, limits)
    gone = brute_lines(corpus)
    got = {r["doc_id"]: r for r in lines.dedup(documents).collect()}
    assert {i: list(r["removed_lines"]) for i, r in got.items() if r["removed_lines"]} == gone
    for i, t in corpus:
        want = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get(i, []))
        assert got[i]["text"] == want and got[i]["n_lines"] == (0 if t is None else t.count("\n") + 1) and got[i]["tok"] == "x"


def test_lines_of_nothing_and_of_null_ids(spark, nothing):
    assert lines.dedup(nothing).count() == 0
    df = spark.createDataFrame([(None, "a b c\nq"), (3, "a b c"), (3, "a b c")], "doc_id long, text string")
    assert sorted(((r["doc_id"], r["text"]) for r in lines.dedup(df).collect()), key=str) == sorted([(None, "q"), (3, "a b c"), (3, "a b c")], key=str)


def test_lines_of_different_texts_under_one_id(spark):
    near = [f"{x} " + " ".join(f"w{i}" for i in range(40)) for x in "ab"]
    rows = [(1, "a b c"), (None, "a b c\nclean one"), (None, "clean two\na b c"), (5, "other three\na b c"), (5, "a b c\nother four"), (7, "same line\nx"), (7, "same line\ny"), (9, near[0]), (9, near[1])]
    got = [(r["doc_id"], r["text"]) for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(t for i, t in got if i is None) == ["clean one", "clean two"] and sorted(t for i, t in got if i == 5) == ["other four", "other three"]
    assert sorted("\n".join(t for i, t in got if i == 7).split("\n")) == ["same line", "x", "y"]
    assert sorted(t in near for i, t in got if i == 9) == [False, True]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="abA \n\tÉ\x1c.", max_size=40)), max_size=12), st.integers(0, 3), st.sampled_from([1, 5]), st.sampled_from([1, 7, 1 << 17]))
def test_sets_of_slices(texts, offset, k, chunk):
    array = pa.array([None] * offset + texts, pa.string()).slice(offset)
    whole, common._CHUNK = common._CHUNK, chunk
    try:
        words_ = common.hashed_words(*common.raw(array))
    finally:
        common._CHUNK = whole
    assert np.diff(words_[0]).tolist() == [len(words(t)) for t in texts]
    bounds, flat = common.sets_of(*words_, k)
    keys = common.set_keys(bounds, flat)
    for i, t in enumerate(texts):
        s = flat[bounds[i] : bounds[i + 1]]
        assert len(s) == len(shingles(t, k)) and (np.diff(s.astype(object)) > 0).all()
        for j in range(i):
            assert (keys[i] == keys[j]) == (shingles(t, k) == shingles(texts[j], k))


def test_bytes_that_are_not_utf8(spark):
    df = spark.createDataFrame([(1, "same words in all of these"), (2, "same words in all of these"), (3, "other")], "doc_id long, text string")
    df = df.withColumn("text", F.concat(F.unhex(F.lit("ff80")).cast("string"), "text"))
    assert sorted(r["component_id"] for r in jaccard.groups(df).collect()) == [1, 1, 3]
    assert [(r["doc_id"], r["n_lines"], len(r["removed_lines"])) for r in lines.dedup(df).orderBy("doc_id").collect()] == [(1, 1, 0), (2, 1, 1), (3, 1, 0)]


def test_very_long_texts(spark):
    rng = random.Random(5)
    long = prose(rng, 60_000, 10**6)
    rows = [(1, long), (2, edited(rng, long, 0.001)), (3, prose(rng, 50_000, 10**6)), (4, "\n".join(["x", long])), (5, "w" * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["component_id"] for r in jaccard.groups(df).orderBy("doc_id").collect()] == [1, 1, 3, 1, 5]
    assert {r["doc_id"]: list(r["removed_lines"]) for r in lines.dedup(df).collect()} == {1: [], 2: [0], 3: [], 4: [1], 5: []}


def test_different_texts_under_one_id_are_joined_apart(spark):
    a, b = "a b c d e f g h i j", "k l m n o p q r s t"
    df = spark.createDataFrame([(1, a), (1, b), (2, b), (None, a), (None, "u v w x y z")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["component_id"] or 0, r["first"]) for r in jaccard.groups(df).collect())
    assert got == [("1", 1, True), ("1", 1, True), ("2", 1, False), ("None", 0, False), ("None", 0, True)]


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 2**48 - 1), min_size=1, max_size=300), st.sets(st.integers(0, 2**48 - 1), max_size=60), st.data())
def test_sketches_never_rule_out_too_much(a, extra, data):
    b = set(data.draw(st.lists(st.sampled_from(sorted(a)), min_size=1))) | extra
    n = np.array([len(a), len(b)])
    flat = np.concatenate([np.sort(np.array(list(s), np.uint64)) for s in (a, b)])
    width = setjoin.widths(n)
    sketch = setjoin.sketches(np.append(0, np.cumsum(n)), flat, width)
    assert setjoin._apart(sketch, np.cumsum(width) - width, width, np.array([0]), np.array([1]))[0] <= len(a ^ b)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(-(2**62), 2**62), max_size=50))
def test_blocks_of_numbers(x):
    x = np.array(x, dtype=np.int64)
    if not len(x) or int(x.max()) - int(x.min()) < 2**63:
        assert common.opened(common.squeezed(x)).tolist() == x.tolist()


def test_attach_spreads_heavy_keys(spark):
    rows = spark.createDataFrame([(0, i) for i in range(50)] + [(i, i) for i in range(1, 20)], "k int, v int")
    table = rows.groupBy("k").agg(F.count("*").alias("n")).filter("k < 10").withColumn("name", F.concat(F.lit("n"), "k"))
    for how, n in (("left", 69), ("inner", 59)):
        got = common.attach(rows, table, "k", "n", 69, how).select("k", "v", "name").collect()
        assert len(got) == n and all(r["name"] == (f"n{r['k']}" if r["k"] < 10 else None) for r in got)


def test_long_rows_go_to_python_by_bounded_bytes(spark):
    long = spark.range(0, 24, 1, 1).select("id", F.repeat(F.lit("x"), 1 << 20).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": pa.array([b.num_rows], pa.int64())})

    def grouped(table):
        return pa.table({"rows": pa.array([len(c) for c in table.column("text").chunks], pa.int64())})

    for df in (long.mapInArrow(sizes, "rows long"), long.groupBy(F.col("id") % 1).applyInArrow(grouped, "rows long")):
        got = [r["rows"] for r in common.stored(df, "sizes").collect()]
        assert sum(got) == 24 and max(got) << 20 <= common.ARROW_BYTES + (1 << 20)


def test_stored_tables_leave_no_shuffle_files(spark):
    import time

    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {n for f in blocks.getAllFiles().mkString("\n").split("\n") if (n := f.rpartition("/")[2]).startswith("shuffle_")}
    before = shuffles()
    table = common.stored(spark.range(1000).groupBy(F.col("id") % 7).count(), "counts")
    for _ in range(50):
        if not (left := shuffles() - before):
            break
        time.sleep(0.1)
    assert not left and table.count() == 7


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([3, 5, 2**40, 2**62 + 1]), st.integers(1, 5), st.integers(-(2**63), 2**63 - 1)), max_size=40))
def test_lists_are_ordered_and_without_lone_members(rows):
    tok, n, key = (np.array([r[i] for r in rows], np.int64) for i in range(3))
    at = setjoin._by_list(tok, n, key)
    got = [(rows[i][0], rows[i][1]) for i in at.tolist()]
    toks = [r[0] for r in rows]
    assert got == sorted((t, m) for t, m, _ in rows if toks.count(t) > 1 or t >> 62)
    assert len(set(at.tolist())) == len(at)


def test_one_pass_counts_and_makes_units(documents):
    docs = documents.select("doc_id", "text", F.xxhash64("text").alias("src"))
    ranks, _, places = setjoin.order(docs, 1)
    units, own, own_places = setjoin.counted_units(docs, lines=True, k=1)
    plain, _ = setjoin.units(docs, lines=True, k=1)
    assert own_places == places and (own == ranks).all()
    assert sorted(map(str, units.collect())) == sorted(map(str, plain.collect()))
    texts = pa.array(["a b c d e f g a", "h i j", ""])
    bare, ranked = (common.sets_of(*common.hashed_words(*common.raw(texts)), 1, r) for r in (None, np.arange(1 << 22, dtype=np.uint8) % 64))
    assert (common.set_keys(*bare) == common.set_keys(*ranked)).all()
