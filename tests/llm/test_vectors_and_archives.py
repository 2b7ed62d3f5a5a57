"""Nearest neighbours and WARC archives."""

import hashlib
import io
import random
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import ann, queries, warc


def exact(rows, k, every):
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for a, (i, v) in enumerate(rows):
        if i % every == 0:
            s = (x * np.array(v, dtype=np.float64)).sum(axis=1)
            out[i] = [(ids[j], s[j]) for j in sorted(range(len(ids)), key=lambda j: (-s[j], ids[j])) if j != a][:k]
    return out


@pytest.mark.parametrize(("parts", "kind"), [((4096, 16_384, 4 << 20), "float"), ((10, 30, 2 * 8 * 16), "double")])
def test_recall(spark, monkeypatch, parts, kind):
    for name, v in zip(("BLOCK_ROWS", "GROUP_ROWS", "QUERY_BYTES"), parts, strict=True):
        monkeypatch.setattr(ann, name, v)
    monkeypatch.setattr(ann, "LEAF_ROWS", 25)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] * (1 + i % 3) + 0.3 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)]  # a hot vector
    odd = [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [float("inf")] + [0.0] * 15), (2080, [None] + [1.0] * 15), (2100, [1.0] * 3), (None, [1.0] * 16), (0, rows[0][1])]
    df = spark.createDataFrame([(i, v, 5) for i, v in rows + odd], f"vec_id long, embedding array<{kind}>, leaf int").repartition(3)
    got = {}
    for r in ann.search(df).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    want = exact(rows, 20, 20)
    assert set(got) == set(want)
    hits = 0
    for q, best in want.items():
        assert sorted(got[q]) == list(range(1, 21))
        mine = [got[q][i] for i in range(1, 21)]
        assert mine == sorted(mine, key=lambda x: (-x[1], x[0])) and q not in [i for i, _ in mine]
        hits += len({i for i, _ in mine} & {i for i, _ in best})
    assert hits / (20 * len(want)) >= 0.9


def test_few_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert ann.search(spark.createDataFrame([], schema)).count() == 0
    assert ann.search(spark.createDataFrame([(20, [1.0, 2.0])], schema)).count() == 0
    got = ann.search(spark.createDataFrame([(20, [1.0, 2.0]), (21, [1.0, 0.0]), (22, [1.0, 0.0]), (23, [-1.0, 0.0])], schema)).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(21, 1.0), (22, 1.0), (23, -1.0)]


def test_recall_on_the_test_data(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = {(q, i) for q, best in exact(rows, 20, 20).items() for i, _ in best}
    got = {(r["query_id"], r["vec_id"]) for r in queries.op4_ann(spark, sf_dir).collect()}
    assert len(got & want) / len(want) >= 0.9


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text(alphabet="abc/é.", min_size=1, max_size=8), st.lists(st.binary(max_size=50), max_size=4), max_size=5), st.booleans())
def test_zip_packages(members, zip64):
    raw = b"".join(warc.zip_parts(list(members.items()), zip64))
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert {n: z.read(n) for n in z.namelist()} == {n: b"".join(b) for n, b in members.items()}
    found = warc.zip_members(lambda at, n: raw[at : at + n], len(raw))
    assert {n: raw[a : a + size] for n, (a, size) in found.items()} == {n: b"".join(b) for n, b in members.items()}


def test_zip_of_others():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.comment = b"PK\x05\x06 not an end"[4:]
        z.writestr("deflated", b"x" * 1000, zipfile.ZIP_DEFLATED)
        with z.open("big", "w", force_zip64=True) as f:
            f.write(b"stored")
        z.writestr("d/", b"")
    raw = out.getvalue()
    found = warc.zip_members(lambda at, n: raw[at : at + n], len(raw))
    assert "deflated" not in found and raw[found["big"][0] :][: found["big"][1]] == b"stored"
    with pytest.raises(ValueError):
        warc.zip_members(lambda at, n: b"nothing"[at : at + n], 7)


def brute_archive(rows):
    last = {}
    for i, _, h in rows:
        p = (h or "").encode()
        if len(p) >= 1000 and i is not None:
            last[p] = max(last.get(p, i), i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        to = last.get(p)
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "response" if to is None or to == i else "revisit", None if to == i else to))
    return sorted(out, key=str)


@pytest.mark.parametrize("package", [48 << 20, 3000])
def test_archive(spark, package):
    rng = random.Random(1)
    page = lambda n: "".join(rng.choice("<p>é\r\n w") for _ in range(n))
    rows = [(i, f"http://x.example/{i}", page(rng.randrange(3000))) for i in range(40)]
    rows += [(100 + i, "http://y/ü a\r\nX: 1", rows[5][2] + "z" * 1000) for i in range(5)] + [(200 + i, None, "short") for i in range(3)]
    rows += [(300, "u", None), (301, "u", ""), (None, "u", "n" * 1200), (None, None, rows[5][2] + "z" * 1000), (104, "again", rows[5][2] + "z" * 1000), (302, "u", "z" * 999), (303, "u", "z" * 999), (304, "u", "WARC/1.0\r\n\r\n" * 100)]
    df = spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    out = warc.archive(df, package=package, run=2000)
    assert sorted((tuple(r) for r in out.drop("url", "payload").collect()), key=str) == brute_archive(rows)
    payloads = {r["page_id"]: bytes(r["payload"]) for r in out.filter("record_type = 'response' and page_id is not null").collect()}
    html = {i: (h or "").encode() for i, _, h in rows if i is not None}
    assert all(html[i] == p for i, p in payloads.items())
    assert warc.archive(df.limit(0)).count() == 0


def test_query_oracle(spark, sf_dir, same):
    same(queries.op9_warc(spark, sf_dir), queries.ORACLE["op9_warc"])


@pytest.mark.parametrize("name", ["op1_decontaminate", "op5_ngram_jaccard", "op8_line_dedup"])
def test_oracles(name, spark, sf_dir, same):
    same(queries.QUERIES[name](spark, sf_dir), queries.ORACLE[name])
