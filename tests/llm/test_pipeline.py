"""The pipeline on a small fixture, and stage by stage against brute force."""

import random

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import LETTERS, edited, prose, shingles, words
from tests.llm.test_joins import brute_components, brute_lines


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    item = prose(rng, 30)
    base = [prose(rng, 60) for _ in range(20)]
    texts = base + base[:5] + [edited(rng, t, 0.01) for t in base[5:10]] + [f"{prose(rng, 20)} {item} {prose(rng, 20)}", None, "", "123 456 ...", "short words"]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(pipeline.STAGES):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        stage(spark, docs, folder).write.parquet(out := str(tmp_path / str(k)))
        after = spark.read.parquet(out)
        if name == "language ID":
            assert ids(after) == sorted(i for i, t in rows if t and any(map(str.isalpha, t))) and after.filter("lang is null").count() == 0
        elif name == "line dedup":
            gone = brute_lines(rows)
            want = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get(i, [])) for i, t in rows}
            assert {r["doc_id"]: r["text"] for r in after.collect()} == {i: t for i, t in want.items() if i not in gone or words(t)}
            assert all(r["n_chars"] == len(r["text"]) for r in after.collect())
        elif name == "n-gram Jaccard join":
            assert ids(after) == sorted(i for i, _, c in brute_components(rows) if i == c)
        elif name == "benchmark decontamination":
            w = words(spark.read.parquet(f"{folder}/benchmark.parquet").first()["text"], LETTERS)
            bad = {tuple(w[s : s + 10]) for s in range(len(w) - 9)}
            clean = [i for i, t in rows for v in [words(t, LETTERS)] if not any(tuple(v[s : s + 10]) in bad for s in range(len(v) - 9))]
            assert ids(after) == sorted(clean) and len(clean) < len(rows)
        else:
            assert sorted({r["doc_id"] for r in after.collect()}) == sorted(i for i, _ in rows)
        if k < len(pipeline.STAGES) - 1:
            assert after.columns == columns
        docs = after
    assert sorted(map(tuple, pipeline.run(spark, folder).select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(map(tuple, docs.select("doc_id", "start", "length", "ids_crc32").collect()))


def test_one_row_of_repeated_ids_stays(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None), (3, None), (None, "q r"), (4, "")], "doc_id long, text string")
    got = pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(map(str, (r["doc_id"] for r in got))) == ["1", "3", "4", "None"]


def test_empty_table_runs(spark, folder, tmp_path):
    path = str(tmp_path / "sf")
    spark.read.parquet(f"{folder}/documents.parquet").filter(F.lit(False)).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{path}/benchmark.parquet")
    assert pipeline.run(spark, path).count() == 0


def test_shingles_helper():
    assert len(shingles("a b c d e f")) == 2


def test_other_columns_stay_whatever_their_names(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = ("score", "lang_pred", "n_lines", "removed_lines", "_id", "_hash", "_doc", "_src", "key", "first")
    docs = docs.withColumns({c: F.concat(F.lit(c), "doc_id") for c in names})
    for _, stage in pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).toArrow())
        assert all(r[c] == f"{c}{r['doc_id']}" for r in docs.collect() for c in names)
    assert docs.count() > 10


def test_null_ids_and_texts_under_one_id_are_documents(spark):
    a, b = "a b c d e f g", "h i j k l m n"
    docs = spark.createDataFrame([(None, a), (None, a), (None, b), (1, b), (1, "o p q r s t"), (2, "o p q r s t")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["text"]) for r in pipeline.near_duplicates(spark, docs, "").collect())
    assert got == [("1", b), ("1", "o p q r s t"), ("None", a)]
