import hashlib
import random

import pytest

from quillon.llm import decontaminate
from tests.llm.conftest import LETTERS, prose, words


def brute(docs, items, span=10):
    wins = {}
    for i, t in items:
        w = words(t, LETTERS)
        n = min(span, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            wins.setdefault(tuple(w[s : s + n]), set()).add("null" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t, LETTERS), set(), set()
        for n in {len(k) for k in wins}:
            for s in range(len(w) - n + 1):
                if ids := wins.get(tuple(w[s : s + n])):
                    hit.update(range(s, s + n))
                    found |= ids
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def benchmark_rows():
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randrange(10, 40))) for i in range(20)] + [(100 + n, prose(rng, n)) for n in range(1, 10)]
    return rows + [(50, rows[3][1]), (3, rows[4][1]), (None, prose(rng, 12)), (60, None), (61, "..!"), (62, "la " * 30)]


@pytest.fixture(scope="module")
def suspects(benchmark_rows):
    rng = random.Random(4)
    docs = [(i, prose(rng, rng.randrange(1, 80))) for i in range(40)]
    for i, (_, t) in enumerate(benchmark_rows):
        w = (t or "").split()
        for n in (9, 10, 11, len(w)):
            at = rng.randrange(max(1, len(w) - n + 1))
            docs.append((1000 + 10 * i + n, f"{prose(rng, 7)}. {' -- '.join(w[at : at + n]).upper()}! {prose(rng, 5)}"))
    return docs + [(5000, None), (5001, ""), (5002, "?"), (5003, "la " * 9), (5004, "la " * 200), (7, docs[7][1]), (None, docs[-1][1])]


def rows(df):
    return sorted((tuple(r)[:6] for r in df.collect()), key=str)


@pytest.mark.parametrize("block", [200_000, 40])
def test_against_brute_force(spark, benchmark_rows, suspects, block):
    docs = spark.createDataFrame([(i, t, 1) for i, t in suspects], "doc_id long, text string, items int").repartition(3)
    bench = spark.createDataFrame([(i, t, "x") for i, t in benchmark_rows], "item_id long, text string, words string")
    assert rows(decontaminate.contamination(docs, bench, block_windows=block)) == brute(suspects, benchmark_rows)


def test_empty_tables(spark, suspects, benchmark_rows):
    docs, bench = spark.createDataFrame(suspects[:50], "doc_id long, text string"), spark.createDataFrame(benchmark_rows, "item_id long, text string")
    assert rows(decontaminate.contamination(docs, bench.limit(0))) == brute(suspects[:50], [])
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


def test_no_python_in_the_plan(spark, suspects, benchmark_rows):
    docs, bench = spark.createDataFrame(suspects, "doc_id long, text string"), spark.createDataFrame(benchmark_rows, "item_id long, text string")
    plan = decontaminate.contamination(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "MapInArrow", "CartesianProduct", "BroadcastNestedLoopJoin"))
