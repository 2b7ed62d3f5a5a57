import math
import random

import pytest
from pyspark.sql import functions as F

from quillon import operators as O
from quillon.functions import ema, ema_depth, rolling_std, sma, with_ema


def ticks(spark, n):
    return spark.createDataFrame([(i, 100 + 5 * math.sin(i / 10), 0) for i in range(n)], "ts long, price double, symbol int")


@pytest.mark.parametrize("stretch", [7, 30, 100_000])
def test_rolling_equals_the_recurrence(spark, stretch):
    df = ticks(spark, 300).repartition(5)
    got = {r["ts"]: r for r in O.rolling(df, "ts", [("SMA", "price", 20, "a"), ("EMA", "price", 3, "e"), ("ROLLING_STD", "price", 10, "s")], stretch=stretch).collect()}
    xs, e = [100 + 5 * math.sin(i / 10) for i in range(300)], None
    assert len(got) == 300
    for i, x in enumerate(xs):
        e = x if e is None else 0.5 * x + 0.5 * e
        past, ten = xs[max(0, i - 19) : i + 1], xs[max(0, i - 9) : i + 1]
        mean = sum(ten) / len(ten)
        assert got[i]["a"] == pytest.approx(sum(past) / len(past), rel=1e-12) and got[i]["e"] == pytest.approx(e, rel=1e-12)
        assert got[i]["s"] == pytest.approx(math.sqrt(sum((v - mean) ** 2 for v in ten) / len(ten)), abs=1e-9)


def test_flat_series(spark):
    df = spark.createDataFrame([(i, 100.0) for i in range(200)], "ts long, price double")
    out = df.select(ema(F.col("price"), 5, F.col("ts")).alias("e"), rolling_std(F.col("price"), 10, F.col("ts")).alias("s"), sma(F.col("price"), 1, F.col("ts")).alias("a")).collect()
    assert {r["e"] for r in out} == {100.0} and max(r["s"] for r in out) <= 1e-9 and {r["a"] for r in out} == {100.0}
    assert ema_depth(1) == 0 and ema_depth(20) == 392


def test_numbered_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(i // 3 if i % 10 else None, i) for i in range(100)], "a int, b int").repartition(4)
    rows = O.windows.numbered(df, "a", "rn", "b").orderBy("rn").collect()
    assert [r["rn"] for r in rows] == list(range(100))
    assert [(r["a"] is not None, r["a"], r["b"]) for r in rows] == sorted((r["a"] is not None, r["a"], r["b"]) for r in rows)


def brute_asof(left, right, tolerance):
    out = []
    for k, t, i in left:
        best = [(rt, n) for n, (rk, rt, _) in enumerate(right) if rk == k and rk is not None and t is not None and rt is not None and rt <= t]
        best = max(best) if best else None
        if best and tolerance and t - best[0] > tolerance:
            best = None
        out.append((i, best and best[1]))
    return sorted(out, key=lambda x: x[0])


@pytest.mark.parametrize("tolerance", [0, 2, 5])
@pytest.mark.parametrize("kind", ["int", "string", "none"])
def test_asof_against_brute_force(spark, kind, tolerance):
    rng = random.Random(tolerance)
    key = (lambda: 0) if kind == "none" else (lambda: rng.choice([-1, 0, 1, 2, None]))
    cast = (lambda k: None if k is None else f"s{k}") if kind == "string" else (lambda k: k)
    left = [(cast(key()), rng.choice([None, *range(50)]), i) for i in range(200)]
    right = [(cast(key()), rng.choice([None, *range(50)]), i) for i in range(150)]
    t = "string" if kind == "string" else "int"
    schema = f"k {t}, ts long, id long"
    keys = (None, None) if kind == "none" else ("k", "k")
    df = O.asof_join(spark.createDataFrame(left, schema).repartition(3), spark.createDataFrame(right, schema).repartition(3), "ts", "ts", *keys, tolerance, ("l", "r"), "id", stretch=20)
    assert df.columns == ["l.k", "l.ts", "l.id", "r.k", "r.ts", "r.id"]
    got = sorted((r["l.id"], r["r.id"]) for r in df.collect())
    assert got == brute_asof(left, right, tolerance)


def test_asof_trades_and_quotes(spark):
    trades = ticks(spark, 10)
    quotes = spark.createDataFrame([(2 * i, 99.5 + 0.01 * i, 100.5 + 0.01 * i, 0) for i in range(5)], "ts long, bid double, ask double, symbol int")
    got = {r["trades.ts"]: r["quotes.ts"] for r in O.asof_join(trades, quotes, "ts", "ts", "symbol", "symbol", prefixes=("trades", "quotes")).collect()}
    assert len(got) == 10 and got[1] == 0 and got[2] == 2 and got[9] == 8
    late = O.asof_join(trades.filter("ts = 5"), quotes.filter("ts > 5"), "ts", "ts", "symbol", "symbol").collect()
    assert len(late) == 1 and late[0]["right.ts"] is None
    empty = quotes.limit(0)
    assert O.asof_pairs(trades, empty, "ts", "ts", "ts", "ts").filter("right_row = -1").count() == 10


def test_hash_join_keys(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (-1, "z"), (None, "n")], "k int, v string")
    b = spark.createDataFrame([(1, 10), (-1, 20), (None, 30), (5, 40)], "k long, w int")
    got = O.hash_join(a, b, "k", "k", ("a", "b"))
    assert got.columns == ["a.k", "a.v", "b.k", "b.w"]
    assert sorted((r["a.v"], r["b.w"]) for r in got.collect()) == [("x", 10), ("y", 10), ("z", 20)]
    with pytest.raises(TypeError):
        O.hash_join(a.select(F.col("k").cast("double").alias("k")), b, "k", "k")
    with pytest.raises(TypeError):
        O.hash_join(a, b, "v", "k")


def test_dictionary(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["alpha", "beta", "alpha", "gamma", "beta", None])], "i int, s string")
    codes, encoded = O.dict_encode(df, "s")
    assert codes.count() == 3
    by = {r["i"]: r["code"] for r in encoded.collect()}
    assert by[0] == by[2] and by[1] == by[4] and by[5] is None
    assert sorted(map(tuple, O.dict_decode(encoded, codes, "s").select("i", "s").collect()), key=lambda r: r[0]) == [tuple(r) for r in df.collect()]


def test_runs(spark):
    values = [1] * 100 + [2] * 50 + [3] * 200
    df = spark.createDataFrame(list(enumerate(values)), "i int, v int").repartition(4)
    runs = O.rle_encode(df, "i", "v")
    assert [(r["value"], r["run_length"]) for r in runs.orderBy("run_id").collect()] == [(1, 100), (2, 50), (3, 200)]
    assert O.rle_bytes(runs).first()[0] == 24
    assert [r["v"] for r in O.rle_decode(runs, "v").orderBy("rn").collect()] == values
    nulls = spark.createDataFrame([(0, None), (1, None), (2, 1)], "i int, v int")
    assert [(r["value"], r["run_length"]) for r in O.rle_encode(nulls, "i", "v").orderBy("run_id").collect()] == [(None, 2), (1, 1)]
    assert O.rle_encode(df.limit(0), "i", "v").count() == 0


def test_runs_that_go_on_over_ranges(spark):
    """Runs within a range, over several ranges and over all, against a loop; sums in blocks shorter than runs."""
    for lengths in ([400], [1] * 97, [1, 150, 1, 1, 200, 3, 40], [90, 2, 2, 90]):
        values = [(i * 7) % 3 if (i * 7) % 3 else None for i, n in enumerate(lengths) for _ in range(n)]
        df = spark.createDataFrame([(i, v, float(i % 11)) for i, v in enumerate(values)], "i int, v int, x double").repartition(5)
        want, sums = [], {}
        for i, v in enumerate(values):
            if want and want[-1][1] == v:
                want[-1][3] += 1
            else:
                want.append([len(want), v, i, 1])
            sums[v] = sums.get(v, 0) + i % 11
        runs = O.rle_encode(df, "i", "v")
        assert sorted(map(list, runs.collect()), key=lambda r: r[0]) == want
        assert dict(map(tuple, O.rle_group_sum(runs, df, "i", "x", block=64).collect())) == sums


def test_sums_over_a_dictionary(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 2.0), (None, 8.0), ("b", 4.0)], "s string, x double")
    assert sorted(map(tuple, O.dict_group_sum(df, "s", F.col("x")).collect())) == [(0, "a", 2.0), (1, "b", 5.0)]


def test_chunks_equal_the_whole(spark):
    df = spark.createDataFrame([(i, i % 10, i * 0.5) for i in range(10_000)], "i int, k int, v double")
    assert sorted(map(tuple, O.chunked_group_sum(df, "i", "k", F.col("v"), 2500).collect())) == sorted(map(tuple, O.group_sum(df, "k", "v").collect()))


def test_gather_and_materialize(spark):
    values = spark.createDataFrame([(i, i * 10) for i in range(5)], "r int, v int")
    at = spark.createDataFrame([(0, 3), (1, 3), (2, 0)], "p int, i int")
    assert sorted((r["p"], r["v"]) for r in O.gather(values, "r", at, "i").collect()) == [(0, 30), (1, 30), (2, 0)]
    assert O.materialize(values, "r", at, "i").count() == 2
    assert O.LazyFilter(values, F.col("v") > 20).materialize("r").columns == ["r"]
    with pytest.raises(ValueError):
        O.limit(values, -1)
    assert O.compact(values, "v", "NEQ", 10).count() == 4
    assert O.aggregate(values, [], [("COUNT", "*", "n"), ("AVG", "v", "a")]).first() == (5, 20.0)


@pytest.mark.parametrize("stretch", [7, 1000])
def test_exponential_averages_pass_over_nulls(spark, stretch):
    values = [None, None, *[None if i % 5 or 20 < i < 60 else float(i) for i in range(150)]]
    df = spark.createDataFrame(list(enumerate(values)), "ts int, x double").repartition(3).withColumn("day", F.date_add(F.lit("2020-01-01").cast("date"), F.col("ts")))
    want, e = [], None
    for v in values:
        e = e if v is None else v if e is None else 2 / 21 * v + 19 / 21 * e
        want.append(e)
    for got in (O.rolling(df, "day", [("EMA", "x", 20, "e"), ("SMA", "x", 3, "a")], stretch=stretch), with_ema(df, "e", F.col("x"), 20, F.col("ts"))):
        assert [r["e"] for r in got.orderBy("ts").collect()] == [None if w is None else pytest.approx(w, abs=1e-12) for w in want]
