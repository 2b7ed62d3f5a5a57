"""Named queries, each a function of (spark, folder of the tables), and the DuckDB SQL that checks them.

Sums and averages of doubles are rounded on both sides, since their last bits depend on the order of
addition; moving averages to nine decimals, where no mean of up to 200 values with two decimals lies on
a rounding boundary.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import operators as O
from .dialect import parse
from .functions import ema_depth, with_ema
from .plans import lower

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_SALES = """(SELECT o_orderkey AS order_id, o_totalprice AS amount, r_name AS region, year(o_orderdate)::INT AS year
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
_TRADES = "(SELECT event_id, ts, user_id, value FROM events WHERE event_type = 'purchase')"
_QUOTES = "(SELECT event_id, ts, user_id, value FROM events WHERE event_type = 'click')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder, or one of the views sales, ticks, trades and quotes over them."""
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    if name == "sales":
        # The dimensions are small beside orders; Spark broadcasts those within its threshold.
        places = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        rows = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        return rows.select(F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("amount"), F.col("r_name").alias("region"), F.year("o_orderdate").alias("year"))
    if name == "ticks":
        return read("events").select("event_id", "ts", F.col("value").alias("price"), F.col("user_id").alias("symbol"))
    if name in ("trades", "quotes"):
        return read("events").filter(F.col("event_type") == ("purchase" if name == "trades" else "click")).select("event_id", "ts", "user_id", "value")
    return read(name)


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def statement(name: str, text: str, oracle: str, **rounded: int) -> None:
    """A query that is a statement of the dialect. rounded: columns and their decimals."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = lower(parse(text), lambda t: table(spark, sf_dir, t))
        return df.withColumns({c: F.round(c, n) for c, n in rounded.items()}) if rounded else df

    QUERIES[name], ORACLE[name] = run, oracle


# --- scans, projections, expressions ---------------------------------------------------------------

statement("scan_all", "SELECT * FROM nation", "SELECT * FROM nation")
statement("scan_project", "SELECT c_name, c_custkey FROM customer", "SELECT c_name, c_custkey FROM customer")
statement("select_expr_alias", "SELECT o_orderkey AS id, o_totalprice * 2 AS twice, -o_totalprice AS minus FROM orders", "SELECT o_orderkey AS id, o_totalprice * 2 AS twice, -o_totalprice AS minus FROM orders")
statement("select_arith_ints", "SELECT l_linenumber / 2 AS half, l_linenumber + 1 AS next FROM lineitem", "SELECT l_linenumber::DOUBLE / 2 AS half, l_linenumber::DOUBLE + 1 AS next FROM lineitem")
statement("select_compare", "SELECT l_orderkey AS k, l_tax > 0.04 AS taxed FROM lineitem", "SELECT l_orderkey AS k, l_tax > 0.04 AS taxed FROM lineitem")

for _name, _op in (("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<="), ("eq", "="), ("neq", "<>")):
    statement(f"filter_{_name}", f"SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity {_op} 25", f"SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity {_op} 25")
statement("filter_str_eq", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
statement("filter_str_lt", "SELECT c_custkey FROM customer WHERE c_mktsegment < 'C'", "SELECT c_custkey FROM customer WHERE c_mktsegment < 'C'")
statement("filter_and", "SELECT l_orderkey FROM lineitem WHERE l_quantity > 10 AND l_discount < 0.05", "SELECT l_orderkey FROM lineitem WHERE l_quantity > 10 AND l_discount < 0.05")
statement("filter_or", "SELECT l_orderkey FROM lineitem WHERE l_quantity > 45 OR l_returnflag = 'R'", "SELECT l_orderkey FROM lineitem WHERE l_quantity > 45 OR l_returnflag = 'R'")
statement("filter_not", "SELECT l_orderkey FROM lineitem WHERE NOT (l_quantity > 10 AND l_returnflag = 'A')", "SELECT l_orderkey FROM lineitem WHERE NOT (l_quantity > 10 AND l_returnflag = 'A')")
statement("filter_arith", "SELECT o_orderkey FROM orders WHERE o_totalprice / 2 - 1000 > o_custkey * 3", "SELECT o_orderkey FROM orders WHERE o_totalprice / 2 - 1000 > o_custkey::DOUBLE * 3")
statement("filter_neg", "SELECT c_custkey FROM customer WHERE -c_acctbal > 0", "SELECT c_custkey FROM customer WHERE -c_acctbal > 0")
statement("filter_truthy", "SELECT l_orderkey FROM lineitem WHERE l_discount AND l_returnflag", "SELECT l_orderkey FROM lineitem WHERE l_discount <> 0 AND l_returnflag <> ''")
statement("filter_qualified", "SELECT orders.o_orderkey FROM orders WHERE orders.o_totalprice >= 100000", "SELECT o_orderkey FROM orders WHERE o_totalprice >= 100000")

# --- aggregates -------------------------------------------------------------------------------------

statement("flagship_region_revenue", "SELECT AVG(amount) AS mean, region, MAX(amount) AS largest, SUM(amount) AS revenue FROM sales WHERE year > 1995 AND amount > 1000 GROUP BY region ORDER BY revenue DESC",
          f"SELECT round(avg(amount), 4) AS mean, region, max(amount) AS largest, round(sum(amount), 2) AS revenue FROM {_SALES} WHERE year > 1995 AND amount > 1000 GROUP BY region", mean=4, revenue=2)
statement("agg_global", "SELECT SUM(l_quantity) AS q, COUNT(*) AS n, AVG(l_tax) AS t, MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi FROM lineitem",
          "SELECT round(sum(l_quantity), 2) AS q, count(*) AS n, round(avg(l_tax), 6) AS t, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem", q=2, t=6)
statement("agg_empty_input", "SELECT COUNT(*) AS n, SUM(l_quantity) AS s, MIN(l_tax) AS lo FROM lineitem WHERE l_quantity < 0", "SELECT count(*) AS n, sum(l_quantity) AS s, min(l_tax) AS lo FROM lineitem WHERE l_quantity < 0")
statement("groupby_one", "SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY c_mktsegment", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
statement("groupby_multi", "SELECT l_linestatus, l_returnflag, SUM(l_extendedprice) AS s FROM lineitem GROUP BY l_returnflag, l_linestatus", "SELECT l_linestatus, l_returnflag, round(sum(l_extendedprice), 2) AS s FROM lineitem GROUP BY ALL", s=2)
statement("groupby_no_agg", "SELECT event_type FROM events GROUP BY event_type", "SELECT DISTINCT event_type FROM events")
statement("groupby_expr_of_aggs", "SELECT l_returnflag, SUM(l_extendedprice) / COUNT(*) AS per_row FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(sum(l_extendedprice) / count(*), 4) AS per_row FROM lineitem GROUP BY 1", per_row=4)
statement("groupby_expr_argument", "SELECT l_returnflag, SUM(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY 1", revenue=2)
statement("agg_five_functions", "SELECT region, SUM(amount) AS s, COUNT(amount) AS n, AVG(amount) AS a, MIN(amount) AS lo, MAX(amount) AS hi FROM sales GROUP BY region",
          f"SELECT region, round(sum(amount), 2) AS s, count(amount) AS n, round(avg(amount), 4) AS a, min(amount) AS lo, max(amount) AS hi FROM {_SALES} GROUP BY region", s=2, a=4)
statement("agg_min_max_string", "SELECT MIN(c_name) AS first, MAX(c_name) AS last FROM customer", "SELECT min(c_name) AS first, max(c_name) AS last FROM customer")


@query("SELECT l_quantity FROM lineitem WHERE l_quantity >= 30")
def kernel_filter(spark, sf_dir):
    return O.compact(table(spark, sf_dir, "lineitem"), "l_quantity", "GTE", 30.0)


@query("SELECT round(sum(l_extendedprice), 2) AS total FROM lineitem")
def sum_reduce(spark, sf_dir):
    return O.sum_of(table(spark, sf_dir, "lineitem"), "l_extendedprice").withColumn("total", F.round("total", 2))


@query("SELECT count(*) FILTER (WHERE l_tax > 0.04) AS n FROM lineitem")
def count_mask(spark, sf_dir):
    return O.count_mask(table(spark, sf_dir, "lineitem"), F.col("l_tax") > 0.04)


@query("SELECT l_suppkey, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY l_suppkey")
def groupby_sum_int(spark, sf_dir):
    return O.group_sum(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_extendedprice").withColumn("total", F.round("total", 2))


@query("SELECT event_type, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def chunked_groupby_sum(spark, sf_dir):
    return O.chunked_group_sum(table(spark, sf_dir, "events"), "event_id", "event_type", F.col("value"), 2500).withColumn("total", F.round("total", 4))


@query("SELECT event_id // 2500 AS chunk, value FROM events WHERE value > 50")
def chunked_filter(spark, sf_dir):
    return O.chunked_filter(table(spark, sf_dir, "events"), "event_id", "value", 50.0, 2500)


@query("SELECT l_suppkey, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE l_quantity > 25 GROUP BY l_suppkey")
def filter_then_groupby(spark, sf_dir):
    return O.filter_then_group_sum(table(spark, sf_dir, "lineitem"), F.col("l_quantity") > 25, "l_suppkey", F.col("l_extendedprice")).withColumn("total", F.round("total", 2))


@query("SELECT count(*)::BIGINT AS n_rows, (max(event_id) // 2500 + 1)::BIGINT AS n_chunks, count(DISTINCT event_type)::BIGINT AS n_groups FROM events")
def chunked_groups(spark, sf_dir):
    return O.chunked_group_report(table(spark, sf_dir, "events"), "event_id", "event_type", 2500)


@query("""SELECT t::DOUBLE AS threshold, l_suppkey, round(sum(l_extendedprice), 2) AS total
    FROM lineitem, (VALUES (10), (25), (40), (49)) AS x(t) WHERE l_quantity > t GROUP BY t, l_suppkey""")
def repeated_filter_groupby(spark, sf_dir):
    out = O.repeated_filter_group_sum(table(spark, sf_dir, "lineitem"), "l_quantity", [10, 25, 40, 49], "l_suppkey", F.col("l_extendedprice"))
    return out.withColumn("total", F.round("total", 2))


# --- sort, limit --------------------------------------------------------------------------------------

statement("sort_asc", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice", "SELECT o_orderkey, o_totalprice FROM orders")
statement("sort_desc", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC", "SELECT o_orderkey, o_totalprice FROM orders")
statement("sort_string", "SELECT c_name FROM customer ORDER BY c_name", "SELECT c_name FROM customer")
statement("sort_by_alias", "SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY c_mktsegment ORDER BY n DESC", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
statement("limit_n", "SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 7", "SELECT n_nationkey FROM nation ORDER BY 1 LIMIT 7")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk(spark, sf_dir):
    return O.top_k(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 10, False, "o_orderkey")


# --- windows ------------------------------------------------------------------------------------------


def _window(name: str, func: str, w: int) -> None:
    if func == "EMA":
        alpha = 2 / (w + 1)
        sql = f"list_reduce(list(value) OVER (ORDER BY ts, event_id ROWS BETWEEN {ema_depth(w)} PRECEDING AND CURRENT ROW), lambda a, x: {alpha!r} * x + {1 - alpha!r} * a)"
    else:
        sql = f"{'avg' if func == 'SMA' else 'stddev_pop'}(value) OVER (ORDER BY ts, event_id ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "events").select("event_id", "ts", "value")
        return O.rolling(rows, "ts", [(func, "value", w, "x")], "event_id").select("event_id", F.round("x", 9).alias("x"))

    QUERIES[name], ORACLE[name] = run, f"SELECT event_id, round({sql}, 9) AS x FROM events"


for _name, _func, _w in (("window_sma_20", "SMA", 20), ("window_sma_200", "SMA", 200), ("window_std_20", "ROLLING_STD", 20), ("window_std_200", "ROLLING_STD", 200),
                         ("window_ema_5", "EMA", 5), ("window_ema_20", "EMA", 20), ("window_ema_50", "EMA", 50)):
    _window(_name, _func, _w)


@query("""SELECT event_id, round(avg(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 9) AS a,
    round(stddev_pop(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 9) AS s FROM events""")
def window_multi(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "value")
    return O.rolling(rows, "ts", [("SMA", "value", 50, "a"), ("ROLLING_STD", "value", 20, "s")], "event_id").select("event_id", F.round("a", 9).alias("a"), F.round("s", 9).alias("s"))


statement("window_partitioned", "SELECT event_id, SMA(price, 10) OVER (PARTITION BY symbol ORDER BY ts ROWS 10 PRECEDING) AS a, ROLLING_STD(price) OVER (PARTITION BY symbol ORDER BY ts ROWS 5 PRECEDING) AS s FROM ticks",
          """SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 9) AS a,
             round(stddev_pop(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 9) AS s FROM events""", a=9, s=9)  # fmt: skip
statement("window_ema_partitioned", "SELECT event_id, EMA(price, 5) OVER (PARTITION BY symbol ORDER BY ts ROWS 5 PRECEDING) AS e FROM ticks",
          f"""SELECT event_id, round(list_reduce(list(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN {ema_depth(5)} PRECEDING AND CURRENT ROW),
              lambda a, x: {2 / 6!r} * x + {1 - 2 / 6!r} * a), 9) AS e FROM events""", e=9)  # fmt: skip
statement("window_dialect_sma", "SELECT event_id, SMA(price, 20) OVER (ORDER BY event_id ROWS 20 PRECEDING) AS a FROM ticks",
          "SELECT event_id, round(avg(value) OVER (ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 9) AS a FROM events", a=9)



def _with_gaps(value: str) -> str:
    """Events whose value is null where the id is divisible by 3, or for long stretches."""
    return f"CASE WHEN event_id % 3 = 0 OR event_id % 1000 < 700 THEN NULL ELSE {value} END"


def _nulls_sql(w: int, by: str) -> str:
    alpha = 2 / (w + 1)
    return f"""WITH g AS (SELECT event_id, user_id, ts, {_with_gaps("value")} AS v FROM events),
        c AS (SELECT *, count(v) OVER ({by} ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g),
        l AS (SELECT event_id, list(v) FILTER (v IS NOT NULL) OVER ({by} ORDER BY k RANGE BETWEEN {ema_depth(w)} PRECEDING AND CURRENT ROW) AS l FROM c)
        SELECT event_id, CASE WHEN len(l) > 0 THEN round(list_reduce(l, lambda a, x: {alpha!r} * x + {1 - alpha!r} * a), 9) END AS x FROM l"""


@query(_nulls_sql(20, ""))
def window_ema_nulls(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "ts", F.expr(_with_gaps("value")).alias("v"))
    return O.rolling(rows, "ts", [("EMA", "v", 20, "x")], "event_id").select("event_id", F.round("x", 9).alias("x"))


@query(_nulls_sql(10, "PARTITION BY user_id"))
def window_ema_nulls_partitioned(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.expr(_with_gaps("value")).alias("v"))
    return with_ema(rows, "x", F.col("v"), 10, [F.col("ts"), F.col("event_id")], F.col("user_id")).select("event_id", F.round("x", 9).alias("x"))


# --- joins --------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice, l_linenumber, l_quantity, l_extendedprice FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def join_bigint(spark, sf_dir):
    left, right = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return O.hash_join(left, right, "o_orderkey", "l_orderkey").drop("l_orderkey")


@query('SELECT n_nationkey AS "n.n_nationkey", n_name AS "n.n_name", s_suppkey AS "s.s_suppkey", s_nationkey AS "s.s_nationkey" FROM nation JOIN supplier ON n_nationkey = s_nationkey')
def join_int(spark, sf_dir):
    return O.hash_join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "n_nationkey", "s_nationkey", ("n", "s"))


@query("SELECT n, c_custkey, c_mktsegment FROM (SELECT c_mktsegment AS m, count(*) AS n FROM customer GROUP BY 1) JOIN customer ON m = c_mktsegment")
def join_string(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    counts = c.groupBy(F.col("c_mktsegment").alias("m")).agg(F.count("*").alias("n"))
    return O.hash_join(counts, c.select("c_custkey", "c_mktsegment"), "m", "c_mktsegment").drop("m")


@query("SELECT a.event_id AS a, b.event_id AS b FROM (SELECT * FROM events WHERE event_type = 'signup') a JOIN (SELECT * FROM events WHERE event_type = 'error') b ON a.user_id = b.user_id")
def join_dup_keys(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    left = e.filter("event_type = 'signup'").select(F.col("event_id").alias("a"), "user_id")
    right = e.filter("event_type = 'error'").select(F.col("event_id").alias("b"), F.col("user_id").alias("k"))
    return O.hash_join(left, right, "user_id", "k").select("a", "b")


@query("SELECT c_custkey AS build_row, o_orderkey AS probe_row FROM customer JOIN orders ON c_custkey = o_custkey")
def join_pairs(spark, sf_dir):
    return O.join_pairs(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey", "c_custkey", "o_orderkey")


_ASOF = f"SELECT t.event_id AS trade, q.event_id AS quote, q.value AS quote_value FROM {_TRADES} t ASOF LEFT JOIN {_QUOTES} q ON t.user_id = q.user_id AND t.ts >= q.ts"


def _asof(spark, sf_dir, keyed: bool = True, tolerance: int = 0) -> DataFrame:
    key = "user_id" if keyed else None
    df = O.asof_join(table(spark, sf_dir, "trades"), table(spark, sf_dir, "quotes"), "ts", "ts", key, key, tolerance, ("t", "q"), right_order="event_id")
    return df.select(F.col("`t.event_id`").alias("trade"), F.col("`q.event_id`").alias("quote"), F.col("`q.value`").alias("quote_value"))


@query(_ASOF)
def asof_key(spark, sf_dir):
    return _asof(spark, sf_dir)


@query(f"SELECT t.event_id AS trade, q.event_id AS quote, q.value AS quote_value FROM {_TRADES} t ASOF LEFT JOIN {_QUOTES} q ON t.ts >= q.ts")
def asof_no_key(spark, sf_dir):
    return _asof(spark, sf_dir, keyed=False)


_WITHIN = "t.ts - q.ts <= INTERVAL 24 HOUR"


@query(f"SELECT t.event_id AS trade, CASE WHEN {_WITHIN} THEN q.event_id END AS quote, CASE WHEN {_WITHIN} THEN q.value END AS quote_value FROM {_TRADES} t ASOF LEFT JOIN {_QUOTES} q ON t.user_id = q.user_id AND t.ts >= q.ts")
def asof_tolerance(spark, sf_dir):
    return _asof(spark, sf_dir, tolerance=24 * 3600 * 1_000_000_000)


statement("asof_select_list", "SELECT t.ts, t.value, q.event_id FROM trades AS t ASOF JOIN quotes AS q ON t.user_id = q.user_id AS OF t.ts >= q.ts",
          f'SELECT t.ts AS "t.ts", t.value AS "t.value", q.event_id AS "q.event_id" FROM {_TRADES} t ASOF LEFT JOIN {_QUOTES} q ON t.user_id = q.user_id AND t.ts >= q.ts')


@query(f"SELECT t.event_id AS left_row, coalesce(q.event_id, -1) AS right_row FROM {_TRADES} t ASOF LEFT JOIN {_QUOTES} q ON t.user_id = q.user_id AND t.ts >= q.ts")
def asof_pairs(spark, sf_dir):
    return O.asof_pairs(table(spark, sf_dir, "trades"), table(spark, sf_dir, "quotes"), "event_id", "event_id", "ts", "ts", "user_id", "user_id")


# --- encoded data, row ids ------------------------------------------------------------------------------

_RUNS = """(SELECT min(event_type) AS value, min(rn) AS start, count(*) AS run_length FROM (
    SELECT rn, event_type, sum(CASE WHEN event_type IS DISTINCT FROM before OR rn = 0 THEN 1 ELSE 0 END) OVER (ORDER BY rn) AS run FROM (
    SELECT row_number() OVER (ORDER BY event_id) - 1 AS rn, event_type, lag(event_type) OVER (ORDER BY event_id) AS before FROM events)) GROUP BY run)"""


@query("SELECT dense_rank() OVER (ORDER BY l_returnflag) - 1 AS code, l_returnflag AS value FROM (SELECT DISTINCT l_returnflag FROM lineitem)")
def dict_encode(spark, sf_dir):
    return O.dict_encode(table(spark, sf_dir, "lineitem"), "l_returnflag")[0].select(F.col("code").cast("long"), "value")


@query("SELECT event_id, event_type FROM events")
def dict_decode(spark, sf_dir):
    codes, encoded = O.dict_encode(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type")
    return O.dict_decode(encoded, codes, "event_type")


@query("SELECT dense_rank() OVER (ORDER BY l_returnflag) - 1 AS code, l_returnflag AS value, round(s, 2) AS total FROM (SELECT l_returnflag, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1)")
def dict_groupby_sum(spark, sf_dir):
    df = O.dict_group_sum(table(spark, sf_dir, "lineitem"), "l_returnflag", F.col("l_extendedprice"))
    return df.select(F.col("code").cast("long"), "value", F.round("total", 2).alias("total"))


@query(f"SELECT row_number() OVER (ORDER BY start) - 1 AS run_id, value, start, run_length FROM {_RUNS}")
def rle_encode(spark, sf_dir):
    return O.rle_encode(table(spark, sf_dir, "events"), "event_id", "event_type")


@query(f"SELECT count(*) * 8 AS bytes FROM {_RUNS}")
def rle_bytes(spark, sf_dir):
    return O.rle_bytes(O.rle_encode(table(spark, sf_dir, "events"), "event_id", "event_type"))


@query("SELECT row_number() OVER (ORDER BY event_id) - 1 AS rn, event_type FROM events")
def rle_decode(spark, sf_dir):
    return O.rle_decode(O.rle_encode(table(spark, sf_dir, "events"), "event_id", "event_type"), "event_type")


@query("SELECT event_type AS value, round(sum(value), 4) AS total FROM events GROUP BY 1")
def rle_groupby_sum(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = O.windows.numbered(e.select("event_id", "value"), "event_id", "rn").select("rn", F.col("value").alias("v"))
    return O.rle_group_sum(O.rle_encode(e, "event_id", "event_type"), rows, "rn", "v").withColumn("total", F.round("total", 4))


@query("SELECT o_orderkey AS pos, o_custkey AS idx, c_name FROM orders JOIN customer ON c_custkey = o_custkey")
def gather(spark, sf_dir):
    at = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("idx"))
    return O.gather(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", at, "idx")


@query("SELECT * FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def materialize(spark, sf_dir):
    chosen = O.LazyFilter(table(spark, sf_dir, "lineitem"), F.col("l_quantity") > 49).selection("l_orderkey")
    return O.materialize(table(spark, sf_dir, "orders"), "o_orderkey", chosen, "l_orderkey")


@query("SELECT l_orderkey, l_extendedprice FROM lineitem WHERE year(l_shipdate) >= 1998")
def lazy_filter(spark, sf_dir):
    return O.LazyFilter(table(spark, sf_dir, "lineitem"), F.year("l_shipdate") >= 1998).materialize("l_orderkey", "l_extendedprice")


@query("""SELECT (SELECT count(*) FROM orders) AS n_rows, count(*) AS n_chosen, round(sum(o_totalprice), 2) AS full_sum, round(sum(o_totalprice), 2) AS late_sum
    FROM orders WHERE o_totalprice > 400000""")
def late_materialisation(spark, sf_dir):
    """Rows read whole and filtered, beside rows fetched by ids that were chosen first; both give the same."""
    o = table(spark, sf_dir, "orders")
    above = F.col("o_totalprice") > 400000
    full = o.agg(F.count("*").alias("n_rows"), F.count_if(above).alias("n_chosen"), F.round(F.sum(F.when(above, F.col("o_totalprice"))), 2).alias("full_sum"))
    late = O.materialize(o, "o_orderkey", O.LazyFilter(o, above).selection("o_orderkey"), "o_orderkey")
    # One row beside one row.
    return full.join(F.broadcast(late.agg(F.round(F.sum("o_totalprice"), 2).alias("late_sum"))), F.lit(True), "left")


# --- rings, round trips -----------------------------------------------------------------------------------


@query("SELECT event_id, value FROM events ORDER BY event_id DESC LIMIT 1500")
def ring_snapshot(spark, sf_dir):
    from .streaming import ring_snapshot as newest

    return newest(table(spark, sf_dir, "events").select("event_id", "value"), "event_id", 1500)


@query("SELECT count(*) AS committed FROM events")
def ring_committed(spark, sf_dir):
    """The events in four batches through a ring of 1500 rows; how many rows were committed."""
    return spark.createDataFrame([(_filled(spark, sf_dir).committed_rows(),)], "committed long")


@query("""SELECT event_id, round(avg(value) OVER (ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 9) AS sma
    FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 1500)""")
def tick_sma_snapshot(spark, sf_dir):
    from .streaming import continuous_sma

    return continuous_sma(_filled(spark, sf_dir), "value", 20).select("event_id", F.round("sma", 9).alias("sma"))


def _filled(spark, sf_dir):
    from .streaming import Ring

    e = table(spark, sf_dir, "events").select("event_id", "value")
    ring = Ring(spark, _folder(spark, "ring"), e.schema, max_rows=1500)
    step = ((e.agg(F.max("event_id")).first()[0] or 0) + 4) // 4
    for i in range(4):
        ring.append(e.filter(F.col("event_id").between(i * step, (i + 1) * step - 1)), "event_id")
    return ring


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors reach."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        import uuid

        return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    return tempfile.mkdtemp(prefix=f"{name}-")


@query("SELECT count(*) AS committed FROM events")
def arrow_feed(spark, sf_dir):
    """The events as Arrow files, fed into a ring by a stream; how many rows were committed."""
    from .sources import write_arrow
    from .streaming import Ring, poll_arrow

    e = table(spark, sf_dir, "events").select("event_id", "value")
    write_arrow(e, path := _folder(spark, "feed"))
    ring = Ring(spark, _folder(spark, "ring"), e.schema, max_rows=1500)
    poll_arrow(spark, path, ring, _folder(spark, "feed-log"), None).awaitTermination()
    return spark.createDataFrame([(ring.committed_rows(),)], "committed long")


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def csv_roundtrip(spark, sf_dir):
    from .sources import read_csv, write_csv_sample

    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    write_csv_sample(df, path := _folder(spark, "csv") + "/t")
    return read_csv(spark, path, df.schema, multi_line=False).rows


@query("""SELECT 2 AS col, 'c_acctbal' AS col_name, 'n/a ' || c_custkey AS cell_value, 'not of type double' AS message FROM customer WHERE c_custkey % 7 = 0 AND c_custkey % 11 <> 0
    UNION ALL SELECT NULL, NULL, NULL, 'wrong number of fields' FROM customer WHERE c_custkey % 11 = 0""")
def csv_rejects(spark, sf_dir):
    """Customers as CSV with cells that aren't numbers and rows with a field too many; what the reader reports."""
    return _spoilt_customers(spark, sf_dir).errors.select("col", "col_name", "cell_value", "message")


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 11 <> 0")
def csv_good_rows(spark, sf_dir):
    """The rows that are left of the same file."""
    return _spoilt_customers(spark, sf_dir).rows


def _spoilt_customers(spark, sf_dir):
    from .sources import read_csv

    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    number = F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("n/a "), "c_custkey")).otherwise(F.col("c_acctbal").cast("string"))
    extra = F.when(F.col("c_custkey") % 11 == 0, F.lit("more"))
    # A row with a field too many has no bad cell as well, so that it is reported once.
    lines = df.select(F.concat_ws(",", "c_custkey", F.concat(F.lit('"'), "c_name", F.lit('"')), number, extra))
    lines.write.text(path := _folder(spark, "csv") + "/t")
    return read_csv(spark, path, df.schema, header=False, max_errors=None)


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def arrow_roundtrip(spark, sf_dir):
    from .sources import read_arrow, write_arrow

    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    write_arrow(df, path := _folder(spark, "arrow"))
    return read_arrow(spark, path)
