"""Windows over a whole table, spread over tasks.

Rows are numbered by ranges of the order column; a stretch of rows then goes to one task with a halo,
the rows before it that its first frames look back to.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rolling_std, sma

_BACK = {"SMA": lambda w: w - 1, "ROLLING_STD": lambda w: w - 1}
_FUNCTION = {"SMA": sma, "ROLLING_STD": rolling_std}


def _as_number(df: DataFrame, order: str) -> Column:
    kind = dict(df.dtypes)[order]
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(order).cast("timestamp"))
    if kind == "date":
        return F.unix_date(order)
    return F.col(order).cast("double" if kind in ("float", "double") or kind.startswith("decimal") else "long")


def ranged(df: DataFrame, order: str, ranges: int | None = None) -> DataFrame:
    """df with _bucket, the range of the order column (from 0; nulls: -1) that a row is in. There are as many as
    shuffles have partitions."""
    ranges = ranges or max(32, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = _as_number(df, order)
    cuts = df.select(F.percentile_approx(at, [i / ranges for i in range(1, ranges)], max(1000, 10 * ranges)).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    bucket = F.when(at.isNotNull(), F.expr("0") if not cuts else F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= at)))
    return df.withColumn("_bucket", F.coalesce(bucket, F.lit(-1)))


def numbered(df: DataFrame, order: str, name: str, *ties: str, ranges: int | None = None) -> DataFrame:
    """df with each row's number in the order, from 0. Rows are ranked within ranges of the order
    column, and a range begins after the count of the rows before it."""
    parts = ranged(df, order, ranges)
    before = F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")
    begins = parts.groupBy("_bucket").agg(F.count("*").alias("_n")).select("_bucket", before.alias("_begin"))  # one row a range
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(order, *ties)) - 1
    rows = parts.withColumn("_in", inside).join(F.broadcast(begins), "_bucket")
    return rows.withColumn(name, (F.col("_begin") + F.col("_in")).cast("long")).drop("_bucket", "_begin", "_in")


def _emas(specs: list[tuple[str, int, str]]):
    def of(rows: pa.Table) -> pa.Table:
        """A stretch's averages as if it were the first, and how many values each has behind it."""
        rows = rows.sort_by("_rn")
        for column, w, name in specs:
            x = rows.column(column).cast(pa.float64()).to_pandas()
            rows = rows.append_column(name, pa.array(x.ewm(alpha=2 / (w + 1), adjust=False, ignore_na=True).mean(), from_pandas=True))
            rows = rows.append_column(f"_n_{name}", pa.array(x.notna().cumsum(), pa.int64()))
        return rows

    return of


def _carried(specs: list[tuple[str, int, str]]):
    def of(ends: pa.Table) -> pa.Table:
        """For each stretch the averages with which the stretches before it end."""
        ends = ends.sort_by("_part")
        for _, w, name in specs:
            e, out = None, []
            for first, last, n in zip(*(ends.column(f"{c}_{name}").to_pylist() for c in ("_first", "_last", "_n")), strict=True):
                out.append(e)
                if first is not None:
                    e = last if e is None else last + (1 - 2 / (w + 1)) ** n * (e - first)
            ends = ends.append_column(f"_in_{name}", pa.array(out, pa.float64()))
        return ends.select(["_part", *[f"{p}_{name}" for _, _, name in specs for p in ("_in", "_first")]])

    return of


def _exponential(rows: DataFrame, specs: list[tuple[str, int, str]]) -> DataFrame:
    """rows (with _rn and _part) with an exponential average for each spec: within each stretch by itself, then with
    what the stretches before it carry in, which has one row a stretch."""
    kinds = "".join(f", `{name}` double, `_n_{name}` long" for _, _, name in specs)
    rows = rows.groupBy("_part").applyInArrow(_emas(specs), ", ".join(f"`{c}` {k}" for c, k in rows.dtypes) + kinds)
    ends = rows.groupBy("_part").agg(*[x for c, _, name in specs for x in (
        F.min_by(F.col(c).cast("double"), F.when(F.col(c).isNotNull(), F.col("_rn"))).alias(f"_first_{name}"), F.max_by(name, "_rn").alias(f"_last_{name}"), F.max(f"_n_{name}").alias(f"_n_{name}"))])
    carried = ends.groupBy().applyInArrow(_carried(specs), "_part long" + "".join(f", `_in_{name}` double, `_first_{name}` double" for _, _, name in specs))
    rows = rows.join(carried, "_part")
    for _, w, name in specs:
        before, n = F.col(f"_in_{name}"), F.col(f"_n_{name}")
        later = F.col(name) + F.pow(F.lit(1 - 2 / (w + 1)), n) * (before - F.col(f"_first_{name}"))
        rows = rows.withColumn(name, F.when(before.isNull(), F.col(name)).when(n == 0, before).otherwise(later))
    return rows


#: Rows of a stretch.
LEAST_STRETCH, MOST_STRETCH = 10_000, 1_000_000


def rolling(df: DataFrame, order: str, specs: list[tuple[str, str, int, str]], *ties: str, stretch: int | None = None) -> DataFrame:
    """df with a column for each spec (function, column, window size, name), over all rows in order. Unless given, a
    stretch is as long as it takes to have two for each core, within bounds. Exponential averages pass over nulls."""
    emas = [(c, w, name) for f, c, w, name in specs if f == "EMA"]
    framed = [s for s in specs if s[0] != "EMA"]
    back = max((_BACK[f](w) for f, _, w, _ in framed), default=0)
    if stretch is None:
        stretch = min(MOST_STRETCH, max(LEAST_STRETCH, -(-df.count() // (2 * df.sparkSession.sparkContext.defaultParallelism))))
    stretch = max(stretch, back + 1)
    rows = numbered(df, order, "_rn", *ties)
    part = F.floor(F.col("_rn") / stretch)
    if framed:
        halo = F.when(F.col("_rn") % stretch >= stretch - back, F.array(part, part + 1)).otherwise(F.array(part)) if back else F.array(part)
        rows = rows.withColumn("_part", F.explode(halo))
        rows = rows.select("*", *[_FUNCTION[f](F.col(c), w, F.col("_rn"), F.col("_part")).alias(name) for f, c, w, name in framed]).filter(F.col("_part") == part)
    else:
        rows = rows.withColumn("_part", part)
    done = _exponential(rows, emas) if emas else rows
    return done.select(*[F.col(f"`{c}`") for c in df.columns], *[name for *_, name in specs])
