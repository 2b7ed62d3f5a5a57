"""Equi-joins and as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .windows import numbered


def _prefixed(df: DataFrame, prefix: str | None) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(f"{prefix}.{c}") for c in df.columns]) if prefix else df


def hash_join(build: DataFrame, probe: DataFrame, build_key: str, probe_key: str, prefixes: tuple[str, str] | None = None) -> DataFrame:
    """All pairs of rows with equal keys, the build side's columns first; null keys match nothing.
    With prefixes, columns are named prefix.column. Spark picks broadcast, hash or merge by size."""
    kinds = []
    for df, key in ((build, build_key), (probe, probe_key)):
        kind = df.schema[key].dataType
        if not isinstance(kind, (T.IntegralType, T.StringType)):
            raise TypeError(f"key {key} is {kind.simpleString()}; joins take integers and strings")
        kinds.append(isinstance(kind, T.StringType))
    if kinds[0] != kinds[1]:
        raise TypeError(f"{build_key} and {probe_key} are of different kinds")
    a, b = prefixes or ("", "")
    left, right = _prefixed(build, a), _prefixed(probe, b)
    on = left[f"`{a}.{build_key}`" if a else build_key] == right[f"`{b}.{probe_key}`" if b else probe_key]
    return left.join(right, on, "inner")


def join_pairs(build: DataFrame, probe: DataFrame, build_key: str, probe_key: str, build_id: str, probe_id: str) -> DataFrame:
    """(build_row, probe_row): the row ids of each match."""
    left = build.select(F.col(build_key).alias("k"), F.col(build_id).alias("build_row"))
    return left.join(probe.select(F.col(probe_key).alias("k"), F.col(probe_id).alias("probe_row")), "k").drop("k")


def _ticks(df: DataFrame, column: str):
    """A time column as nanoseconds; integers as they are."""
    if dict(df.dtypes)[column].startswith("timestamp"):
        return F.unix_micros(F.col(f"`{column}`").cast("timestamp")) * 1000
    return F.col(f"`{column}`").cast("long")


def asof_join(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, left_key: str | None = None, right_key: str | None = None, tolerance: int = 0, prefixes: tuple[str, str] | None = ("left", "right"), right_order: str | None = None, stretch: int = 100_000) -> DataFrame:
    """Every row of left with the latest row of right that is not later and has an equal key.

    tolerance: how far back it may be, in the unit of integer times or nanoseconds; 0: any. Of
    right rows at one time the one with the largest right_order counts. Without a match the right
    columns are null; a null time or key matches nothing. Both sides meet in one window over their
    union: one shuffle by key, one sort. Without keys the window is over stretches of time, each
    with the last right row before it.
    """
    a, b = prefixes or ("", "")
    keyed = left_key is not None and right_key is not None
    l_cols, r_cols = [f"{a}.{c}" if a else c for c in left.columns], [f"{b}.{c}" if b else c for c in right.columns]
    lt = F.struct(*[F.col(f"`{c}`").alias(n) for c, n in zip(left.columns, l_cols, strict=True)])
    rt = F.struct(*[F.col(f"`{c}`").alias(n) for c, n in zip(right.columns, r_cols, strict=True)])
    key_l, key_r = (F.col(f"`{left_key}`"), F.col(f"`{right_key}`")) if keyed else (F.lit(0), F.lit(0))
    tie = F.col(f"`{right_order}`").cast("string") if right_order and dict(right.dtypes)[right_order] == "string" else F.col(f"`{right_order}`").cast("long") if right_order else F.lit(0)
    lefts = left.select(key_l.alias("_k"), _ticks(left, left_ts).alias("_t"), F.lit(1).alias("_side"), F.lit(None).alias("_tie"), lt.alias("_l"))
    rights = right.select(key_r.alias("_k"), _ticks(right, right_ts).alias("_t"), F.lit(0).alias("_side"), tie.alias("_tie"), rt.alias("_r"))
    rights = rights.filter("_t is not null and _k is not null")
    both = lefts.unionByName(rights, allowMissingColumns=True)
    seen = F.when(F.col("_r").isNotNull(), F.struct("_t", "_r"))
    if keyed:
        window = Window.partitionBy("_k").orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
        both = both.withColumn("_m", F.last(seen, ignorenulls=True).over(window))
    else:
        rows = numbered(both, "_t", "_rn", "_side", "_tie").withColumn("_part", F.floor(F.col("_rn") / stretch))
        last = rows.groupBy("_part").agg(F.max_by(seen, F.when(F.col("_r").isNotNull(), F.col("_rn"))).alias("_last"))  # one row a stretch
        carry = F.last("_last", ignorenulls=True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.join(F.broadcast(last.select("_part", carry.alias("_carry"))), "_part")
        window = Window.partitionBy("_part").orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)
        both = rows.withColumn("_m", F.coalesce(F.last(seen, ignorenulls=True).over(window), "_carry"))
    hit = F.col("_m").isNotNull() & F.col("_t").isNotNull() & F.col("_k").isNotNull()
    if tolerance:
        hit = hit & (F.col("_t") - F.col("_m._t") <= tolerance)
    found = both.filter("_side = 1").withColumn("_r", F.when(hit, F.col("_m._r")))
    return found.select(*[F.col(f"_l.`{c}`").alias(c) for c in l_cols], *[F.col(f"_r.`{c}`").alias(c) for c in r_cols])


def asof_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_ts: str, right_ts: str, left_key: str | None = None, right_key: str | None = None, tolerance: int = 0) -> DataFrame:
    """(left_row, right_row): right_row is -1 without a match."""
    found = asof_join(left.select(*dict.fromkeys(x for x in (left_id, left_ts, left_key) if x)), right.select(*dict.fromkeys(x for x in (right_id, right_ts, right_key) if x)), left_ts, right_ts, left_key, right_key, tolerance, ("l", "r"))
    return found.select(F.col(f"`l.{left_id}`").alias("left_row"), F.coalesce(F.col(f"`r.{right_id}`"), F.lit(-1)).alias("right_row"))
