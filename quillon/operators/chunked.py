"""Work by chunks of rows: partial results of each chunk, then their sum. Spark's own partial aggregation does this
inside each task; these operators keep the chunk as a level of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_chunk(df: DataFrame, row_id: str, chunk_rows: int) -> DataFrame:
    return df.withColumn("chunk", F.floor(F.col(row_id) / chunk_rows).cast("long"))


def chunked_group_sum(df: DataFrame, row_id: str, key: str, value: Column, chunk_rows: int, name: str = "total") -> DataFrame:
    parts = with_chunk(df, row_id, chunk_rows).groupBy("chunk", key).agg(F.sum(value).alias("part"))
    return parts.groupBy(key).agg(F.sum("part").alias(name))


def chunked_group_report(df: DataFrame, row_id: str, key: str, chunk_rows: int) -> DataFrame:
    """One row: n_rows, n_chunks and n_groups (distinct keys but null) of a chunked sum. Rows are numbered from 0."""
    parts = with_chunk(df, row_id, chunk_rows).groupBy(key).agg(F.count("*").alias("n"), F.max("chunk").alias("last"))
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.max("last") + 1, F.lit(0)).alias("n_chunks"), F.count(key).alias("n_groups"))


def chunked_filter(df: DataFrame, row_id: str, column: str, threshold: float, chunk_rows: int) -> DataFrame:
    """Values above threshold with the chunk that they come from."""
    return with_chunk(df, row_id, chunk_rows).filter(F.col(column) > threshold).select("chunk", column)


def repeated_filter_group_sum(df: DataFrame, column: str, thresholds: list[float], key: str, value: Column, name: str = "total") -> DataFrame:
    """threshold, key, total: the sums by key of the rows above each threshold. All thresholds are answered by one
    scan and one shuffle, as sums under conditions; a key without rows above a threshold isn't listed for it."""
    above = [F.col(column) > t for t in thresholds]
    sums = df.groupBy(key).agg(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.count_if(a).alias("n"), F.sum(F.when(a, value)).alias(name)) for t, a in zip(thresholds, above, strict=True)]).alias("sums"))
    return sums.select(key, F.inline("sums")).filter("n > 0").select("threshold", key, name)


def filter_then_group_sum(df: DataFrame, predicate: Column, key: str, value: Column, name: str = "total") -> DataFrame:
    return df.filter(predicate).groupBy(key).agg(F.sum(value).alias(name))
