"""Dictionary and run-length encoding as tables, and sums over encoded data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import ranged


def dict_encode(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(dictionary of code and value, df with column replaced by code). Codes follow the values'
    order from 0; null has none. Only distinct values are numbered."""
    values = df.select(F.col(column).alias("value")).filter("value is not null").distinct()
    codes = values.select((F.dense_rank().over(Window.orderBy("value")) - 1).alias("code"), "value")
    encoded = df.join(codes, df[column] == codes["value"], "left").drop("value", column)
    return codes, encoded


def dict_decode(encoded: DataFrame, dictionary: DataFrame, column: str) -> DataFrame:
    return encoded.join(dictionary, "code", "left").withColumnRenamed("value", column).drop("code")


def dict_group_sum(df: DataFrame, column: str, value: Column, name: str = "total") -> DataFrame:
    """Sums by code, with the code's value. Rows are summed before codes are given: these number the groups,
    which are the dictionary's values, so no row is joined."""
    sums = df.groupBy(F.col(column).alias("value")).agg(F.sum(value).alias(name)).filter("value is not null")
    return sums.select((F.dense_rank().over(Window.orderBy("value")) - 1).alias("code"), "value", name)


def rle_encode(df: DataFrame, order: str, column: str) -> DataFrame:
    """Maximal runs of equal values in row order: run_id (from 0), value, start (row number from 0),
    run_length. A row is a head where the one before it in its range of the order differs; what a range
    needs from others (rows and heads before it, whether its first head goes on a run, where the next
    run begins) comes from a table of one row a range."""
    inside = Window.partitionBy("_bucket").orderBy(order)
    rows = ranged(df.select(order, F.col(column).alias("value")), order)
    rows = rows.select("_bucket", F.struct("value").alias("_v"), (F.row_number().over(inside) - 1).alias("_in"), F.lag(F.struct("value")).over(inside).alias("_before"))
    heads = F.col("_before").isNull() | ~F.col("_before.value").eqNullSafe(F.col("_v.value"))
    later = F.when(heads & (F.col("_in") > 0), F.col("_in"))
    ranges = rows.groupBy("_bucket").agg(F.count("*").alias("_n"), F.count_if(heads).alias("_heads"), F.min_by("_v", "_in").alias("_first"), F.max_by("_v", "_in").alias("_last"), F.min(later).alias("_second"))
    along = Window.orderBy("_bucket")
    goes_on = F.coalesce(F.lag("_last").over(along)["value"].eqNullSafe(F.col("_first.value")) & F.lag("_last").over(along).isNotNull(), F.lit(False))
    ranges = ranges.withColumn("_goes_on", goes_on).withColumn("_begin", F.sum("_n").over(along) - F.col("_n"))
    ranges = ranges.withColumn("_runs", F.sum(F.col("_heads") - F.col("_goes_on").cast("long")).over(along) - F.col("_heads"))
    start = F.when(~F.col("_goes_on"), F.col("_begin")).otherwise(F.col("_begin") + F.col("_second"))
    after = F.first(start, ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing))
    total = F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranges = ranges.select("_bucket", "_goes_on", "_begin", "_runs", F.coalesce(after, total).alias("_after"))
    runs = rows.filter(heads).withColumn("_k", F.row_number().over(Window.partitionBy("_bucket").orderBy("_in")))
    runs = runs.withColumn("_next", F.lead("_in").over(Window.partitionBy("_bucket").orderBy("_in"))).join(F.broadcast(ranges), "_bucket")
    runs = runs.filter((F.col("_in") > 0) | ~F.col("_goes_on"))
    # _runs counts the runs up to and with this range, less its heads: a head's number follows from its place among them.
    begin = F.col("_begin") + F.col("_in")
    stop = F.coalesce(F.col("_begin") + F.col("_next"), "_after")
    return runs.select((F.col("_runs") + F.col("_k") - 1).alias("run_id"), F.col("_v.value").alias("value"), begin.alias("start"), (stop - begin).alias("run_length"))


def rle_decode(runs: DataFrame, column: str) -> DataFrame:
    """rn (from 0) and the value of each row."""
    return runs.select(F.explode(F.expr("sequence(start, start + run_length - 1)")).alias("rn"), F.col("value").alias(column))


def rle_bytes(runs: DataFrame, run_bytes: int = 8) -> DataFrame:
    return runs.agg((F.count("*") * run_bytes).alias("bytes"))


#: Rows of a block of rle_group_sum.
BLOCK = 250_000


def rle_group_sum(runs: DataFrame, rows: DataFrame, row_number: str, value: str, name: str = "total", block: int = BLOCK) -> DataFrame:
    """Adds each run's slice of the rows' values to the sum of the run's value. Runs meet rows in blocks of row
    numbers: a run goes to each block that it reaches into, and a row takes the last run before it."""
    end = F.col("start") + F.col("run_length") - 1
    spans = runs.select(F.explode(F.sequence(F.floor(F.col("start") / block), F.floor(end / block))).alias("_block"), "start", F.struct("value", end.alias("end")).alias("_run"))
    spans = spans.select("_block", F.greatest("start", F.col("_block") * block).alias("_at"), F.lit(0).alias("_side"), "_run", F.lit(None).alias("_x"))
    values = rows.select(F.floor(F.col(row_number) / block).alias("_block"), F.col(row_number).alias("_at"), F.lit(1).alias("_side"), F.lit(None).alias("_run"), F.col(value).alias("_x"))
    run = F.last("_run", ignorenulls=True).over(Window.partitionBy("_block").orderBy("_at", "_side"))
    both = spans.unionByName(values).withColumn("_run", run).filter("_side = 1 and _at <= _run.end")
    return both.groupBy(F.col("_run.value").alias("value")).agg(F.sum("_x").alias(name))
