"""Schema-driven CSV: good rows with typed cells, and a report of what didn't parse.

Each cell is trimmed, also inside quotes. An empty cell is null where the column may be null, else an
error and the type's default. A cell that doesn't parse is an error and null (or the default); the row
stays. A row with too few or too many fields is an error and goes. Errors name the file, the record in it
(from 1, after the header; blank lines aren't records) and the column (from 0).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DEFAULT = {"int": 0, "bigint": 0, "double": 0.0, "string": ""}
# How a whole cell of a type looks; Spark's casts take more (blanks, suffixes, fractions).
_SHAPE = {"int": r"^[+-]?\d+$", "bigint": r"^[+-]?\d+$", "double": r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(?i:inf(inity)?|nan)$"}


@dataclass
class CsvResult:
    """rows: the table. errors: file, row, record (the raw row), col, col_name, cell_value, message, the first
    max_errors by file, row and col."""

    rows: DataFrame
    errors: DataFrame

    def has_errors(self) -> bool:
        return not self.errors.isEmpty()

    def rows_parsed(self) -> int:
        return self.rows.count()


def spans_lines(spark: SparkSession, path: str, quote: str = '"') -> bool:
    """Whether some line has an odd number of quotes, as those do in which a quoted cell goes on to the next line."""
    line = F.col("value")
    quotes = F.length(line) - F.length(F.replace(line, F.lit(quote), F.lit("")))
    return not spark.read.text(path).filter(quotes % 2 == 1).isEmpty()


def read_csv(spark: SparkSession, path: str, schema: T.StructType, delimiter: str = ",", quote: str = '"', header: bool = True, strict: bool = False, max_errors: int | None = 100, multi_line: bool | None = None) -> CsvResult:
    """strict: the first error fails the read. max_errors None: all. multi_line: quoted cells may hold line ends; files
    are then read by one task each. None looks through the lines first, in parts, and reads by parts where
    no quote is left open at a line's end."""
    if multi_line is None:
        multi_line = spans_lines(spark, path, quote)
    kinds = {f.name: f.dataType.simpleString() for f in schema}
    if bad := [n for n, k in kinds.items() if k not in _DEFAULT]:
        raise TypeError(f"columns {bad} are of types that CSV cells don't have here")
    raw_schema = T.StructType([T.StructField(f.name, T.StringType()) for f in schema] + [T.StructField("_corrupt", T.StringType())])
    # Without all columns Spark doesn't see that a record has too few or too many fields.
    reader = spark.read.option("columnPruning", "false")
    raw = reader.csv(path, schema=raw_schema, sep=delimiter, quote=quote, escape=quote, header=header, multiLine=multi_line,
                     ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", enforceSchema=True)
    # The order of records within a block of a file; blocks come to their tasks as wholes.
    placed = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    cells, faults = [], []
    for i, f in enumerate(schema):
        cell, kind = F.trim(F.col(f"`{f.name}`")), kinds[f.name]
        empty = cell.isNull() | (cell == "")
        value = cell if kind == "string" else F.when(cell.rlike(_SHAPE[kind]), cell.try_cast(kind))
        fault = F.when(empty, F.lit(None if f.nullable else "empty cell in a column that isn't nullable")).when(value.isNull(), F.lit(f"not of type {kind}"))
        if strict:
            value = F.when(fault.isNotNull(), F.raise_error(F.concat(F.lit(f"column {f.name}: "), fault)).cast(kind)).otherwise(value)
        value = F.when(~empty, value)
        cells.append((value if f.nullable else F.coalesce(value, F.lit(_DEFAULT[kind]))).cast(kind).alias(f.name))
        faults.append(F.when(fault.isNotNull(), F.struct(F.lit(i).alias("col"), F.lit(f.name).alias("col_name"), F.col(f"`{f.name}`").alias("cell_value"), fault.alias("message"))))
    # Spark refuses a query that needs no column but the corrupt record's.
    good = F.col("_corrupt").isNull() & (F.coalesce(F.length(F.col(f"`{schema[0].name}`")), F.lit(0)) >= 0)
    if strict:
        good = F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("wrong number of fields: "), F.col("_corrupt"))).cast("boolean"))
    rows = raw.filter(good).select(*cells)
    found = F.when(F.col("_corrupt").isNotNull(), F.array(F.struct(F.lit(None).cast("int").alias("col"), F.lit(None).cast("string").alias("col_name"), F.lit(None).cast("string").alias("cell_value"), F.lit("wrong number of fields").alias("message")))).otherwise(F.array_compact(F.array(*faults)))
    record = F.coalesce("_corrupt", F.concat_ws(delimiter, *[F.col(f"`{f.name}`") for f in schema]))
    blocks = placed.groupBy("_file", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).select("_file", "_block", "_before")
    errors = placed.select("_file", "_block", "_at", record.alias("record"), F.explode(found).alias("e")).join(blocks, ["_file", "_block"])
    errors = errors.select(F.col("_file").alias("file"), (F.col("_at") + F.col("_before")).alias("row"), "record", "e.*")
    return CsvResult(rows, errors if max_errors is None else errors.orderBy("file", "row", "col").limit(max_errors))


def write_csv_sample(df: DataFrame, path: str, rows: int | None = None) -> None:
    """The table, or its first rows, as CSV with a header."""
    (df if rows is None else df.limit(rows)).write.mode("overwrite").csv(path, header=True)


def concatenated(parts: list[DataFrame]) -> DataFrame:
    """Rows of several tables, one after the other."""
    return reduce(DataFrame.unionByName, parts)
