"""Scans, filters, gathers, sorts and limits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPARE: dict[str, Callable[[Column, object], Column]] = {
    "GT": lambda c, v: c > v, "GTE": lambda c, v: c >= v, "LT": lambda c, v: c < v,
    "LTE": lambda c, v: c <= v, "EQ": lambda c, v: c == v, "NEQ": lambda c, v: c != v,
}


def scan(table: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A table, or some of its columns."""
    return table.select(*columns) if columns else table


def compact(df: DataFrame, column: str, op: str, value) -> DataFrame:
    """The values of a column that compare so with value."""
    return df.filter(COMPARE[op](F.col(column), F.lit(value))).select(column)


def materialize(df: DataFrame, row_id: str, selection: DataFrame, selected: str) -> DataFrame:
    """The rows of df whose row_id is in the selection."""
    return df.join(selection.select(F.col(selected).alias(row_id)).distinct(), row_id, "left_semi")


def gather(values: DataFrame, row_id: str, indices: DataFrame, index: str) -> DataFrame:
    """For each row of indices the row of values that it points to; an index may come again."""
    return indices.join(values, indices[index] == values[row_id]).drop(values[row_id])


class LazyFilter:
    """A filter whose predicate and columns are known apart: only the selected rows' columns are read."""

    def __init__(self, df: DataFrame, predicate: Column):
        self.df, self.predicate = df, predicate

    def selection(self, row_id: str) -> DataFrame:
        return self.df.filter(self.predicate).select(row_id)

    def materialize(self, *columns: str) -> DataFrame:
        return self.df.filter(self.predicate).select(*(columns or self.df.columns))


def sort(df: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    return df.orderBy(F.col(column).asc() if ascending else F.col(column).desc())


def limit(df: DataFrame, n: int) -> DataFrame:
    if n < 0:
        raise ValueError("a limit isn't negative")
    return df.limit(n)


def top_k(df: DataFrame, column: str, k: int, ascending: bool = True, *ties: str) -> DataFrame:
    """The first k rows by column, then by ties; Spark keeps k rows a task, not all."""
    return df.orderBy(F.col(column).asc() if ascending else F.col(column).desc(), *ties).limit(k)
