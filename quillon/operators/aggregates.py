"""Aggregates, alone and by groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AGGREGATES = {
    "SUM": lambda c: F.sum(F.col(c).cast("double")), "COUNT": lambda c: F.count("*") if c == "*" else F.count(c),
    "AVG": lambda c: F.avg(F.col(c).cast("double")), "MIN": F.min, "MAX": F.max,
}


def aggregate(df: DataFrame, keys: list[str], specs: list[tuple[str, str, str]]) -> DataFrame:
    """specs: (function, column, output name). Without keys one row; without specs the distinct keys."""
    if not specs:
        return df.select(*keys).distinct()
    return df.groupBy(*keys).agg(*[AGGREGATES[f](c).alias(name) for f, c, name in specs])


def sum_of(df: DataFrame, column: str, name: str = "total") -> DataFrame:
    return df.agg(F.sum(F.col(column).cast("double")).alias(name))


def count_mask(df: DataFrame, mask: Column, name: str = "n") -> DataFrame:
    """How many rows the mask holds for."""
    return df.agg(F.count_if(mask).alias(name))


def group_sum(df: DataFrame, key: str, value: str, name: str = "total") -> DataFrame:
    return df.groupBy(key).agg(F.sum(F.col(value).cast("double")).alias(name))
