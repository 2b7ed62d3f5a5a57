"""Rolling functions over the w rows that end at the current one.

order may be one Column or several in a list (name a unique one last to settle ties); by: what
parts the rows. Without by, Spark brings all rows to one task: operators.windows.rolling spreads
such windows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What an exponential average leaves out of the past weighs less than this.
EMA_REST = 1e-17


def _window(order, by, back: int):
    order = order if isinstance(order, (list, tuple)) else [order]
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(-back, 0)


def sma(x: Column, w: int, order, *by: Column) -> Column:
    """The mean of the frame's rows; at the start there are fewer."""
    return F.avg(x).over(_window(order, by, w - 1))


def rolling_std(x: Column, w: int, order, *by: Column) -> Column:
    """The population standard deviation of the frame's rows; 0 of a single row."""
    return F.stddev_pop(x).over(_window(order, by, w - 1))


def ema_depth(w: int) -> int:
    """How many rows back an average of span w must look, so that the rest weighs nothing."""
    alpha = 2 / (w + 1)
    return 0 if alpha >= 1 else math.ceil(math.log(EMA_REST) / math.log(1 - alpha))


def _fold(x: Column, w: int, frame) -> Column:
    alpha = 2 / (w + 1)
    past = F.collect_list(x.cast("double")).over(frame)
    return F.aggregate(F.slice(past, 2, ema_depth(w) + 1), F.get(past, F.lit(0)), lambda e, v: F.lit(alpha) * v + F.lit(1 - alpha) * e)


def ema(x: Column, w: int, order, *by: Column) -> Column:
    """The exponential average e = a x + (1 - a) e with a = 2 / (w + 1), from the first value on, as
    a fold over the rows that still weigh something. x must have no nulls: with_ema passes over them."""
    return x.cast("double") if w <= 1 else _fold(x, w, _window(order, by, ema_depth(w)))


def with_ema(df: DataFrame, name: str, x: Column, w: int, order, *by: Column) -> DataFrame:
    """df with the exponential average of x as column name. Nulls are passed over: a row's frame is counted in
    values, not in rows, so it has as many whatever lies between; before the first value it is null."""
    order = order if isinstance(order, (list, tuple)) else [order]
    at = f"{name}_at"
    df = df.withColumn(at, F.count(x).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    return df.withColumn(name, _fold(x, w, Window.partitionBy(*by).orderBy(at).rangeBetween(-ema_depth(w), 0))).drop(at)
