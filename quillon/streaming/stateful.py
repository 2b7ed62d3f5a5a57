"""Averages whose state goes on from batch to batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class _Ema(StatefulProcessor):
    def __init__(self, order: str, value: str, size: int):
        self.order, self.value, self.alpha = order, value, 2 / (size + 1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("ema", "e double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        e = self.state.get()[0] if self.state.exists() else None
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        values = batch[self.value].astype("float64")
        past = pd.Series([float("nan") if e is None else e])
        out = pd.concat([past, values]).ewm(alpha=self.alpha, adjust=False, ignore_na=True).mean().iloc[1:]
        if len(out) and out.iloc[-1] == out.iloc[-1]:  # a value has come
            self.state.update((float(out.iloc[-1]),))
        yield pd.DataFrame({"key": [key[0]] * len(batch), self.order: batch[self.order].to_numpy(), self.value: values.to_numpy(), "ema": out.to_numpy()})

    def close(self) -> None:
        pass


def stateful_ema(stream: DataFrame, key: str, order: str, value: str, size: int) -> DataFrame:
    """key, order, value, ema of a stream; rows of a batch are taken in order. Needs the RocksDB state store."""
    kinds = dict(stream.dtypes)
    schema = f"key {kinds[key]}, {order} {kinds[order]}, {value} double, ema double"
    return stream.groupBy(key).transformWithStateInPandas(_Ema(order, value, size), outputStructType=schema, outputMode="append", timeMode="none")
