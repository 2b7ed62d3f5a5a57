"""A table of the newest rows, written batch by batch.

Every append writes a new version: a folder with the rows that are kept, and then a small file that
names the version and how many rows were ever committed. Readers follow that file, so they see
whole batches only. A writer that fails before it leaves the old version in place.
"""

from __future__ import annotations

import json
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

SEQ = "_seq"


def ring_snapshot(df: DataFrame, order: str, max_rows: int) -> DataFrame:
    """The batch form: the max_rows newest rows by order (0: all)."""
    return df.orderBy(F.desc(order)).limit(max_rows) if max_rows else df


class Ring:
    """max_rows: how many rows are kept, 0: all. path: a folder that all executors reach."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, max_rows: int = 0, keep_versions: int = 3):
        self.spark, self.path, self.schema, self.max_rows, self.keep = spark, path.rstrip("/"), schema, max_rows, keep_versions
        self.lock = threading.Lock()
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._io = jvm.org.apache.commons.io.IOUtils
        self._fs.mkdirs(self._path(self.path))

    def _versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path))]
        return sorted(int(n[7:-5]) for n in names if n.startswith("commit-") and n.endswith(".json"))

    def _state(self, version: int | None = None) -> dict:
        found = self._versions()
        if version is None:
            version = found[-1] if found else None
        if version is None:
            return {"version": -1, "committed": 0, "rows": 0, "parts": [], "batches": -1}
        f = self._fs.open(self._path(f"{self.path}/commit-{version:012d}.json"))
        try:
            return json.loads(bytes(self._io.toByteArray(f)).decode())
        finally:
            f.close()

    def _commit(self, state: dict) -> None:
        tmp, to = self._path(f"{self.path}/.commit-{state['version']}.tmp"), self._path(f"{self.path}/commit-{state['version']:012d}.json")
        f = self._fs.create(tmp, True)
        try:
            f.write(bytearray(json.dumps(state).encode()))
        finally:
            f.close()
        if not self._fs.rename(tmp, to):
            raise RuntimeError(f"version {state['version']} was committed by another writer")
        for v in self._versions()[: -self.keep]:
            old = self._state(v)
            self._fs.delete(self._path(f"{self.path}/commit-{v:012d}.json"), False)
            live = {p["dir"] for k in self._versions() for p in self._state(k)["parts"]}
            for p in old["parts"]:
                if p["dir"] not in live:
                    self._fs.delete(self._path(f"{self.path}/{p['dir']}"), True)

    def append(self, batch: DataFrame, order: str | None = None, batch_id: int | None = None) -> int:
        """Adds a batch as a whole and returns the rows committed so far. A batch is a folder of its
        own with its rows numbered; older folders stay as they are until all their rows are too old. A
        batch_id that was already added is passed over."""
        from ..operators.windows import numbered

        with self.lock:
            state = self._state()
            if batch_id is not None and batch_id <= state["batches"]:
                return state["committed"]
            batch = batch.select(*[F.col(f.name).cast(f.dataType) for f in self.schema])
            version, part = state["version"] + 1, f"rows-{state['version'] + 1:012d}"
            if order:
                rows = numbered(batch, order, SEQ, ranges=8)
            else:  # the order in which the batch comes
                rows = batch.withColumn("_at", F.monotonically_increasing_id())
                rows = numbered(rows, "_at", SEQ, ranges=8).drop("_at")
            rows.withColumn(SEQ, F.col(SEQ) + state["committed"]).write.mode("overwrite").parquet(f"{self.path}/{part}")
            n = self.spark.read.parquet(f"{self.path}/{part}").count()
            committed = state["committed"] + n
            parts = [*state["parts"], {"dir": part, "end": committed}]
            if self.max_rows:
                parts = [p for p in parts if p["end"] > committed - self.max_rows]
            self._commit({"version": version, "committed": committed, "rows": min(committed, self.max_rows) if self.max_rows else committed, "parts": parts, "batches": state["batches"] if batch_id is None else batch_id})
            return committed

    def committed_rows(self) -> int:
        """How many rows were ever added."""
        return self._state()["committed"]

    def num_rows(self) -> int:
        return self._state()["rows"]

    def snapshot(self, with_seq: bool = False) -> DataFrame:
        """The rows of the newest version."""
        state = self._state()
        full = T.StructType([*self.schema, T.StructField(SEQ, T.LongType())])
        if not state["parts"]:
            df = self.spark.createDataFrame([], full)
        else:
            df = self.spark.read.schema(full).parquet(*[f"{self.path}/{p['dir']}" for p in state["parts"]])
            if self.max_rows:
                df = df.filter(F.col(SEQ) >= state["committed"] - self.max_rows)
        return df if with_seq else df.drop(SEQ)

    def try_snapshot(self) -> tuple[bool, DataFrame | None]:
        """(True, rows), or (False, None) before the first commit."""
        return (True, self.snapshot()) if self._versions() else (False, None)

    def attach(self, stream: DataFrame, checkpoint: str, order: str | None = None, on_batch=None, **trigger) -> StreamingQuery:
        """Feeds the ring from a stream, each micro-batch once. on_batch gets the rows committed so far."""

        def add(batch: DataFrame, batch_id: int) -> None:
            committed = self.append(batch, order, batch_id)
            if on_batch:
                on_batch(committed)

        return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
