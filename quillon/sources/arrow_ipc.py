"""Arrow IPC files (file and stream format) as a data source, and tables as Arrow."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

_TYPES = (T.IntegerType, T.LongType, T.DoubleType, T.StringType)


def _files(path: str) -> list[str]:
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return [root]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return sorted(f.path for f in system.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File and f.base_name.rpartition(".")[2] in ("arrow", "arrows", "feather"))


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)[0] if "://" in path else fs.LocalFileSystem()


def _open(system, path: str):
    """A reader of either format: files end in a magic word that streams lack."""
    f = system.open_input_file(path)
    try:
        return pa.ipc.open_file(f)
    except pa.ArrowInvalid:
        f.seek(0)
        return pa.ipc.open_stream(f)


@dataclass
class _Batches(InputPartition):
    file: str
    start: int = 0
    stop: int | None = None


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        """One for a few batches of a file, which can be read by number; one for a stream."""
        system, out = _system(self.path), []
        for file in _files(self.path):
            r = _open(system, file)
            n = getattr(r, "num_record_batches", None)
            step = 16
            out += [_Batches(file)] if n is None else [_Batches(file, i, min(n, i + step)) for i in range(0, n, step)]
        return out

    def read(self, partition: _Batches) -> Iterator[pa.RecordBatch]:
        r = _open(_system(self.path), partition.file)
        if partition.stop is None:
            yield from r
        else:
            for i in range(partition.start, partition.stop):
                yield r.get_batch(i)


class _StreamReader(DataSourceStreamReader):
    """Files in the folder, each once, whenever they come and whatever their names; those that come together in the
    order of their names. The offset lists the files seen, so it grows as the folder's listing does."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"seen": []}

    def latestOffset(self) -> dict:
        return {"seen": _files(self.path)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        seen = set(start["seen"])
        return [_Batches(f) for f in end["seen"] if f not in seen]

    def read(self, partition: _Batches) -> Iterator[pa.RecordBatch]:
        r = _open(_system(self.path), partition.file)
        yield from (r.get_batch(i) for i in range(r.num_record_batches)) if hasattr(r, "num_record_batches") else r


@dataclass
class _Written(WriterCommitMessage):
    path: str


class _Writer(DataSourceArrowWriter):
    """A file for each task, under a name of its own for each attempt that no reader takes; the commit renames those of
    the attempts that count. What other attempts leave is never read. overwrite: the files that were there before
    go once all new ones are written."""

    def __init__(self, path: str, schema: T.StructType, overwrite: bool):
        self.path, self.schema, self.overwrite = path, schema, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system = _system(self.path)
        root = self.path.partition("://")[2] and __import__("pyarrow.fs", fromlist=["x"]).FileSystem.from_uri(self.path)[1] or self.path
        system.create_dir(root, recursive=True)
        name = f"{root}/part-{uuid.uuid4().hex}.arrow.tmp"
        schema = to_arrow_schema(self.schema)
        with system.open_output_stream(name) as f, pa.ipc.new_file(f, schema) as w:
            for b in batches:
                w.write_batch(b.cast(schema))
        return _Written(name)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system = _system(self.path)
        try:
            before = _files(self.path) if self.overwrite else []
        except FileNotFoundError:
            before = []
        for m in messages:
            if m:
                system.move(m.path, m.path.removesuffix(".tmp"))
        for name in before:
            system.delete_file(name)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system = _system(self.path)
        for m in messages:
            if m:
                system.delete_file(m.path)


class ArrowFileSource(DataSource):
    """Format "arrow_ipc": option path names a file or folder."""

    @classmethod
    def name(cls) -> str:
        return "arrow_ipc"

    def schema(self) -> T.StructType:
        files = _files(self.options["path"])
        if not files:
            raise FileNotFoundError(f"no Arrow files in {self.options['path']}")
        return from_arrow_schema(_open(_system(self.options["path"]), files[0]).schema)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"])

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], schema, overwrite)


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(ArrowFileSource)
    return spark.read.format("arrow_ipc").load(path)


def write_arrow(df: DataFrame, path: str, mode: str = "append") -> None:
    """Writes files into the folder path, one for each task; mode: append or overwrite."""
    df.sparkSession.dataSource.register(ArrowFileSource)
    df.write.format("arrow_ipc").mode(mode).save(path)


def table_to_arrow(df: DataFrame) -> pa.Table:
    """A small table on the driver; integers, longs, doubles and strings only."""
    if bad := [f.name for f in df.schema if not isinstance(f.dataType, _TYPES)]:
        raise TypeError(f"columns {bad} are of other types than int, bigint, double, string")
    return df.toArrow()


def arrow_to_table(spark: SparkSession, table: pa.Table) -> DataFrame:
    df = spark.createDataFrame(table)
    if bad := [f.name for f in df.schema if not isinstance(f.dataType, _TYPES)]:
        raise TypeError(f"columns {bad} are of other types than int, bigint, double, string")
    return df
