"""What the operators of this subpackage share: the shared scratch folder, word and shingle
hashing on Arrow batches, and joins that stay even when one key holds a third of the rows."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a near-duplicate shingle, and the similarity (in hundredths) from which two sets link.
SHINGLE = 5
SIMILAR = 80


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where
    that is unset and driver and executors are one process (tests in local mode)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
        if not found:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="shared-"))
            found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; Hadoop removes it when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


_ARROW_ROWS, _ARROW_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes that go to Python at once, about: a longer row goes alone.
ARROW_BYTES = 1 << 20
#: Shuffles of a table that has been written are of no further use.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """df as a written table of the shared folder: its lineage is cut, a lost executor loses
    nothing, and every reader sees the same rows even where df itself isn't deterministic. rows: the
    most that go to Python at once while it is made, where they are long."""
    spark = df.sparkSession
    path = scratch(spark, name)
    before = {k: spark.conf.get(k) for k in (_ARROW_ROWS, _ARROW_BYTES, _CLEANUP)}
    most = int(before[_ARROW_ROWS])
    try:
        spark.conf.set(_ARROW_ROWS, str(min(rows or 10_000, most if most > 0 else 10_000)))
        spark.conf.set(_ARROW_BYTES, str(ARROW_BYTES))
        spark.conf.set(_CLEANUP, "true")
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, each with underscores behind it until no column of df has it."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def count_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A side is broadcast only if its counted rows stay within this many.
BROADCAST_ROWS = 1_000_000


def small_or_shuffled(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if its counted rows are within limit, else as it is (Spark then
    shuffles both sides of the join)."""
    return F.broadcast(df) if rows <= limit else df


#: What a Python worker keeps from task to task, by name.
KEPT: dict[str, object] = {}


def trim() -> None:
    """Gives memory that this Python worker has freed back to the system."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def release() -> None:
    """Drops what earlier stages left in this Python worker; stages that don't use it begin so."""
    KEPT.clear()
    trim()


# --- words and shingles of Arrow batches -------------------------------------------------------

_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings or binaries one after another, null as empty, and the bounds of each. Bytes that
    aren't UTF-8 are taken as they are."""
    kind = texts.type
    if texts.null_count:
        texts = pc.fill_null(texts, pa.scalar(b"" if pa.types.is_binary(kind) or pa.types.is_large_binary(kind) else "", kind))
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(kind) or pa.types.is_large_binary(kind)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def decoded(texts: pa.Array) -> list[str | None]:
    """Strings; bytes that aren't UTF-8 become replacement characters."""
    return [None if b is None else b.decode("utf-8", "replace") for b in texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).to_pylist()]


#: Bytes, and texts, that are worked on together.
SLICE, UNITS = 1 << 19, 1024


def slices(texts: pa.Array, size: int = SLICE, most: int = UNITS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, bytes, bounds) of texts that have about size bytes together, one text at least."""
    data, bounds = raw(texts)
    at = 0
    while at < len(bounds) - 1:
        stop = min(at + most, max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1))
        yield at, stop, data[bounds[at] : bounds[stop]], bounds[at : stop + 1] - bounds[at]
        at = stop


_CHUNK = 1 << 15
_SEP = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_GAPS = _SEP.tobytes()
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD[0])
_BYTE[65:91] = _BYTE[97:123]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % (1 << 64), dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


_BASE = int(_ODD[1])
_UP, _DOWN = _powers(_BASE, _CHUNK), _powers(pow(_BASE, -1, 1 << 64), _CHUNK)


def hashed_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of A-Z-lowered texts, given as raw() does: the bounds of
    each text's words, and the hashes one after another. A word's hash is its bytes' polynomial, mixed,
    from the running sums over a chunk of bytes, so no word is made."""
    starts, hashes, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    while at < len(data):
        size = _CHUNK
        while True:  # up to a place between words
            stop, gaps = min(at + size, len(data)), data[at : at + size].tobytes().translate(_GAPS)
            if stop == len(data):
                break
            stop = max(at + gaps.rfind(1) + 1, int(bounds[np.searchsorted(bounds, stop, "right") - 1]))
            if stop > at:
                break
            size *= 2
        part = data[at:stop]
        n = len(part)
        up, down = (_UP, _DOWN) if n <= _CHUNK else (_powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n))
        edges = bounds[np.searchsorted(bounds, at) : np.searchsorted(bounds, stop, "right")] - at
        sep = np.frombuffer(gaps, bool, n)
        shut = np.ones(n + 1, dtype=bool)
        shut[1:] = sep
        shut[edges] = True
        word = ~sep
        first = np.flatnonzero(word & shut[:-1])
        shut[:-1] = sep
        shut[-1] = True
        shut[edges] = True
        last = np.flatnonzero(word & shut[1:])
        sums = _BYTE.take(part)
        sums *= up[:n]
        np.cumsum(sums, out=sums)
        h = sums[last] - np.where(first > 0, sums[first - 1], np.uint64(0))
        hashes.append(mix(h * down[first]))
        starts.append(first + at)
        at = stop
    return np.searchsorted(np.concatenate(starts), bounds), np.concatenate(hashes)


def run_hashes(h: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of k word hashes, in order; none of fewer."""
    out = np.full(max(0, len(h) - k + 1), np.uint64(k))
    for j in range(k if len(out) else 0):
        out += h[j : len(h) - k + 1 + j] * _ODD[j]
    return mix(out)


#: Bits of a set's elements: enough to tell those of two sets apart. Above them an element has RANK_BITS of
#: its rank by frequency, and above these there is room for the number of one of UNITS sets, so that the
#: sets of many texts are sorted as plain numbers.
ELEMENT_BITS, RANK_BITS = 48, 6
ELEMENT = np.uint64((1 << ELEMENT_BITS) - 1)
#: Bits of an element by which its frequency is counted.
TABLE_BITS = 22


def elements(bounds: np.ndarray, h: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The runs of k words of each text (of fewer words: all of them as one): numbers of the texts, elements."""
    n = np.diff(bounds)
    if k == 1:
        return np.repeat(np.arange(len(n)), n), h[bounds[0] : bounds[-1]] >> np.uint64(64 - ELEMENT_BITS)
    sizes = np.maximum(n - k + 1, 0)
    unit = np.repeat(np.arange(len(n)), sizes)
    flat = run_hashes(h, k)[np.arange(len(unit)) - np.repeat(np.cumsum(sizes) - sizes - bounds[:-1], sizes)]
    for m in range(1, k):
        if len(short := np.flatnonzero(n == m)):
            runs = sum((h[bounds[short] + j] * _ODD[j] for j in range(m)), np.full(len(short), np.uint64(m)))
            unit, flat = np.concatenate([unit, short]), np.concatenate([flat, mix(runs)])
    return unit, flat >> np.uint64(64 - ELEMENT_BITS)


def sets_of(bounds: np.ndarray, h: np.ndarray, k: int = SHINGLE, ranks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct elements of each of at most UNITS texts: the bounds of each, and all after another;
    with ranks (by the first TABLE_BITS bits) by rank first, the rank above the element."""
    unit, flat = elements(bounds, h, k)
    if ranks is not None:
        flat |= ranks.take((flat >> np.uint64(ELEMENT_BITS - TABLE_BITS)).view(np.int64)).astype(np.uint64) << np.uint64(ELEMENT_BITS)
    room = np.uint64(ELEMENT_BITS + RANK_BITS)
    both = np.sort(unit.astype(np.uint64) << room | flat)
    if len(both):
        both = both[np.concatenate([[True], both[1:] != both[:-1]])]
    sizes = np.bincount((both >> room).astype(np.int64), minlength=len(bounds) - 1)
    return np.concatenate([[0], np.cumsum(sizes)]), both & ((np.uint64(1) << room) - np.uint64(1))


def set_keys(bounds: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """A signed 64-bit key of each set, the same for equal sets, with ranks or without; 0 for empty ones."""
    n = np.diff(bounds)
    out = np.zeros(len(n), dtype=np.uint64)
    if len(flat):
        full = n > 0
        out[full] = mix(np.add.reduceat(mix((flat & ELEMENT) + _ODD[1]), bounds[:-1][full]) ^ n[full].astype(np.uint64))
    return out.view(np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


# --- blocks of numbers --------------------------------------------------------------------------


def squeezed(x: np.ndarray) -> bytes:
    """Integers in the narrowest width above the least one, byte by byte (all low bytes first), compressed."""
    import zstandard

    low = int(x.min()) if len(x) else 0
    x = (np.asarray(x) - low).astype(np.uint64) if low else np.asarray(x).astype(np.uint64)
    top = int(x.max()) if len(x) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    planes = x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return bytes([width]) + low.to_bytes(8, "little", signed=True) + zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def opened(b: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[9:]), dtype=np.uint8).reshape(b[0], -1)
    return np.ascontiguousarray(planes.T).view(f"<u{b[0]}").ravel().astype(np.int64) + int.from_bytes(b[1:9], "little", signed=True)


def dealt(where: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """For each bucket that where names the rows that go to it, in their order."""
    order = np.argsort(where.astype(np.uint16 if buckets <= 1 << 16 else np.int64), kind="stable")
    ends = np.searchsorted(where[order], np.arange(buckets + 1))
    return [(b, order[ends[b] : ends[b + 1]]) for b in range(buckets) if ends[b] < ends[b + 1]]


# --- joins and components --------------------------------------------------------------------

#: A key with at least this share of all rows goes by broadcast: there are at most 1/share of them.
HEAVY = 0.001


def attach(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int, how: str = "left") -> DataFrame:
    """rows joined with table (one row a key, with the count of its rows in column weight). The
    heavy keys, at most 1/HEAVY, go by broadcast, so no task gathers the rows of one of them."""
    heavy = F.col(weight) >= max(2.0, HEAVY * total)
    cols = [c for c in table.columns if c not in (key, weight)]
    few = table.filter(heavy).select(key, F.lit(True).alias("_hot"), *[F.col(c).alias(f"_hot_{c}") for c in cols])
    rest = table.filter(~heavy).select(key, F.lit(True).alias("_cold"), *cols)
    rows = rows.join(F.broadcast(few), key, "left")
    rest = rest.withColumnRenamed(key, "_key")
    hot_part = rows.filter("_hot").select(*[c for c in rows.columns if not c.startswith("_hot")], *[F.col(f"_hot_{c}").alias(c) for c in cols])
    cold_part = rows.filter(F.col("_hot").isNull()).drop(*[c for c in rows.columns if c.startswith("_hot")])
    cold_part = cold_part.join(rest, F.col(key) == F.col("_key"), how).drop("_key", "_cold")
    return hot_part.unionByName(cold_part)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, root (the smallest node that it reaches) for every node of the edges, by alternating
    large and small stars. Each round is a written table; nothing is gathered on the driver."""
    e = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = stored(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        if e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty() and e.groupBy("u").count().filter("count > 1").isEmpty():
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
