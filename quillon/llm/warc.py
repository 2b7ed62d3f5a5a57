"""WARC archives in ZIP packages: a writer, and a reader that takes records by range.

A package holds stored (not compressed) members: archive/data.warc.gz, with each record a gzip
member of its own, and indexes/index.cdxj, with a line for each record. The reader finds the end
record of the central directory (of ZIP64 where there is one), parses the directory, locates the
stored members' data by their local headers, reads the index, and then reads only the ranges of
records, in runs of neighbouring ones. Nothing is extracted.

Defined cases: a null html is an empty payload; a null url or page_id is written as "-"; of rows
with equal payloads of at least MIN_REVISIT bytes all rows with the largest page_id are responses
and the others revisit it (rows without page_id revisit it too, and are responses where none has
one); repeated rows are records of their own; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, stored

MIN_REVISIT = 1000
#: A package is closed when its records reach so many bytes; the reader takes runs of RUN bytes.
PACKAGE, RUN = 48 << 20, 4 << 20
#: A payload shared by at least this share of all rows goes by broadcast.
HEAVY = 0.001
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_U32 = 0xFFFFFFFF


def filesystem(uri: str):
    """(pyarrow file system, path) of a path or URI; plain paths are local."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


# --- ZIP ------------------------------------------------------------------------------------------


def zip_parts(members: list[tuple[str, list[bytes]]], zip64: bool = False) -> Iterator[bytes]:
    """A package of stored members, each given as its name and blocks. Fields that don't fit 32 bits
    (or all, with zip64) are written as ZIP64 has them."""
    at, central = 0, []
    for name, blocks in members:
        crc, size = 0, 0
        for b in blocks:
            crc, size = zlib.crc32(b, crc), size + len(b)
        key, big = name.encode(), zip64 or size >= _U32
        extra = struct.pack("<HHQQ", 1, 16, size, size) if big else b""
        low = _U32 if big else size
        yield struct.pack("<IHHHHHIIIHH", 0x04034B50, 45 if big else 20, 0x800, 0, 0, 0x21, crc, low, low, len(key), len(extra)) + key + extra
        yield from blocks
        far = zip64 or at >= _U32
        wide = struct.pack("<QQ", size, size) * big + struct.pack("<Q", at) * far
        wide = struct.pack("<HH", 1, len(wide)) + wide if wide else b""
        central.append(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45 if big or far else 20, 0x800, 0, 0, 0x21, crc, low, low, len(key), len(wide), 0, 0, 0, 0, _U32 if far else at) + key + wide)
        at += 30 + len(key) + len(extra) + size
    directory = b"".join(central)
    yield directory
    if zip64 or at >= _U32 or len(central) >= 0xFFFF:
        yield struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, len(central), len(central), len(directory), at)
        yield struct.pack("<IIQI", 0x07064B50, 0, at + len(directory), 1)
        yield struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, _U32, _U32, 0)
    else:
        yield struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, len(central), len(central), len(directory), at, 0)


def zip_members(read, size: int) -> dict[str, tuple[int, int]]:
    """For each stored member of a package where its data begin and their length. read(offset,
    length) gives bytes; size: of the package."""
    tail_at = max(0, size - 65_557)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end record of a central directory")
    entries, length, at = struct.unpack_from("<HII", tail, end + 10)
    if entries == 0xFFFF or length == _U32 or at == _U32:
        sign, _, where, _ = struct.unpack("<IIQI", read(tail_at + end - 20, 20))
        if sign == 0x07064B50:
            wide = read(where, 56)
            if wide[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record where its locator points")
            entries, length, at = struct.unpack_from("<QQQ", wide, 32)
    directory, p, found = read(at, length), 0, {}
    for _ in range(entries):
        if directory[p : p + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, = struct.unpack_from("<H", directory, p + 10)
        packed, full, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", directory, p + 20)
        local, = struct.unpack_from("<I", directory, p + 42)
        name = directory[p + 46 : p + 46 + n_name].decode("utf-8", "replace")
        q, stop = p + 46 + n_name, p + 46 + n_name + n_extra
        while q + 4 <= stop:
            tag, n = struct.unpack_from("<HH", directory, q)
            if tag == 1:
                r = q + 4
                if full == _U32:
                    full, r = struct.unpack_from("<Q", directory, r)[0], r + 8
                if packed == _U32:
                    packed, r = struct.unpack_from("<Q", directory, r)[0], r + 8
                if local == _U32:
                    local = struct.unpack_from("<Q", directory, r)[0]
            q += 4 + n
        if method == 0:
            head = read(local, 30)
            if head[:4] != b"PK\x03\x04":
                raise ValueError(f"no local header of {name}")
            n_name_here, n_extra_here = struct.unpack_from("<HH", head, 26)
            found[name] = (local + 30 + n_name_here + n_extra_here, packed)
        p = stop + n_note
    return found


# --- WARC -----------------------------------------------------------------------------------------


def _clean(s: str) -> str:
    return "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in s) or "-"


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One record; a revisit (refers_to isn't None) has the HTTP head only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'-' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {_clean(url or '-')}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's headers (names in lower case) and, at "http" and "payload", what its block has."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    out: dict = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(out["content-length"])]
    http, _, out["payload"] = block.partition(b"\r\n\r\n")
    out["http"] = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
    return out


def _writer(folder: str, package: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        data: list[bytes] = []
        index: list[str] = []
        at = n = 0

        def close() -> pa.RecordBatch:
            nonlocal data, index, at, n
            name = f"{uuid.uuid4().hex}.wacz"  # each attempt of a task writes files of its own
            with fs.open_output_stream(f"{root}/{name}") as f:
                for b in zip_parts([(DATA, data), (INDEX, ["".join(index).encode()])]):
                    f.write(b)
            done = pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": pa.array([n], pa.int64())})
            data, index, at, n = [], [], 0, 0
            return done

        for batch in batches:
            cols = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                page, url, html, digest, to, is_revisit = (c[i].as_py() for c in cols)
                raw = gzip.compress(record(page, url, html or b"", digest, to if is_revisit else None), 1, mtime=0)
                index.append(f"{_clean(url or '-')} 19700101000000 {json.dumps({'offset': at, 'length': len(raw), 'digest': digest})}\n")
                data.append(raw)
                at, n = at + len(raw), n + 1
                if at >= package:
                    yield close()
        if n:
            yield close()

    return of


def write(pages: DataFrame, folder: str, package: int = PACKAGE) -> DataFrame:
    """Writes one record a row into packages under folder; their paths and counts of records. Only
    the packages of tasks that succeeded are listed."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").cast("binary").alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("n"))
    long = F.col("n") >= MIN_REVISIT
    total = pages.count()
    seen = rows.filter(long).groupBy("digest").agg(F.max("page_id").alias("to"), F.count("*").alias("rows")).filter("rows > 1")
    seen = stored(seen, "warc-seen")
    hot = F.col("rows") >= max(2.0, HEAVY * total)
    rows = rows.join(F.broadcast(seen.filter(hot).select("digest", F.col("to").alias("hot_to"))), "digest", "left")
    # Keys of payloads that few rows share are of one width, so as many as here are about 100 MB; with more of them
    # the rows are shuffled once by digest, texts and all.
    few = seen.filter(~hot).select("digest", "to")
    n_few = few.count()
    rows = rows.join(F.broadcast(few) if n_few <= 1_000_000 else few, "digest", "left")
    to = F.coalesce("hot_to", "to")
    rows = rows.withColumn("refers", to).withColumn("revisit", F.coalesce(long & to.isNotNull() & ~F.col("page_id").eqNullSafe(to), F.lit(False)))
    made = rows.select("page_id", "url", "html", "digest", "refers", "revisit").mapInArrow(_writer(folder, package), "path string, records long")
    return stored(made, "warc-list")


def _locator(run: int):
    return lambda batches: _locate(batches, run)


def _locate(batches: Iterator[pa.RecordBatch], run: int) -> Iterator[pa.RecordBatch]:
    """Runs of records in packages, from their directories and indexes."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            fs, name = filesystem(path)
            with fs.open_input_file(name) as f:
                found = zip_members(lambda at, n, f=f: f.read_at(n, at), f.size())
                (base, _), (at, n) = found[DATA], found[INDEX]
                runs, spans = [], []
                for line in f.read_at(n, at).decode().splitlines():
                    x = json.loads(line.split(" ", 2)[2])
                    spans.append((base + x["offset"], x["length"]))
                    if spans[-1][0] + spans[-1][1] - spans[0][0] >= run:
                        runs.append(spans)
                        spans = []
                if spans:
                    runs.append(spans)
            yield pa.RecordBatch.from_pydict({
                "path": pa.array([path] * len(runs), pa.string()),
                "starts": pa.array([[s for s, _ in r] for r in runs], pa.list_(pa.int64())),
                "lengths": pa.array([[n for _, n in r] for r in runs], pa.list_(pa.int64())),
            })


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, starts, lengths in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            fs, name = filesystem(path)
            with fs.open_input_file(name) as f:
                raw = f.read_at(starts[-1] + lengths[-1] - starts[0], starts[0])
            out: dict[str, list] = {k: [] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload")}
            for s, n in zip(starts, lengths, strict=True):
                x = parse(gzip.decompress(raw[s - starts[0] : s - starts[0] + n]))
                digest, kind, page = x["warc-payload-digest"].removeprefix("sha1:"), x["warc-type"], x["warc-record-id"][10:-1]
                if kind == "response" and hashlib.sha1(x["payload"]).hexdigest() != digest:
                    raise ValueError(f"payload of page {page} in {path} doesn't match its digest")
                row = (None if page == "-" else int(page), int(x["http"]["content-length"]), digest, kind, int(x["warc-refers-to"][10:-1]) if kind == "revisit" else None, x["warc-target-uri"], x["payload"] if kind == "response" else None)
                for c, v in zip(out.values(), row, strict=True):
                    c.append(v)
            kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.string())) for k, v in out.items()], names=list(out))


def read(packages: DataFrame, run: int = RUN) -> DataFrame:
    """The records of the packages in column path; payload is null for revisits."""
    spark = packages.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    runs = packages.select("path").repartition(n).mapInArrow(_locator(run), "path string, starts array<long>, lengths array<long>").repartition(n)
    return runs.mapInArrow(_records, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def archive(pages: DataFrame, folder: str | None = None, package: int = PACKAGE, run: int = RUN) -> DataFrame:
    """Writes pages into packages (below the shared folder unless one is named) and reads them back."""
    return read(write(pages, folder or scratch(pages.sparkSession, "warc"), package), run)
