"""Packing of tokenised documents into fixed windows by minimum bin slack.

A document is its token ids with the end id behind them, cut into pieces of one window and a rest.
Each task packs the rests of BATCH documents at a time: a window starts from the longest rest, and
a subset-sum dynamic program over the multiset of the remaining lengths (bit s: sum s can be
reached) picks the lengths that fill it closest to its capacity, with their counts backtracked.
Windows that stay short are opened again with the next batch; what a task has left at its end is
packed once more together with that of FAN other tasks.

Defined cases: a null or empty text is the end id alone; repeated rows are documents of their own;
an empty table gives no rows; other columns are ignored; texts of any length are cut, not dropped; bytes
that aren't UTF-8 are replacement characters.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, decoded, raw, slices, stored, trim

WINDOW = 4096
BATCH = 16_384
#: So many tasks' leftovers are packed together.
FAN = 512
#: A worker remembers the ids of at least the CACHE distinct units it met last (at most about twice as many) of at
#: most CHUNK bytes.
CACHE, CHUNK = 100_000, 64
#: Bytes of texts that are worked on together, and rows that go to a worker together.
PART, ROWS = 1 << 20, 1024

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def fill(counts: dict[int, int], lengths: list[int], room: int) -> list[tuple[int, int]]:
    """The multiset of lengths (at most counts[l] of each l) whose sum comes closest to room
    without passing it, as (length, count). lengths: those of counts, longest first."""
    if room <= 0:
        return []
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for n in lengths:
        if n > room:
            continue
        c, take = min(counts[n], room // n), 1
        while c > 0:  # binary splitting of the count
            take = min(take, c)
            steps.append((n, take, reach))
            reach |= reach << (n * take) & mask
            c -= take
            take *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for n, take, before in reversed(steps):
        if not before >> at & 1:
            at -= n * take
            used[n] = used.get(n, 0) + take
    return list(used.items())


def pack(items: list[tuple], window: int = WINDOW) -> Iterator[list[tuple]]:
    """Items whose entry 2 is a length of at most window, as lists that each fit a window."""
    by: dict[int, list[tuple]] = {}
    for x in items:
        by.setdefault(x[2], []).append(x)
    counts = {n: len(v) for n, v in by.items()}
    lengths = sorted(counts, reverse=True)
    while lengths:
        first = lengths[0]
        picked = [by[first].pop()]
        counts[first] -= 1
        for n, c in fill(counts, lengths, window - first):
            picked += [by[n].pop() for _ in range(c)]
            counts[n] -= c
        lengths = [n for n in lengths if counts[n]]
        yield picked


class Chunks:
    """Ids of texts as little-endian 32-bit bytes. The tokenizer drops white space and never joins what a
    blank, tab or line end parts, nor a letter or digit and a mark beside it (an apostrophe may take letters
    behind it), so texts are encoded by such units: each distinct one of a slice is looked up once, and the
    ids of short ones are remembered, those of late longest. It also composes, then lowers letters: small
    letters are made before where that can't make a difference, and other texts are parted at blanks only."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer(self.tokenizer.model)  # for small letters, each word one unit
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.late: dict[bytes, bytes] = {}
        self.early: dict[bytes, bytes] = {}
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, dtype=bool)
        self.ends[[i for v, i in vocab.items() if v.endswith("</w>")]] = True

    def words(self, words: list[str]) -> Iterator[bytes]:
        """Ids of words of small letters, each of which is one unit for the tokenizer and ends in an id
        that ends a word. Many are encoded as one text."""
        if not words:
            return
        ids = np.array(self.plain.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(self.ends[np.minimum(ids, len(self.ends) - 1)]) + 1
        if len(ends) != len(words):  # a word isn't one unit after all
            yield from (_raw_ids(e.ids) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False))
            return
        raw, at = ids.tobytes(), 0
        for end in (4 * ends).tolist():
            yield raw[at:end]
            at = end

    def looked_up(self, units: list[bytes]) -> list[bytes]:
        """The ids of distinct units."""
        out = list(map(self.late.get, units))
        if len(self.late) > CACHE:
            self.early, self.late = self.late, {}
        early, plain, others = self.early.get, [], []
        for i, ids in enumerate(out):
            if ids is None:
                unit = units[i]
                if (ids := early(unit)) is not None:
                    out[i] = self.late[unit] = ids
                elif len(unit) <= CHUNK and max(unit) < 0xCC and (word := unit.decode()).isalpha() and word.islower():  # below U+0300 nothing composes
                    plain.append((i, word))
                else:
                    others.append(i)
        for (i, _), ids in zip(plain, self.words([w for _, w in plain]), strict=True):
            out[i] = self.late[units[i]] = ids
        for at in range(0, len(others), 4096):
            part = others[at : at + 4096]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([units[i].decode() for i in part], add_special_tokens=False), strict=True):
                out[i] = _raw_ids(e.ids)
                if len(units[i]) <= CHUNK:
                    self.late[units[i]] = out[i]
        return out

    def streams(self, texts: pa.Array, end: bytes = b"") -> Iterator[list[bytes]]:
        """The ids of texts (null: none), each with end behind them, by slices of them."""
        if not _is_utf8(texts):
            texts = pa.array([None if t is None else t.encode() for t in decoded(texts)], pa.large_binary())
        for _, _, data, bounds in slices(texts, PART, len(texts)):
            data, starts, of_text = _units(data, bounds)
            units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data)]).dictionary_encode()
            ids = self.looked_up(units.dictionary.to_pylist()) + [end]
            which = np.insert(units.indices.to_numpy(), of_text[1:], len(ids) - 1)
            del data, starts, units
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            n = sizes[which]
            stops = np.cumsum(n)
            places = np.repeat((np.cumsum(sizes) - sizes)[which] - (stops - n), n)
            places += np.arange(len(places))
            raw = np.frombuffer(b"".join(ids), "<u4").take(places).tobytes()
            del ids, which, n, places
            edges = [0, *(4 * stops[of_text[1:] + np.arange(len(bounds) - 1)]).tolist()]
            yield [raw[a:b] for a, b in itertools.pairwise(edges)]

    def ids(self, texts: list[str | None]) -> list[bytes]:
        array = pa.array([None if t is None else t.encode("utf-8", "replace") for t in texts], pa.large_binary())
        return [ids for part in self.streams(array) for ids in part]


def _is_utf8(texts: pa.Array) -> bool:
    data, bounds = raw(texts)
    firsts = bounds[:-1][np.diff(bounds) > 0]
    if len(firsts) and (data[firsts] & 0xC0 == 0x80).any():  # a character across two texts
        return False
    try:
        for at in range(0, len(bounds) - 1, 1024):
            str(data[bounds[at] : bounds[min(at + 1024, len(bounds) - 1)]].data, "utf-8")
    except UnicodeDecodeError:
        return False
    return True


def _units(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of texts without blanks, letters A-Z lowered, the bounds of units in them, and the bounds of each
    text's units."""
    text = data.tobytes()
    plain = np.frombuffer(text.translate(_KIND), np.uint8)
    kinds, small = plain.copy(), np.frombuffer(bytearray(text.translate(_SMALL)), np.uint8)
    del text
    pair = np.flatnonzero((data == 0xCC) | (data == 0xCD))  # marks that a letter may compose with
    special = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))  # <|
    first = np.zeros(len(data) + 1, dtype=bool)
    latin = np.flatnonzero(data[:-1] == 0xC3)  # but for two signs, these are letters
    latin = latin[(data[latin + 1] != 0x97) & (data[latin + 1] != 0xB7)]
    ends = kinds.copy()
    ends[latin + 1] = _LETTER
    kinds[latin] = _LETTER
    a, b = ends[:-1], kinds[1:]
    ascii_b = data[1:] < 0x80
    first[1:-1] = ((a == _LETTER) & ascii_b & (b != _LETTER)) | (((a == _MARK) | (a == _DIGIT)) & (b == _LETTER)) | ((a == _DIGIT) & ascii_b) | (b == _DIGIT)
    for t in np.unique(np.searchsorted(bounds, np.concatenate([pair, special]), "right") - 1).tolist():
        small[bounds[t] : bounds[t + 1]] = data[bounds[t] : bounds[t + 1]]
        first[bounds[t] : bounds[t + 1]] = False
    kept = plain != _BLANK
    first[1:-1] |= ~kept[:-1]
    first[bounds] = True
    starts = np.flatnonzero(first[:-1] & kept)
    places = np.cumsum(kept, dtype=np.int32 if len(kept) < 1 << 31 else np.int64)
    return small[kept], np.append(places[starts].astype(np.int64) - 1, kept.sum()), np.searchsorted(starts, bounds)


_BLANK, _MARK, _LETTER, _DIGIT, _OTHER = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[0x21:0x7F] = _MARK
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KIND[0x30:0x3A] = _DIGIT
_KIND[[0x20, 0x09, 0x0A, 0x0D]] = _BLANK
_KIND[0x27] = _OTHER
_KIND = _KIND.tobytes()
_SMALL = bytes(range(256)).lower()
_PACK = [struct.Struct(f"<{n}I") for n in range(64)]


def _raw_ids(ids: list[int]) -> bytes:
    return _PACK[len(ids)].pack(*ids) if len(ids) < len(_PACK) else b"".join(x.to_bytes(4, "little") for x in ids)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _packer(path: str, window: int, end_id: int):
    tail = end_id.to_bytes(4, "little")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if path not in KEPT:
            KEPT[path] = Chunks(path)
        chunks = KEPT[path]
        trim()
        number = TaskContext.get().partitionId() << 40
        rest: list[tuple] = []

        def rows(sequences: list[list[tuple]], last: bool) -> pa.RecordBatch:
            nonlocal number
            cols: list[list] = [[] for _ in range(8)]
            for seq in sequences:
                at = 0
                for doc, start, n, crc, total in seq:
                    for c, v in zip(cols, (doc, start, n, crc, total, number, at, last), strict=True):
                        c.append(v)
                    at += n
                number += 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if i == 7 else pa.int64()) for i, c in enumerate(cols)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "left_over"])

        for batch in batches:
            ids = iter(batch.column(0).to_pylist())
            for part in chunks.streams(batch.column(1), tail):
                full = []
                for doc, b in zip(itertools.islice(ids, len(part)), part, strict=True):
                    total = len(b) // 4
                    for start in range(0, total, window):
                        piece = b[4 * start : 4 * (start + window)]
                        x = (doc, start, len(piece) // 4, zlib.crc32(piece), total)
                        (full.append([x]) if x[2] == window else rest.append(x))
                if full:
                    yield rows(full, False)
            if len(rest) >= BATCH:
                packed = list(pack(rest, window))
                rest = [x for s in packed if sum(y[2] for y in s) < window for x in s]
                yield rows([s for s in packed if sum(y[2] for y in s) == window], False)
        packed = list(pack(rest, window))
        yield rows([s for s in packed if sum(y[2] for y in s) == window], False)
        yield rows([s for s in packed if sum(y[2] for y in s) < window], True)

    return of


def _again(window: int):
    def of(pdf):
        import pandas as pd

        items = sorted(pdf[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].astype(object).where(lambda d: d.notna(), None).itertuples(index=False, name=None), key=lambda x: (x[2], x[1], x[3], str(x[0])))
        number, out = (1 << 62) + (int(pdf["fan"].iloc[0]) << 40), []
        for i, seq in enumerate(pack(items, window)):
            at = 0
            for x in seq:
                out.append((*x, number + i, at))
                at += x[2]
        return pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]).astype({"doc_id": "Int64"})

    return of


def pack_documents(docs: DataFrame, window: int = WINDOW, end_id: int = 2, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece's place: SCHEMA."""
    path = tokenizer or tokenizer_path()
    pieces = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_packer(path, window, end_id), SCHEMA + ", left_over boolean")
    pieces = stored(pieces, "packed", ROWS)  # pins each task's order and numbers
    again = pieces.filter("left_over").withColumn("fan", (F.shiftright("sequence_id", 40) / FAN).cast("long"))
    again = again.groupBy("fan").applyInPandas(_again(window), SCHEMA)
    return pieces.filter("not left_over").drop("left_over").unionByName(again)
