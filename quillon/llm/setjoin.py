"""The exact similarity join of hashed sets that document and line deduplication share.

A unit is a document or a line; its set has the 48-bit hashes of its distinct elements (word shingles, or
words), and its key is a hash of the set, so that equal sets are one class. Two sets link when
100 * |intersection| >= 80 * |union|. Then each of them has at least 80 % of its elements in the other, so
under one global order of elements they share one of each set's first n - ceil(0.8 n) + 1 elements (the
prefix). The order is by rarity: the elements of all texts are counted in one pass, by their first TABLE_BITS
bits, so that the table has one size for any corpus; the order only steers the cost, any gives the same links.

An inverted list has the classes with one prefix element. Classes of a short list meet pairwise, by the
filters of length and place and, for small sets, by bitmaps of their elements (sketches). Of a long list each
class meets a few others only; when their links are known, its classes that they leave apart (strays) are
held against the list's sets in a second step, part by part, within the task that has the part. So no list
is paired with itself, and no pairs but links come out of the second step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ELEMENT, ELEMENT_BITS, SHINGLE, SIMILAR, TABLE_BITS, UNITS, count_partitions, dealt, elements, hashed_words, mix, opened, release, set_keys, sets_of, slices, small_or_shuffled, squeezed, stored

LAST = np.iinfo(np.int64).max
#: Sets of fewer elements link only with equal ones.
LEAST = 4
#: Blocks in which the table of counts is added up.
TABLE_BLOCKS = 256
#: Prefix elements of a bucket, about, and of a cell, in which a class is sent once.
BUCKET, CELL = 1_500_000, 500_000
#: The longest list whose classes all meet: without sketches, and with them; beyond it, or where more than
#: all pairs would be told, a class meets the middle one, those up to NEAR places on, and its nearest.
SHORT, SKETCHED, NEAR = 32, 4096, 4
#: The rank from which an element's list is dealt to several buckets (2 for each doubling of the count).
HOT = 32
#: 64-bit words of the widest sketch in a list; elements of a part of a list in the second step.
WIDEST, PART = 16, 4_000_000
#: Rows of texts, and of sets, that go to Python at once.
TEXTS, SETS = 2000, 500


def _arrow(kinds: dict[str, pa.DataType], rows: int, /, **cols) -> pa.RecordBatch:
    """A batch of so many rows with these columns, the others null."""
    return pa.RecordBatch.from_arrays([pa.array(cols[c], t) if c in cols else pa.nulls(rows, t) for c, t in kinds.items()], names=list(kinds))


def parted(batch: pa.RecordBatch, lines: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc ids, line numbers, hashes of the rows' texts, bounds of words, word hashes) of at most UNITS units
    at a time of a batch with doc_id, text and src. A null doc_id is LAST."""
    ids = pc.fill_null(batch.column(0), LAST).to_numpy(zero_copy_only=False)
    src = batch.column(2).to_numpy(zero_copy_only=False)
    for at, stop, data, edges in slices(batch.column(1)):
        own, line = np.arange(at, stop), np.zeros(stop - at, dtype=np.int32)
        if lines:
            ends = np.flatnonzero(data == 10)
            n = np.diff(np.searchsorted(ends, edges)) + 1
            own, line = np.repeat(own, n), (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
            edges = np.append(np.sort(np.concatenate([edges[:-1], ends + 1])), len(data))
        bounds, h = hashed_words(data, edges)
        for i in range(0, len(own), UNITS):
            part = bounds[i : i + UNITS + 1]
            yield ids[own[i : i + UNITS]], line[i : i + UNITS], src[own[i : i + UNITS]], part - part[0], h[part[0] : part[-1]]


# --- the order of elements ----------------------------------------------------------------------


class _Counts:
    """How often elements occur, by their first TABLE_BITS bits, and how many texts have so many places for them."""

    def __init__(self, k: int):
        self.k, self.some = k, False
        self.total, self.sizes = np.zeros(1 << TABLE_BITS, dtype=np.uint32), np.zeros(65, dtype=np.int64)

    def add(self, bounds: np.ndarray, h: np.ndarray) -> None:
        unit, flat = elements(bounds, h, self.k)
        np.add.at(self.total, (flat >> np.uint64(ELEMENT_BITS - TABLE_BITS)).astype(np.int64), np.uint32(1))
        n = np.bincount(unit, minlength=1)
        self.sizes[:64] += np.bincount(n[n < 64], minlength=64)
        self.sizes[64] += len(flat)
        self.some = True

    def blocks(self) -> list[tuple[int, bytes]]:
        if not self.some:
            return []
        n = len(self.total) // TABLE_BLOCKS
        return [*enumerate(squeezed(self.total[i * n : (i + 1) * n]) for i in range(TABLE_BLOCKS)), (TABLE_BLOCKS, squeezed(self.sizes))]


def _tally(k: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        counts = _Counts(k)
        for batch in batches:
            for _, _, data, edges in slices(batch.column(1)):
                counts.add(*hashed_words(data, edges))
        if blocks := counts.blocks():
            yield pa.RecordBatch.from_pydict({"block": pa.array([b for b, _ in blocks], pa.int32()), "counts": pa.array([c for _, c in blocks], pa.binary())})

    return of


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of each block, as ranks; of the sizes, as they are."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = opened(counts)
            sums[block] = sums[block] + x if block in sums else x
    out = [x.tobytes() if b == TABLE_BLOCKS else np.minimum(2 * np.log2(np.maximum(x, 1)), 63).astype(np.uint8).tobytes() for b, x in sums.items()]
    yield pa.RecordBatch.from_pydict({"block": pa.array(sums.keys(), pa.int32()), "ranks": pa.array(out, pa.binary())})


def order(docs: DataFrame, k: int = SHINGLE) -> tuple[np.ndarray, list[int], int]:
    """The rank of elements by how many places of all texts they have (twice the logarithm), how many texts have so
    many places for elements (up to 63), and the places in all."""
    return _ordered(docs.mapInArrow(_tally(k), "block int, counts binary"))


def _ordered(blocks: DataFrame) -> tuple[np.ndarray, list[int], int]:
    table = blocks.repartition(min(64, count_partitions(blocks.sparkSession)), "block").mapInArrow(_added, "block int, ranks binary").toArrow().to_pylist()
    by = {r["block"]: r["ranks"] for r in table}
    if not by:
        return np.zeros(1 << TABLE_BITS, np.uint8), [0] * 64, 0
    *sizes, places = np.frombuffer(by[TABLE_BLOCKS], np.int64).tolist()
    return np.frombuffer(b"".join(by[i] for i in range(TABLE_BLOCKS)), np.uint8), sizes, places


# --- units and prefixes ---------------------------------------------------------------------------


def needed(n: int, m: int) -> int:
    """The least intersection of linked sets of n and m elements."""
    return -(-SIMILAR * (n + m) // (100 + SIMILAR))


def subsets_of(n: int, limit: int) -> list[tuple[int, int]]:
    """(size of the partner, of the shared subset) for partners of at most limit elements."""
    return [(m, needed(n, m)) for m in range(-(-SIMILAR * n // 100), min(limit, 100 * n // SIMILAR) + 1)]


def _subsets(light: int, keys: np.ndarray, bounds: np.ndarray, flat: np.ndarray) -> list[tuple[int, int, int]]:
    """(hash of a fixed-size subset, key, side) of the sets of at most light elements; side: -3 for subsets shared
    by partners of the same size, -1 for the smaller and -2 for the larger of two sizes."""
    from itertools import combinations

    rows, n = [], np.diff(bounds)
    for u in np.flatnonzero((n > 0) & (n <= light)).tolist():
        s, key = flat[bounds[u] : bounds[u + 1]].tolist(), int(keys[u])
        for m, c in subsets_of(len(s), light):
            side = -3 if m == len(s) else -1 if len(s) < m else -2
            rows += [(hash((*x, min(len(s), m), max(len(s), m))), key, side) for x in combinations(s, c)]
    return rows


def widths(n: np.ndarray) -> np.ndarray:
    """64-bit words of a set's sketch: as many bits as elements at least, as far as the widest goes."""
    return np.minimum(1 << np.ceil(np.log2(np.maximum(n, 64) / 64)).astype(np.int64), WIDEST)


def sketches(bounds: np.ndarray, flat: np.ndarray, width: np.ndarray) -> np.ndarray:
    """For each set a bitmap of its elements' low bits, of so many words, all after another. Bits that differ
    between two sets' bitmaps are elements that only one has."""
    at = np.concatenate([[0], np.cumsum(width)])
    n = np.diff(bounds)
    bit = flat & (np.repeat(64 * width, n) - 1).astype(np.uint64)
    out = np.zeros(at[-1], dtype=np.uint64)
    np.bitwise_or.at(out, np.repeat(at[:-1], n) + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out


def _spans(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places at, at + 1, ... of each, n of them, one after another."""
    return np.arange(n.sum()) + np.repeat(at - (np.cumsum(n) - n), n)


_UNITS = "doc long, line int, src long, key long, n int"
_BLOCKS = "bucket long, toks binary, unit binary, pos binary, keys binary, sizes binary, sketch binary"
_SUBSETS = "subset long, skey long, side int"
_TALLIED = "block int, counts binary"
_UNIT_KINDS = {"doc": pa.int64(), "line": pa.int32(), "src": pa.int64(), "key": pa.int64(), "n": pa.int32(), "subset": pa.int64(), "skey": pa.int64(), "side": pa.int32(), "block": pa.int32(), "counts": pa.binary()}
_BLOCK_KINDS = {"bucket": pa.int64(), **{c: pa.binary() for c in ("toks", "unit", "pos", "keys", "sizes", "sketch")}}


def _blocks(cell: list[tuple], buckets: int, sketched: bool, hot_rank: int) -> pa.RecordBatch:
    """A cell's prefixes, each class once, as one block for each bucket: what is known of classes is given once
    for each that a block names. The list of a hot element is dealt by class."""
    tok, unit, pos, key, n, sketch = (np.concatenate(c) for c in zip(*cell, strict=True))
    _, first = np.unique(key, return_index=True)
    new = np.zeros(len(key), dtype=bool)
    new[first] = True
    kept = new[unit]
    tok, unit, pos = tok[kept], unit[kept], pos[kept]
    rank = (tok >> np.uint64(ELEMENT_BITS)).astype(np.int64)
    tok &= ELEMENT
    where = mix(tok)
    if (hot := rank >= hot_rank).any():
        where[hot] += mix(key.view(np.uint64)[unit[hot]]) % (np.uint64(2) << ((rank[hot] - hot_rank) // 2).astype(np.uint64))
        tok[hot] |= np.uint64(1 << 62)
    width = widths(n)
    at = np.cumsum(width) - width
    rows = []
    for b, own in dealt((mix(where) % np.uint64(buckets)).astype(np.int64), buckets):
        own = own[np.argsort(tok[own])]
        units, of = np.unique(unit[own], return_inverse=True)
        t = tok[own].astype(np.int64)
        rows.append((b, squeezed(np.diff(t, prepend=0)), squeezed(of), squeezed(pos[own]), key[units].tobytes(), squeezed(n[units]), sketch[_spans(at[units], width[units])].tobytes() if sketched else b""))
    return _arrow(_BLOCK_KINDS, len(rows), **{c: [r[i] for r in rows] for i, c in enumerate(_BLOCK_KINDS)})


def _units(lines: bool, k: int, light: int, count: bool = False):
    kinds = {c: t for c, t in _UNIT_KINDS.items() if count or c not in ("block", "counts")}

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        told, counts = set(), _Counts(k) if count else None
        for batch in batches:
            for ids, line, src, bounds, h in parted(batch, lines):
                if counts:
                    counts.add(bounds, h)
                bounds, flat = sets_of(bounds, h, k)
                keys, n = set_keys(bounds, flat), np.diff(bounds)
                full = n > 0 if lines else slice(None)
                yield _arrow(kinds, len(keys[full]), doc=ids[full], line=line[full], src=src[full], key=keys[full], n=n[full])
                if light:
                    rows = [r for r in _subsets(light, keys, bounds, flat) if r[1] not in told]
                    if len(told) < 100_000:
                        told.update(r[1] for r in rows)
                    yield _arrow(kinds, len(rows), **{c: [r[i] for r in rows] for i, c in enumerate(("subset", "skey", "side"))})
        if counts and (blocks := counts.blocks()):
            yield _arrow(kinds, len(blocks), block=[b for b, _ in blocks], counts=[c for _, c in blocks])

    return of


def units(docs: DataFrame, lines: bool = False, k: int = SHINGLE, light: int = 0) -> tuple[DataFrame, DataFrame]:
    """(doc, line, src, key, n) of every unit (of lines only those with words), and the subsets of classes of at
    most light elements."""
    both = stored(docs.mapInArrow(_units(lines, k, light), f"{_UNITS}, {_SUBSETS}"), "units", TEXTS)
    return both.filter("doc is not null").select("doc", "line", "src", "key", "n"), both.filter("subset is not null").select("subset", "skey", "side")


def counted_units(docs: DataFrame, lines: bool = False, k: int = SHINGLE) -> tuple[DataFrame, np.ndarray, int]:
    """(doc, line, src, key, n) of every unit as units() has them, and in the same pass over the texts the ranks of
    elements and their places in all, as order() has them."""
    both = stored(docs.mapInArrow(_units(lines, k, 0, True), f"{_UNITS}, {_SUBSETS}, {_TALLIED}"), "units", TEXTS)
    ranks, _, places = _ordered(both.filter("block is not null").select("block", "counts"))
    return both.filter("doc is not null").select("doc", "line", "src", "key", "n"), ranks, places


def _prefixes(lines: bool, k: int, shared, light: int, buckets: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        ranks = shared.value
        cell, size, base = [], 0, 0
        for batch in batches:
            for _, _, _, bounds, h in parted(batch, lines):
                bounds, flat = sets_of(bounds, h, k, ranks)
                keys, n = set_keys(bounds, flat), np.diff(bounds)
                wanted = np.flatnonzero((n >= LEAST) & ((n > light) | (100 * n >= SIMILAR * (light + 1))))
                _, first = np.unique(keys[wanted], return_index=True)
                wanted = wanted[np.sort(first)]
                if not len(wanted):
                    continue
                n = n[wanted]
                prefix = n + (-SIMILAR * n // 100) + 1
                pos = _spans(np.zeros(len(n), np.int64), prefix)
                own = np.concatenate([[0], np.cumsum(n)])
                sketch = sketches(own, flat[_spans(bounds[wanted], n)], widths(n)) if lines else np.zeros(0, np.uint64)
                cell.append((flat[_spans(bounds[wanted], prefix)], np.repeat(np.arange(len(n)) + base, prefix), pos, keys[wanted], n, sketch))
                base += len(n)
                size += len(pos)
                if size >= CELL:
                    yield _blocks(cell, buckets, lines, HOT)
                    cell, size, base = [], 0, 0
        if cell:
            yield _blocks(cell, buckets, lines, HOT)

    return of


# --- lists ------------------------------------------------------------------------------------------


def _possible(n, m, i, j) -> np.ndarray:
    """Length and positional filter: whether sets of n and m elements that share those at places i
    and j can still reach the intersection that they need."""
    need = -(-SIMILAR * (n + m) // (100 + SIMILAR))
    return (np.minimum(i, j) + np.minimum(n - i, m - j) >= need) & (100 * np.minimum(n, m) >= SIMILAR * np.maximum(n, m))


def _apart(sketch: np.ndarray, at: np.ndarray, width: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """At least so many elements are in one only of each pair of sketched sets."""
    out = np.zeros(len(i), dtype=np.int64)
    swap = width[i] > width[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    both = width[i] * 1000 + width[j]
    for kind in np.unique(both):
        w, v = divmod(int(kind), 1000)
        own = np.flatnonzero(both == kind)
        x, y = sketch[at[i[own]][:, None] + np.arange(w)], sketch[at[j[own]][:, None] + np.arange(v)]
        while y.shape[1] > w:
            y = y[:, : y.shape[1] // 2] | y[:, y.shape[1] // 2 :]
        out[own] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return out


_MET = "a long, b long, c long, an long, bn long, tok long, key long"
_MET_KINDS = {x.split()[0]: pa.int64() for x in _MET.split(", ")}
#: What a pair counts that passes whatever it shares.
SURE = 1 << 32


def _by_list(tok: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The places of lists' members, a list after another, by size and then key, without lone ones of cold
    elements. Equal members of a list are beside each other unless another key has the same first bits, which
    only costs a comparison more."""
    order_ = np.argsort(tok)
    t = tok[order_]
    begin = np.flatnonzero(np.concatenate([np.ones(min(1, len(t)), bool), t[1:] != t[:-1]]))
    size = np.diff(np.append(begin, len(t)))
    kept = (size > 1) | (t[begin] >> 62 != 0)
    order_, size = order_[np.repeat(kept, size)], size[kept]
    sizes, of_size = np.unique(n[order_], return_inverse=True)
    high, low = len(size).bit_length(), len(sizes).bit_length()
    both = np.repeat(np.arange(len(size), dtype=np.uint64), size) << np.uint64(64 - high) | of_size.astype(np.uint64) << np.uint64(64 - high - low)
    both |= key[order_].view(np.uint64) >> np.uint64(high + low)
    return order_[np.argsort(both)]


def _meet(sketched: bool):
    """Of a bucket's blocks the pairs (a, b) that the filters leave, with c, the elements of short lists that they
    share, and their sizes; (tok, key) of the classes of lists that aren't done with them; and (a, c), how many of
    these a class is in."""

    def of(table: pa.Table) -> pa.Table:
        cols, offset = [], 0
        words: list[np.ndarray] = []
        for toks, unit, pos, keys, sizes, sketch in zip(*(table.column(c).to_pylist() for c in ("toks", "unit", "pos", "keys", "sizes", "sketch")), strict=True):
            unit, sizes = opened(unit), opened(sizes)
            width = widths(sizes)
            cols.append((np.cumsum(opened(toks)), np.frombuffer(keys, np.int64)[unit], sizes[unit].astype(np.int32), opened(pos).astype(np.int32), (np.cumsum(width) - width)[unit] + offset))
            if sketched:
                words.append(np.frombuffer(sketch, np.uint64))
                offset += len(words[-1])
        tok, key, n, pos, at = (np.concatenate(c) for c in zip(*cols, strict=True))
        del cols
        sketch = np.concatenate(words) if sketched else None
        order_ = _by_list(tok, n, key)
        tok, key = tok[order_], key[order_]
        new = np.ones(len(tok), dtype=bool)
        new[1:] = (tok[1:] != tok[:-1]) | (key[1:] != key[:-1])
        keep = np.flatnonzero(new)
        first = np.ones(len(keep), dtype=bool)
        first[1:] = tok[keep][1:] != tok[keep][:-1]
        size = np.diff(np.append(np.flatnonzero(first), len(keep)))
        hot = tok[keep] >> 62 != 0
        own = keep[(np.repeat(size, size) > 1) | hot]
        tok, key, order_ = tok[own], key[own], order_[own]
        n, pos, at = n[order_], pos[order_], at[order_]
        width, hot = widths(n), tok >> 62 != 0
        begin = np.flatnonzero(np.concatenate([np.ones(min(1, len(tok)), bool), tok[1:] != tok[:-1]]))
        size = np.diff(np.append(begin, len(tok)))
        of_list = np.repeat(np.arange(len(size)), size)
        m = size[of_list]
        all_meet = m <= (SKETCHED if sketched else SHORT)
        tells_all = m <= SHORT
        found: list[np.ndarray] = []
        best, by, degree = np.full(len(tok), LAST), np.full(len(tok), -1), np.zeros(len(tok), np.int64)

        def tell(i: np.ndarray, j: np.ndarray) -> None:
            good = _possible(*(x.astype(np.int64) for x in (n[i], n[j], pos[i], pos[j])))
            i, j = i[good], j[good]
            if sketched:
                far = _apart(sketch, at, width, i, j)
                good = (100 + SIMILAR) * far <= (100 - SIMILAR) * (n[i].astype(np.int64) + n[j])
                i, j, far = i[good], j[good], far[good]
            else:
                far = np.zeros(len(i), np.int64)
            now = tells_all[i] | ~all_meet[i]
            found.append(np.stack([key[i[now]], key[j[now]], np.where(tells_all[i[now]] & (not sketched), 1, SURE), n[i[now]], n[j[now]]]))
            for x, y in ((i[~now], j[~now]), (j[~now], i[~now])):  # of longer lists each class's nearest
                degree[:] += np.bincount(x, minlength=len(degree))
                o = np.lexsort((far[~now], x))
                o = o[np.concatenate([np.ones(min(1, len(o)), bool), x[o][1:] != x[o][:-1]])]
                o = o[far[~now][o] < best[x[o]]]
                best[x[o]], by[x[o]] = far[~now][o], y[o]

        held, count = [], 0
        i, d = np.arange(len(tok)), 1
        while len(i):
            i = i[: np.searchsorted(i, len(tok) - d)]
            if d == NEAR + 1:
                i = i[all_meet[i]]
            i = i[(of_list[i] == of_list[i + d]) & (100 * n[i].astype(np.int64) >= SIMILAR * n[i + d].astype(np.int64))]
            held.append((i, i + d))
            count += len(i)
            d += 1
            if count > 200_000 or not len(i):
                tell(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, count = [], 0
        long = np.flatnonzero(~all_meet)
        if len(long):
            tell(np.minimum((begin + size // 2)[of_list[long]], long), np.maximum((begin + size // 2)[of_list[long]], long))
        x = np.flatnonzero(by >= 0)
        found.append(np.stack([key[x], key[by[x]], np.full(len(x), SURE), n[x], n[by[x]]]))
        a, b, c, an, bn = np.concatenate(found, axis=1)
        swap = a > b
        a, b, an, bn = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, bn, an), np.where(swap, an, bn)
        o = np.lexsort((b, a))
        o = o[a[o] != b[o]]
        a, b, c = a[o], b[o], c[o]
        new = np.flatnonzero(np.concatenate([np.ones(min(1, len(a)), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        a, b, c, an, bn = a[new], b[new], np.add.reduceat(c, new) if len(new) else c, an[o][new], bn[o][new]
        open_ = np.flatnonzero(hot | ~all_meet | (~tells_all & (degree > 1)))
        late, lates = np.unique(key[open_], return_counts=True)
        parts = [_arrow(_MET_KINDS, len(a), a=a, b=b, c=c, an=an, bn=bn), _arrow(_MET_KINDS, len(open_), tok=tok[open_], key=key[open_]), _arrow(_MET_KINDS, len(late), a=late, c=lates)]
        return pa.Table.from_batches(parts)

    return of


def met(docs: DataFrame, ranks: np.ndarray, places: int, lines: bool = False, k: int = SHINGLE, light: int = 0) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of classes that the filters leave, each once, and (tok, key) of the lists that are open. places:
    of elements in all texts. Classes that can only have partners of at most light elements, as they have, are
    left out. Prefixes are shuffled as blocks, one for each cell and bucket of elements."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    buckets = max(8, -(-places * (100 - SIMILAR) // (100 * BUCKET)))
    blocks = docs.mapInArrow(_prefixes(lines, k, shared, light, buckets), _BLOCKS)
    found = stored(blocks.groupBy("bucket").applyInArrow(_meet(lines), _MET), "met", TEXTS)
    pairs = found.filter("b is not null").groupBy("a", "b").agg(F.sum("c").alias("c"), F.first("an").alias("an"), F.first("bn").alias("bn"))
    if not lines:
        # All that two sets share up to the end of the prefix that ends first is among their prefix elements, and
        # what lies beyond is less than 80 % of that set. Elements of open lists count as shared.
        late = found.filter("b is null and a is not null").groupBy("a").agg(F.sum("c").alias("late"))
        for side in ("a", "b"):
            pairs = pairs.join(late.select(F.col("a").alias(side), F.col("late").alias(f"{side}_late")), side, "left")
        least = f"ceil({SIMILAR} * (an + bn) / {100 + SIMILAR}.0) - ceil({SIMILAR} * greatest(an, bn) / 100.0) + 1"
        pairs = pairs.filter(f"c + least(coalesce(a_late, 0), coalesce(b_late, 0)) >= {least}")
    return stored(pairs.select("a", "b"), "pairs"), stored(found.filter("key is not null").select("tok", "key").distinct(), "open")


# --- sets, links ------------------------------------------------------------------------------------


def _fetch(lines: bool, k: int, shared):
    kinds = {"key": pa.int64(), "n": pa.int32(), "items": pa.binary()}

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        ranks = shared.value
        for batch in batches:
            wanted = np.unique(pc.list_flatten(batch.column(3)).to_numpy(zero_copy_only=False))
            seen = np.zeros(0, np.int64)  # in this batch
            for _, _, _, bounds, h in parted(batch, lines):
                bounds, flat = sets_of(bounds, h, k, ranks)
                keys, first = np.unique(set_keys(bounds, flat), return_index=True)
                good = np.isin(keys, wanted) & ~np.isin(keys, seen) & (np.diff(bounds)[first] > 0)
                seen = np.concatenate([seen, keys[good]])
                own = first[good]
                yield _arrow(kinds, len(own), key=keys[good], n=np.diff(bounds)[own], items=[squeezed(np.diff(flat[bounds[i] : bounds[i + 1]].astype(np.int64), prepend=0)) for i in own.tolist()])

    return of


def fetched(keys: DataFrame, units: DataFrame, docs: DataFrame, ranks: np.ndarray, lines: bool = False, k: int = SHINGLE) -> DataFrame:
    """key, n, items (the set) of these classes, made again from one text that has each."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    keys = stored(keys.distinct(), "keys")
    at = units.join(small_or_shuffled(keys, keys.count()), "key", "left_semi").groupBy("key").agg(F.min(F.struct("doc", "src")).alias("x"))
    at = stored(at.groupBy("x.doc", "x.src").agg(F.collect_list("key").alias("keys")), "wanted")  # as many as a text has units
    at = at.withColumnRenamed("src", "_src")
    texts = docs.withColumn("doc", F.coalesce("doc_id", F.lit(LAST)))
    texts = texts.join(small_or_shuffled(at, keys.count()), (texts["doc"] == at["doc"]) & (F.col("src") == F.col("_src")))
    sets = stored(texts.select("doc_id", "text", "src", "keys").mapInArrow(_fetch(lines, k, shared), "key long, n int, items binary"), "found", TEXTS)
    once = sets.groupBy("key").count().filter("count > 1").isEmpty()  # a class may be in several of these texts
    return sets if once else stored(sets.groupBy("key").agg(F.first("n").alias("n"), F.first("items").alias("items")), "sets")


def _opened(items: bytes) -> np.ndarray:
    return np.cumsum(opened(items)).astype(np.uint64)


def _linked(s: np.ndarray, t: np.ndarray) -> bool:
    s, t = (s, t) if len(s) <= len(t) else (t, s)
    at = np.searchsorted(t, s)
    at[at == len(t)] = 0
    same = int((t[at] == s).sum())
    return 100 * same >= SIMILAR * (len(s) + len(t) - same)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = [_linked(_opened(p), _opened(q)) for p, q in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that link."""
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("key").alias(side), F.col("items").alias(f"{side}_items")), side)
    return stored(pairs.select("a", "b", "a_items", "b_items").mapInArrow(_verify, "a long, b long"), "links", SETS)


def _probe(earlier: bool):
    """For rows sorted by (tok, part, probe): each stray (probe 1) with the members of its part (probe 0). earlier:
    the first member found that comes before the stray and links; else one of each other grp."""
    kinds = {"a": pa.int64(), "b": pa.int64()}

    class Members:
        def __init__(self) -> None:
            self.rows: list[tuple] = []
            self.tables: list[tuple] | None = None

        def probe(self, key: int, grp: int, place: tuple, items: np.ndarray) -> Iterator[tuple[int, int]]:
            if self.tables is None:  # by width of the sketch: rows, sketches
                width = [8 * int(widths(np.array([len(r[3])]))[0]) for r in self.rows]
                self.tables = []
                for w in sorted(set(width)):
                    own = [i for i, v in enumerate(width) if v == w]
                    sets = [self.rows[i][3] for i in own]
                    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                    self.tables.append((np.array(own), np.diff(bounds), sketches(bounds, np.concatenate(sets), np.full(len(own), w)).reshape(len(own), w)))
                self.grps, self.keys = np.array([r[1] for r in self.rows]), np.array([r[0] for r in self.rows])
                rank = {p: i for i, p in enumerate(sorted({r[2] for r in self.rows}))}
                self.order, self.places = np.array([rank[r[2]] for r in self.rows]), sorted(rank)
            found, far = [], []
            mine, n = np.array([0, len(items)]), len(items)
            for own, m, table in self.tables:
                near = (100 * np.minimum(m, n) >= SIMILAR * np.maximum(m, n)) & (self.grps[own] != grp) & (self.keys[own] != key)
                if earlier:
                    import bisect

                    near &= self.order[own] < bisect.bisect_left(self.places, place)
                at = np.flatnonzero(near)
                if len(at):
                    d = np.bitwise_count(table[at] ^ sketches(mine, items, np.array([table.shape[1]]))).sum(axis=1, dtype=np.int64)
                    good = (100 + SIMILAR) * d <= (100 - SIMILAR) * (m[at] + n)
                    found.append(own[at[good]])
                    far.append(d[good])
            if not found:
                return
            found = np.concatenate(found)[np.argsort(np.concatenate(far), kind="stable")]
            done: set[int] = set()
            for i in found.tolist():
                other, of, _, its = self.rows[i]
                if of not in done and _linked(its, items):
                    yield other, key
                    if earlier:
                        return
                    done.add(of)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, members = None, Members()
        for batch in batches:
            out = []
            for tok, part, probe, key, grp, doc, line, items in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                if (tok, part) != at:
                    at, members = (tok, part), Members()
                row = (key, grp, (doc, line, key), _opened(items))
                if probe:
                    out += list(members.probe(*row)) if members.rows else []
                else:
                    members.rows.append(row)
            yield _arrow(kinds, len(out), a=[x for x, _ in out], b=[y for _, y in out])

    return of


def second_links(own: DataFrame, sets: DataFrame, earlier: bool) -> DataFrame:
    """Links (a, b) of strays b of open lists with members of the list. own: tok, key, stray, grp, doc, line; those of
    one grp aren't held against each other, and with earlier only what comes before is. A list's members are
    dealt to parts, the strays go to each."""
    sizes = own.join(sets.select("key", "n"), "key")
    sizes = sizes.groupBy("tok").agg(F.sum("n").alias("all"), F.max(F.col("stray").cast("int")).alias("any"), F.count("*").alias("m")).filter("any = 1 and m > 1")
    own = own.join(sizes.select("tok", F.ceil(F.col("all") / PART).alias("parts")), "tok").join(sets, "key")
    rest = ("key", "grp", "doc", "line", "items")
    members = own.select("tok", F.pmod(F.xxhash64("key"), F.col("parts")).alias("part"), F.lit(0).alias("probe"), *rest)
    strays = own.filter("stray").select("tok", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(1).alias("probe"), *rest)
    dealt_ = members.unionByName(strays).repartition(count_partitions(own.sparkSession), "tok", "part").sortWithinPartitions("tok", "part", "probe")
    return stored(dealt_.mapInArrow(_probe(earlier), "a long, b long"), "links", SETS).distinct()
