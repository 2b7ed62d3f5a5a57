"""Near-duplicate passages by compact windows.

A document is the sequence of its word shingles. Under one hash function, the subsequences of at least
the shortest length that share their least hash form compact windows: a node of the Cartesian tree over
the hashes is the window [l, r] with its least hash at c, and stands for all subsequences that begin in
[l, c] and end in [c, r]. Windows too short to hold a passage are cut off, so a document has about
2 n / length of them for each of HASHES functions.

Windows of different documents with one least hash meet in its first document (within a cell of
documents first, so that a passage that a third of the documents share doesn't meet in one task). Where
a document repeats a hash, each of its windows meets the stretch that the first document's windows with
it span. For two documents that meet, the windows' intervals are joined: where at least NEED hash functions agree on
an interval long enough, it is compared word by word: the shared shingles form runs, and a run (or what
remains when it is parted at its gaps) is a passage if it and its counterpart have a Jaccard similarity
of 0.8 or more and SHORTEST words.

Documents that the first one leaves apart (it has only a frequent line of their passage) meet in a second
step: a window that met is keyed by its least hash together with each STEP-th shingle beside it that no
verified passage covers, and windows of one key meet in the first document that has it. A passage holds
such a place wherever it goes beyond the line, so a window gives at most 2 length / STEP rows and no list
is paired with itself.

Defined cases: a null, empty or short text has no passage; rows that repeat a doc_id are one document,
whose passages are taken from all of them; repeats within a document don't count; rows with a null doc_id
give rows without passages; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _A, _B, _SEP, SHINGLE, SIMILAR, dealt, hashed_words, mix, opened, run_hashes, slices, small_or_shuffled, squeezed, stored

#: Words of the shortest passage; hash functions, and how many must agree.
SHORTEST, HASHES, NEED = 50, 6, 2
CELL_BYTES, BUCKET = 14 << 20, 1_500_000
#: Shingles between two shared ones that a run bridges.
GAP = SHINGLE + 3
#: Shingles from one place beside a least hash to the next that the second step looks at.
STEP = 3
#: Shingles from which a text's windows are found without walking the tree, which repeats make deep.
LONG = 4096


def _sliding(x: np.ndarray, n: int, of: np.ufunc, fill: int) -> np.ndarray:
    """of (minimum or maximum) over the n values from each place on, fill behind the last: from the running
    ones forth and back within blocks of n."""
    blocks = np.full((-(-len(x) // n) + 1) * n, fill, dtype=x.dtype)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, n)
    back = of.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    forth = of.accumulate(blocks, axis=1).ravel()
    return of(back[: len(x)], forth[n - 1 : n - 1 + len(x)])


def _long_windows(a: np.ndarray, shortest: int) -> np.ndarray:
    """The compact windows of a long text: only a least value of shortest neighbours has one, and the values that
    end it are of this kind as well, so one stack over these does, however often values repeat."""
    least = _sliding(a, shortest, np.minimum, int(np.iinfo(a.dtype).max))
    least[len(a) - shortest + 1 :] = 0  # of no whole window
    at = np.flatnonzero(_sliding(least[::-1], shortest, np.maximum, 0)[::-1] == a)
    values, places, stack = a[at].tolist(), at.tolist(), []
    ls, rs = [0] * len(at), [len(a) - 1] * len(at)
    for i, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            rs[stack.pop()] = places[i] - 1
        if stack:
            ls[i] = places[stack[-1]] + 1
        stack.append(i)
    out = np.array([ls, places, rs], dtype=np.int64).T
    return out[out[:, 2] - out[:, 0] + 1 >= shortest]


def compact_windows(a: np.ndarray, shortest: int, long: int = LONG) -> np.ndarray:
    """Rows (l, c, r) of the nodes of the Cartesian tree over a that are at least shortest long."""
    if len(a) > max(long, shortest):
        return _long_windows(a, shortest)
    out, todo = [], [(0, len(a))]
    while todo:
        l, r = todo.pop()
        while r - l >= shortest:
            c = l + int(a[l:r].argmin())
            out.append((l, c, r - 1))
            if c - l >= shortest:
                todo.append((l, c))
            l = c + 1
    return np.array(out, dtype=np.int64).reshape(-1, 3)


def _runs(texts: pa.Array) -> Iterator[np.ndarray]:
    """The shingle hashes of each text, in order; none of texts of fewer words."""
    for _, _, data, edges in slices(texts):
        bounds, h = hashed_words(data, edges)
        runs = run_hashes(h)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield runs[a : max(a, b - SHINGLE + 1)]


_FIELDS = ("v", "doc", "l", "r")


def _stars(v, doc, l, r, *rest) -> tuple[tuple[np.ndarray, ...], np.ndarray, tuple[np.ndarray, ...]]:
    """The windows sorted by (v, doc); which of them belong to the first document of their v; and for each of
    the others that document and from where to where its windows with that v reach."""
    order = np.lexsort((doc, v))
    v, doc, l, r, *rest = (x[order] for x in (v, doc, l, r, *rest))
    first = np.ones(len(v), dtype=bool)
    begin = np.flatnonzero(np.concatenate([first[:1], v[1:] != v[:-1]]))
    n = np.diff(np.append(begin, len(v)))
    at, begin, n = np.flatnonzero(np.repeat(n > 1, n)), begin[n > 1], n[n > 1]  # most windows are alone
    if not len(at):
        return (v, doc, l, r, *rest), first, (doc[:0], l[:0], r[:0])
    own, heads = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
    head = doc[begin][own]
    first[at] = same = doc[at] == head
    low = np.minimum.reduceat(np.where(same, l[at], np.iinfo(np.int64).max), heads)[own]
    high = np.maximum.reduceat(np.where(same, r[at], -1), heads)[own]
    return (v, doc, l, r, *rest), first, (head[~same], low[~same], high[~same])


def _blocks(shortest: int, hashes: int, buckets: int):
    seeds = [mix(np.array([977 + j], dtype=np.uint64))[0] for j in range(hashes)]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CELL_BYTES, "right")))
                ids, vs, docs, spans = batch.column(0).slice(at, stop - at).to_pylist(), [], [], []
                for doc, run in zip(ids, _runs(batch.column(1).slice(at, stop - at)), strict=True):
                    if doc is None or len(run) < shortest:
                        continue
                    for seed in seeds:
                        a = mix(run ^ seed)
                        w = compact_windows(a, shortest)
                        vs.append(a[w[:, 1]])
                        docs.append(np.full(len(w), doc))
                        spans.append(w)
                at = stop
                if not vs:
                    continue
                w = np.concatenate(spans)
                (v, doc, l, r), first, star = _stars(np.concatenate(vs), np.concatenate(docs), w[:, 0], w[:, 2])
                met = ~first
                rows = [(-1, [x[met] for x in (v, doc, l, r)], list(star))] if met.any() else []
                v, doc, l, r = (x[first] for x in (v, doc, l, r))
                rows += [(b, [x[own] for x in (v, doc, l, r)], []) for b, own in dealt(((v >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64), buckets)]
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array([abs(int(v[0] % np.uint64(buckets))) if b < 0 else b for b, _, _ in rows], pa.int64()), "local": pa.array([b < 0 for b, _, _ in rows]),
                    **{n: pa.array([x[1][i].tobytes() if i == 0 else squeezed(x[1][i]) for x in rows], pa.binary()) for i, n in enumerate(_FIELDS)},
                    **{f"first_{n}": pa.array([squeezed(x[2][i]) if x[2] else None for x in rows], pa.binary()) for i, n in enumerate(_FIELDS[1:])},
                })

    return of


BLOCKS = "bucket long, local boolean, v binary, doc binary, l binary, r binary, first_doc binary, first_l binary, first_r binary"
MEETINGS = "doc long, l int, r int, other long, ol int, orr int, hash long"


def _meet(pdf: pd.DataFrame) -> pd.DataFrame:
    out = []
    # In the second step v are keys, and hash has what tells the least hashes apart.
    hashes = (lambda x: opened(x.hash)) if "hash" in pdf else (lambda x: np.frombuffer(x.v, np.int64))
    for x in pdf[pdf["local"]].itertuples():
        out.append((*(opened(b) for b in (x.doc, x.l, x.r, x.first_doc, x.first_l, x.first_r)), hashes(x)))
    rest = pdf[~pdf["local"]]
    if len(rest):
        v = np.concatenate([np.frombuffer(b, np.uint64) for b in rest["v"]])
        order = np.argsort(v)
        again = np.concatenate([[False], v[order[1:]] == v[order[:-1]]])
        order = order[again | np.append(again[1:], False)]  # without windows that are alone
        cols = [np.concatenate([opened(b) for b in rest[n]])[order] for n in _FIELDS[1:]]
        (_, doc, l, r, h), first, star = _stars(v[order], *cols, np.concatenate([hashes(x) for x in rest.itertuples()])[order])
        out.append((*(x[~first] for x in (doc, l, r)), *star, h[~first]))
    return pd.DataFrame({n: np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i, n in enumerate(("doc", "l", "r", "other", "ol", "orr", "hash"))}).drop_duplicates()


def _unmix(x: np.ndarray) -> np.ndarray:
    """What mix made x of."""
    x = (x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))) * np.uint64(pow(int(_B), -1, 1 << 64))
    x = (x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))) * np.uint64(pow(int(_A), -1, 1 << 64))
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


def _beside(shortest: int, hashes: int, buckets: int):
    """Blocks of the second step: for each least hash of a document (doc, spans, text; and the hashes with
    from where to where their windows reach), and each place beside it that no verified passage covers, a
    key of the hash, the distance and the shingle."""
    seeds = np.concatenate([mix(np.array([977 + j], dtype=np.uint64)) for j in range(hashes)])
    reach = np.arange(1 - shortest, shortest)
    reach = reach[(reach % STEP == 0) & (reach != 0)]
    odd = mix(reach.astype(np.int64).view(np.uint64))

    def keys(doc: int, v: np.ndarray, l: np.ndarray, r: np.ndarray, spans: list[dict] | None, run: np.ndarray) -> tuple[np.ndarray, ...]:
        free = np.ones(len(run), dtype=bool)
        for x in spans or ():
            free[x["start"] : x["start"] + x["words"] - SHINGLE + 1] = False
        # The places of each hash: its shingle under one of the functions.
        q = (_unmix(v)[:, None] ^ seeds).ravel()
        order = np.argsort(q, kind="stable")
        lo = np.searchsorted(q[order], run)
        n = np.searchsorted(q[order], run, "right") - lo
        c = np.repeat(np.arange(len(run)), n)
        own = order[np.arange(len(c)) - np.repeat(np.cumsum(n) - n - lo, n)] // hashes
        held = (c >= l[own]) & (c <= r[own])
        c, own = c[held], own[held]
        p = c[:, None] + reach
        good = (p >= l[own][:, None]) & (p <= np.minimum(r[own], len(run) - 1)[:, None])
        good &= free[np.where(good, p, 0)] if len(run) else False
        i, j = np.nonzero(good)
        at = own[i]
        return mix(mix(v[at] + odd[j]) ^ run[p[i, j]]), np.full(len(i), doc), l[at], r[at], (v[at] >> np.uint64(32)).astype(np.int64)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                docs, spans, windows = part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(3)
                ends = np.concatenate([[0], np.cumsum(pc.list_value_length(windows).to_numpy(zero_copy_only=False))]).tolist()
                l, r, v = (pc.struct_field(pc.list_flatten(windows), i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
                found = []
                for i, run in enumerate(_runs(part.column(2))):
                    w = slice(ends[i], ends[i + 1])
                    found.append(keys(docs[i], v[w].view(np.uint64), l[w], r[w], spans[i], run))
                if not sum(len(k[0]) for k in found):
                    continue
                (v, doc, l, r, h), first, star = _stars(*(np.concatenate(c) for c in zip(*found, strict=True)))
                met = np.flatnonzero(~first)
                if len(met):  # of a window's keys that meet one document, one
                    order = np.lexsort((*star[::-1], h[met], r[met], l[met], doc[met]))
                    cols = [*(x[met][order] for x in (doc, l, r, h)), *(x[order] for x in star)]
                    order = order[np.concatenate([[True], np.any([x[1:] != x[:-1] for x in cols], axis=0)])]
                rows = [(-1, [x[met][order] for x in (v, doc, l, r, h)], [x[order] for x in star])] if len(met) else []
                v, doc, l, r, h = (x[first] for x in (v, doc, l, r, h))
                rows += [(b, [x[own] for x in (v, doc, l, r, h)], []) for b, own in dealt((v % np.uint64(buckets)).astype(np.int64), buckets)]
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array([int(x[0][0] % np.uint64(buckets)) if b < 0 else b for b, x, _ in rows], pa.int64()), "local": pa.array([b < 0 for b, _, _ in rows]),
                    **{n: pa.array([x[1][i].tobytes() if i == 0 else squeezed(x[1][i]) for x in rows], pa.binary()) for i, n in enumerate(_FIELDS)},
                    **{f"first_{n}": pa.array([squeezed(x[2][i]) if x[2] else None for x in rows], pa.binary()) for i, n in enumerate(_FIELDS[1:])},
                    "hash": pa.array([squeezed(x[1][4]) for x in rows], pa.binary()),
                })

    return of


def agreed(pair: np.ndarray, l: np.ndarray, r: np.ndarray, ol: np.ndarray, orr: np.ndarray, v: np.ndarray, shortest: int, need: int) -> tuple[np.ndarray, ...]:
    """Of windows of many pairs of documents (pair, from, to, the other's from and to, hash): pair, from, to, and the
    other's from and to, of the intervals of at least shortest places that windows of need distinct hashes hold
    at every place; neighbours are joined."""
    if not len(pair):
        return (pair,) * 5
    room = int(r.max()) + 3  # between the places of one pair and those of the next
    # Windows of one hash that touch are one.
    order = np.lexsort((l, v, pair))
    p, h, at = pair[order], v[order], pair[order] * room + l[order]
    group = np.cumsum(np.concatenate([[0], (p[1:] != p[:-1]) | (h[1:] != h[:-1])]))
    reach = np.maximum.accumulate(group * room + r[order])
    new = np.ones(len(p), dtype=bool)
    new[1:] = (group * room + l[order])[1:] > reach[:-1] + 1
    begin = np.flatnonzero(new)
    stop = (reach - group * room + p * room)[np.append(begin[1:], len(p)) - 1] + 1
    # Places from which the number of hashes changes, and the stretches where it is enough.
    places, where = np.unique(np.concatenate([at[begin], stop]), return_inverse=True)
    live = np.cumsum(np.bincount(where, np.repeat([1, -1], len(begin)), len(places)).astype(np.int64)) >= need
    before = np.concatenate([[False], live[:-1]])
    lo, hi = places[live & ~before], places[~live & before]
    long = hi - lo >= shortest
    lo, hi = lo[long], hi[long]
    # What the windows that reach into a stretch hold of the other document.
    first = np.searchsorted(hi, pair * room + l, "right")
    n = np.maximum(np.searchsorted(lo, pair * room + r, "right") - first, 0)
    own = np.repeat(np.arange(len(pair)), n)
    to = np.arange(len(own)) - np.repeat(np.cumsum(n) - n - first, n)
    order = np.argsort(to, kind="stable")
    heads = np.searchsorted(to[order], np.arange(len(lo)))
    least, most = (f.reduceat(x[own[order]], heads) if len(lo) else x[:0] for f, x in ((np.minimum, ol), (np.maximum, orr)))
    return lo // room, lo % room, (hi - 1) % room, least, most


def passages(a: np.ndarray, b: np.ndarray, a_at: int, b_at: int, shortest: int) -> list[tuple[int, int, int, int]]:
    """Passages (from, shingles, the other's from, shingles) of two stretches of shingle hashes: runs of
    shared shingles that are similar as sets. A run that isn't is parted at its widest gap."""
    order = np.argsort(b, kind="stable")
    lo, hi = np.searchsorted(b[order], a), np.searchsorted(b[order], a, "right")
    hit = np.flatnonzero(hi > lo)
    if not len(hit):
        return []
    # Of the places where the other has a shingle, that next to the place before; but where none goes on
    # from there, the one that leads to the next shingle with a single place.
    at = hit.tolist()
    single = np.where((hi - lo)[hit] == 1, np.arange(len(hit)), len(hit))
    ahead = np.minimum.accumulate(single[::-1])[::-1].tolist()
    place = order[lo[hit]]
    for i in np.flatnonzero((hi - lo)[hit] > 1).tolist():
        p = at[i]
        s = order[lo[p] : hi[p]]
        off = np.abs(s - place[i - 1] - (p - at[i - 1])) if i else None
        k = 0 if off is None else off.argmin()
        if (off is None or off[k]) and ahead[i] < len(hit):
            q = at[ahead[i]]
            leads = np.flatnonzero(s == order[lo[q]] - (q - p))
            k = leads[0] if len(leads) else k
        place[i] = s[k]
    gap = np.diff(hit) - 1 + np.abs(np.diff(place) - np.diff(hit))
    out, todo = [], [(i, j) for i, j in zip([0, *(np.flatnonzero(gap > GAP) + 1).tolist()], [*(np.flatnonzero(gap > GAP) + 1).tolist(), len(hit)], strict=True)]
    while todo:
        i, j = todo.pop()
        if hit[j - 1] - hit[i] + 1 < shortest:
            continue
        begin, end = place[i:j].min(), place[i:j].max()
        x, y = a[hit[i] : hit[j - 1] + 1], b[begin : end + 1]
        alike = len(x) == len(y) and bool((x == y).all())
        if not alike:
            u, w = np.unique(x), np.unique(y)
            same = len(np.intersect1d(u, w, assume_unique=True))
            alike = 100 * same >= SIMILAR * (len(u) + len(w) - same)
        if alike:
            out.append((int(hit[i]) + a_at, len(x), int(begin) + b_at, len(y)))
        elif j - i > 1 and gap[i : j - 1].max() > 0:
            cut = i + 1 + int(gap[i : j - 1].argmax())
            todo += [(i, cut), (cut, j)]
    return sorted(out)


def _agree(shortest: int, need: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                windows = part.column(2)
                pair = np.repeat(np.arange(len(part)), pc.list_value_length(windows).to_numpy(zero_copy_only=False))
                x = pc.list_flatten(windows)
                cols = (pc.struct_field(x, i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5))
                own, *span = agreed(pair, *cols, shortest, need)
                values = np.array(span, dtype=np.int32).T.ravel()
                spans = pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, 4), pa.int32()), pa.array(values))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own)), part.column(1).take(pa.array(own)), spans], names=["doc", "other", "span"])

    return of


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each span of a document, instead of its text."""
    for batch in batches:
        done, pieces = 0, []
        spans = batch.column(2).to_pylist()
        for at, stop, data, edges in slices(batch.column(3)):
            shut = np.ones(len(data) + 1, dtype=bool)  # before a byte
            shut[1:] = _SEP[data]
            shut[edges] = True
            word = ~_SEP[data]
            first = np.flatnonzero(word & shut[:-1])
            shut[:-1] = _SEP[data]
            shut[-1] = True
            shut[edges] = True
            last = np.flatnonzero(word & shut[1:]) + 1
            bounds = np.searchsorted(first, edges)
            n = [len(x) for x in spans[at:stop]]
            flat = np.array([x[:2] for own in spans[at:stop] for x in own], dtype=np.int64).reshape(-1, 2)
            begin = np.minimum(np.repeat(bounds[:-1], n) + flat[:, 0], np.repeat(bounds[1:], n))
            end = np.maximum(np.minimum(np.repeat(bounds[:-1], n) + flat[:, 1] + SHINGLE, np.repeat(bounds[1:], n)), begin)
            full = end > begin
            lo, hi = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64)
            lo[full], hi[full] = first[begin[full]], last[end[full] - 1]
            raw = data.tobytes()
            pieces += [raw[i:j] for i, j in zip(lo.tolist(), hi.tolist(), strict=True)]
            done = stop
        ends = np.cumsum([0, *(len(x) for x in spans[:done])])
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pieces, pa.binary()))], names=["doc", "other", "spans", "pieces"])


def _compare(shortest: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                cols = [part.column(j).to_pylist() for j in range(3)]
                pieces = _runs(pc.list_flatten(part.column(3)))
                for d, o, spans, b in zip(*cols, _runs(part.column(4)), strict=True):
                    for (x, _, ox, oy), a in zip(spans, itertools.islice(pieces, len(spans)), strict=True):
                        rows += [(d, s, n + SHINGLE - 1, o, t, m + SHINGLE - 1) for s, n, t, m in passages(a, b[ox : oy + 1], x, ox, shortest)]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc", "start", "words", "other", "other_start", "other_words"])

    return of


def repeats(docs: DataFrame, shortest: int = SHORTEST, hashes: int = HASHES, need: int = NEED) -> DataFrame:
    """Verified passages: doc, start, words (from 0, in words) and the same of another document.
    A passage is given for each document that has it but one, together with one of the others."""
    n = shortest - SHINGLE + 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    size = rows.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    buckets = max(8, -(-size * 2 * hashes // (6 * n * BUCKET)))  # a word has about six bytes
    blocks = rows.mapInArrow(_blocks(n, hashes, buckets), BLOCKS)
    met = stored(_together(blocks), "met")
    found = _verified(met, rows, n, need)
    # Second step: what no passage covers of windows that met, by the shingles beside their least hash.
    # Lists of two documents are done.
    w = met.select("doc", "other", F.explode("w").alias("x")).select("doc", "other", "x.*")
    lists = stored(w.groupBy("hash").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).filter("a < b").select("hash"), "lists")
    w = w.join(small_or_shuffled(lists, lists.count()), "hash", "left_semi")
    w = w.select("doc", "l", "r", "hash").union(w.select("other", "ol", "orr", "hash"))
    w = w.groupBy("doc", "hash").agg(F.min("l").alias("l"), F.max("r").alias("r"))
    spans = found.select("doc", "start", "words").union(found.select("other", "other_start", "other_words"))
    spans = spans.groupBy("doc").agg(F.collect_set(F.struct("start", "words")).alias("spans"))
    covered = F.expr(f"exists(spans, x -> x.start <= l and x.start + x.words - {SHINGLE} >= r)")
    w = w.join(spans, "doc", "left").filter(~F.coalesce(covered, F.lit(False)))
    w = stored(w.groupBy("doc").agg(F.first("spans").alias("spans"), F.collect_list(F.struct("l", "r", "hash")).alias("windows")), "open")
    open_ = _of(rows, w.select("doc")).join(w, "doc").select("doc", "spans", "text", "windows")
    more = _together(open_.mapInArrow(_beside(n, hashes, buckets), BLOCKS + ", hash binary"))
    return found.unionByName(_verified(more, rows, n, need))


def _together(blocks: DataFrame) -> DataFrame:
    """doc, other, and the windows w with which they meet."""
    met = blocks.groupBy("bucket").applyInPandas(_meet, MEETINGS)
    return met.groupBy("doc", "other").agg(F.collect_list(F.struct("l", "r", "ol", "orr", "hash")).alias("w"))


def _of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows with these ids (a column of the same name), so that no other texts are shuffled."""
    ids = stored(ids.distinct(), "needed")
    return rows.join(small_or_shuffled(ids, ids.count()), ids.columns[0], "left_semi")


def _verified(met: DataFrame, rows: DataFrame, n: int, need: int) -> DataFrame:
    met = met.filter(F.size(F.array_distinct("w.hash")) >= need)  # as many as the document has windows
    spans = stored(met.mapInArrow(_agree(n, need), "doc long, other long, span array<int>"), "agreed")
    spans = spans.groupBy("doc", "other").agg(F.collect_list("span").alias("spans"))
    spans = stored(spans, "spans")
    # Of a document only the words of its spans go on to the other one.
    mine = spans.join(_of(rows, spans.select("doc")), "doc").select("doc", "other", "spans", "text")
    mine = mine.mapInArrow(_cut, "doc long, other long, spans array<array<int>>, pieces array<binary>")
    theirs = _of(rows.select(F.col("doc").alias("other"), F.col("text").alias("other_text")), spans.select("other"))
    both = mine.join(theirs, "other")
    kinds = ", ".join(f"{c} long" for c in ("doc", "start", "words", "other", "other_start", "other_words"))
    return stored(both.select("doc", "other", "spans", "pieces", "other_text").mapInArrow(_compare(n), kinds), "passages")


def repeated(docs: DataFrame, shortest: int = SHORTEST, hashes: int = HASHES, need: int = NEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every document: doc_id, n_words, n_passages (stretches of repeated words), n_repeated (words in
    them), partner_id (the least of the documents that it was compared with and shares one with), repeated."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = repeats(docs, shortest, hashes, need)
    ends = found.select("doc", "start", "words", "other").union(found.select("other", "other_start", "other_words", "doc"))
    ends = ends.groupBy("doc", "start", "words").agg(F.min("other").alias("other"))
    spans = ends.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "words"))).alias("s"), F.min("other").alias("partner_id"))
    total = F.expr("aggregate(s, struct(0L as upto, 0L as n, 0L as k), (a, x) -> struct(greatest(a.upto, x.start + x.words) as upto, a.n + greatest(0L, x.start + x.words - greatest(a.upto, x.start)) as n, a.k + if(x.start > a.upto or a.k = 0, 1L, 0L) as k))")
    spans = spans.withColumn("t", total).select("doc", "partner_id", F.col("t.n").alias("n_repeated"), F.col("t.k").alias("n_passages"))
    words = F.coalesce(F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")), F.lit(0)).cast("long")
    out = docs.select("doc_id", words.alias("n_words")).join(spans, F.col("doc_id") == F.col("doc"), "left")
    return out.select("doc_id", "n_words", F.coalesce("n_passages", F.lit(0)).alias("n_passages"), F.coalesce("n_repeated", F.lit(0)).alias("n_repeated"), "partner_id", F.col("partner_id").isNotNull().alias("repeated"))
