"""Nearest neighbours by inner product with a hierarchical k-means tree.

The tree is fitted on a bounded sample (FIT_ROWS rows): each node parts its rows in BRANCH by k-means,
down to leaves. For inner products, vectors get one more component that makes all norms equal; the
nearest by distance then is the largest product. Every row is put into a leaf. A query walks the tree
best bin first, with a priority queue by distance to centres, and widens its visit leaf by leaf
until the calibrated number of leaves and enough rows are reached. The calibration takes sample rows as
queries and finds the number of leaves at which their recall among the sample reaches RECALL.

Neighbouring leaves and their visitors meet in groups of bounded size, so a leaf that holds a third of
the rows, or draws a third of the queries, is spread, and each group gives a query's best once.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part, nor do rows without vec_id; of rows that repeat a vec_id one takes
part (the one with the smallest vector); ties go to the smaller vec_id; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

FIT_ROWS, BRANCH, LEAF_ROWS, MAX_LEAVES = 20_000, 8, 200, 4096
RECALL, PROBES = 0.98, 256
BLOCK_ROWS, GROUP_ROWS = 4096, 16_384
#: Queries that a group's rows meet at once, in bytes of their vectors; the rows are sent once for each such block.
QUERY_BYTES = 4 << 20


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Centres of at most k groups."""
    rng = np.random.default_rng(seed)
    c = np.unique(x[rng.choice(len(x), min(k, len(x)), replace=False)], axis=0)
    for _ in range(rounds):
        to = nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, to, x)
        n = np.bincount(to, minlength=len(c))
        c = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(axis=1) - 2 * (x @ c.T), axis=1)


class Tree:
    """children[i]: (centres, nodes) of inner node i; leaf[i]: the number of leaf i, or -1."""

    def __init__(self, x: np.ndarray, leaves: int):
        self.children: list[tuple[np.ndarray, list[int]] | None] = [None]
        self.leaf = [0]
        heap = [(-len(x), 0, np.arange(len(x)))]
        done = 1
        while heap and done < leaves:  # the fullest leaf is parted next
            size, node, rows = heapq.heappop(heap)
            if -size < 2:
                break
            c = kmeans(x[rows], min(BRANCH, leaves - done + 1), seed=node)
            to = nearest(x[rows], c)
            if len(c) < 2 or len(np.unique(to)) < 2:
                continue
            kids = []
            for j in range(len(c)):
                kids.append(len(self.children))
                self.children.append(None)
                own = rows[to == j]
                heapq.heappush(heap, (-len(own), kids[-1], own))
            self.children[node] = (c, kids)
            done += len(c) - 1
        ends = [i for i, c in enumerate(self.children) if c is None]
        self.leaf = [-1] * len(self.children)
        for n, i in enumerate(ends):
            self.leaf[i] = n
        self.leaves = len(ends)

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out, todo = np.zeros(len(x), dtype=np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.children[node] is None:
                out[rows] = self.leaf[node]
                continue
            c, kids = self.children[node]
            to = nearest(x[rows], c)
            todo += [(kid, rows[to == j]) for j, kid in enumerate(kids) if (to == j).any()]
        return out

    def walk(self, q: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        heap = [(0.0, 0)]
        while heap:
            _, node = heapq.heappop(heap)
            if self.children[node] is None:
                yield self.leaf[node]
                continue
            c, kids = self.children[node]
            for d, kid in zip(((c - q) ** 2).sum(axis=1).tolist(), kids, strict=True):
                heapq.heappush(heap, (d, kid))


def lift(x: np.ndarray, most: float) -> np.ndarray:
    """Rows with the component that makes all norms most."""
    return np.hstack([x, np.sqrt(np.maximum(most * most - (x * x).sum(axis=1), 0))[:, None]])


def aim(q: np.ndarray, most: float) -> np.ndarray:
    """Queries, scaled to norm most."""
    return np.hstack([q * (most / np.maximum(np.linalg.norm(q, axis=1), 1e-300))[:, None], np.zeros((len(q), 1))])


def calibrate(tree: Tree, x: np.ndarray, most: float, k: int, recall: float) -> int:
    """Leaves to visit so that rows of x find their k nearest of x with that recall."""
    if len(x) < 2:
        return 1
    at = np.random.default_rng(1).choice(len(x), min(PROBES, len(x)), replace=False)
    leaf, q, k = tree.place(lift(x, most)), aim(x[at], most), min(k, len(x) - 1)
    scores = x[at] @ x.T
    scores[np.arange(len(at)), at] = -np.inf
    best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    found = np.zeros(tree.leaves)
    for i in range(len(at)):
        order = np.empty(tree.leaves, dtype=np.int64)
        order[list(tree.walk(q[i]))] = np.arange(tree.leaves)
        found += np.bincount(order[leaf[best[i]]], minlength=tree.leaves)
    share = np.cumsum(found) / (k * len(at))
    return int(np.argmax(share >= recall)) + 1


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _place(shared):
    def of(batches):
        tree, most, dim, _, _ = shared.value
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(tree.place(lift(_matrix(b.column(1), dim), most)), pa.int32())], names=["vec_id", "v", "leaf"])

    return of


def _visit(shared, layout, k: int):
    """For each query and group of leaves in its walk: the leaves that it visits there."""

    def of(batches):
        tree, most, dim, visits, _ = shared.value
        held, groups = layout.value
        for b in batches:
            if not b.num_rows:
                continue
            rows, group, leaves = [], [], []
            for i, q in enumerate(aim(_matrix(b.column(1), dim), most)):
                n = seen = 0
                own: dict[int, list[int]] = {}
                for x in tree.walk(q):
                    for g in groups[x]:
                        own.setdefault(g, []).append(x)
                    n, seen = n + 1, seen + held[x]
                    if n >= visits and seen > k:
                        break
                rows += [i] * len(own)
                group += list(own)
                leaves += list(own.values())
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(group, pa.int32()), pa.array(leaves, pa.list_(pa.int32()))], names=["query_id", "q", "g", "leaves"])

    return of


def best_of(approx: np.ndarray, q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int) -> list[tuple]:
    """Each query's k best rows (ties: the smaller id) of those with a finite approximate score."""
    out = []
    for i in range(len(q)):
        row = approx[i]
        at = np.flatnonzero(np.isfinite(row))
        if len(at) > k:  # those that rounding leaves near the k-th are compared exactly
            kth = np.partition(row[at], len(at) - k)[len(at) - k]
            at = at[row[at] >= kth - 1e-9 * max(1.0, abs(kth))]
        s = (x[at] * q[i]).sum(axis=1)
        o = np.lexsort((xid[at], -s))[:k]
        out.append((np.full(len(o), qid[i]), xid[at][o], s[o]))
    return out


def _meet(k: int):
    """The best of a group's rows for each query that visits it, among the leaves that it visits."""

    def of(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(rows) and len(queries):
            rows = rows.sort_values("leaf", ignore_index=True)
            x, xid, leaf = np.stack(rows["v"].to_numpy()).astype(np.float64), rows["vec_id"].to_numpy(), rows["leaf"].to_numpy()
            for i in range(0, len(queries), 128):
                part = queries.iloc[i : i + 128]
                q, qid = np.stack(part["q"].to_numpy()).astype(np.float64), part["query_id"].to_numpy()
                by: dict[int, list[int]] = {}
                for j, own in enumerate(part["leaves"]):
                    for n in own:
                        by.setdefault(int(n), []).append(j)
                approx = np.full((len(q), len(x)), -np.inf)
                for n, who in by.items():
                    a, b = np.searchsorted(leaf, n), np.searchsorted(leaf, n, "right")
                    if a < b:
                        approx[who, a:b] = q[who] @ x[a:b].T
                approx[qid[:, None] == xid[None, :]] = -np.inf
                found += best_of(approx, q, qid, x, xid, k)
        a, b, s = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": s})

    return of


def search(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL, fit_rows: int = FIT_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each row whose id is divisible by every."""
    spark = vectors.sparkSession
    # Floats go as they are; they are doubles wherever something is calculated.
    kind = "float" if isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType) else "double"
    v = F.transform(vector_col, lambda x: x.cast(kind))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null")
    rows = rows.filter("not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)")
    rows = stored(rows.groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    out = "query_id long, rank int, vec_id long, score double"
    dims = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.expr("sqrt(aggregate(v, 0D, (a, x) -> a + double(x) * double(x)))")).alias("most")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not dims:
        return spark.createDataFrame([], out)
    dim, total, most = dims[0]["d"], dims[0]["n"], dims[0]["most"]
    rows = rows.filter(F.size("v") == dim)
    draw = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))
    sample = rows.filter(draw < F.lit(int(min(1.0, fit_rows / total) * (1 << 30)))).select("v").toArrow()  # about fit_rows rows
    x = _matrix(sample.column("v").combine_chunks(), dim) if sample.num_rows else np.zeros((1, dim))
    tree = Tree(lift(x, most), min(MAX_LEAVES, max(1, len(x) // 4), -(-total // LEAF_ROWS)))
    visits = calibrate(tree, x, most, k, recall)
    shared = spark.sparkContext.broadcast((tree, most, dim, visits, total))
    placed = stored(rows.mapInArrow(_place(shared), f"vec_id long, v array<{kind}>, leaf int"), "leaves")
    held = {r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().collect()}  # at most MAX_LEAVES rows
    held = [held.get(i, 0) for i in range(tree.leaves)]
    # A leaf's rows are dealt to parts of at most BLOCK_ROWS; parts next to each other in the tree form
    # groups of about GROUP_ROWS rows, within which a query's best are taken together.
    parts = [max(1, -(-n // BLOCK_ROWS)) for n in held]
    first = np.concatenate([[0], np.cumsum(parts)])
    size = np.cumsum(np.repeat([n / p for n, p in zip(held, parts, strict=True)], parts))
    group = ((size - 1e-6) // GROUP_ROWS).astype(int).clip(0)
    groups = [sorted(set(group[first[i] : first[i + 1]].tolist())) for i in range(tree.leaves)]
    layout = spark.sparkContext.broadcast((held, groups))
    visited = stored(rows.filter(F.pmod("vec_id", F.lit(every)) == 0).mapInArrow(_visit(shared, layout, k), f"query_id long, q array<{kind}>, g int, leaves array<int>"), "visits")
    drawn = visited.groupBy("g").count().collect()  # one row a group
    at_once = max(1, QUERY_BYTES // (8 * dim))
    blocks = spark.createDataFrame([(r["g"], -(-r["count"] // at_once)) for r in drawn] or [(-1, 1)], "g int, qb int")
    units = spark.createDataFrame([(i, parts[i], [int(g) for g in group[first[i] : first[i + 1]]]) for i in range(tree.leaves)], "leaf int, parts int, to array<int>")
    left = placed.join(F.broadcast(units), "leaf").withColumn("g", F.expr("get(to, cast(pmod(xxhash64(vec_id), parts) as int))"))
    left = left.join(F.broadcast(blocks), "g").withColumn("b", F.explode(F.expr("sequence(0, qb - 1)")))
    right = visited.join(F.broadcast(blocks), "g").withColumn("b", F.pmod(F.xxhash64("query_id"), F.col("qb")).cast("int"))
    met = left.select("g", "b", "leaf", "vec_id", "v").groupBy("g", "b").cogroup(right.select("g", "b", "query_id", "q", "leaves").groupBy("g", "b"))
    found = met.applyInPandas(_meet(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
