"""Sharding by Karmarkar-Karp differencing.

Equal texts form an indivisible group; a group's size is the sum of its rows' sizes (UTF-8 bytes
of the text plus 1). Groups are dealt to cells by their hash; each cell differences its groups to
one partial partition (the differencing method for several parts: the two partial partitions with
the largest spread are combined in opposite order, again and again), and the driver goes on with
one partial partition a cell. The cells are at most MAX_CELLS, so what it holds is bounded.
Slots are numbered by blocks of rows; among rows whose text many have, their order follows from how the
table was split.

Defined cases: a null text has no bytes and counts as an empty one (size 1, CRC 0); repeated rows
are rows of their own; doc_id may be null or repeat; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import heapq
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Groups that one cell differences, and the most cells.
CELL_GROUPS = 8192
MAX_CELLS = 65_536
#: A group with at least this share of all rows goes by broadcast: there are at most 1/share.
HEAVY = 0.001


def difference(sizes: list[list[int]], shards: int) -> list[list[int]]:
    """sizes: for each partial partition its sums, in any order. Returns, for each of them and
    each of its places, the shard that place goes to."""
    order = count()
    heap, parts = [], []
    for i, row in enumerate(sizes):
        sums = sorted(((s, [(i, j)]) for j, s in enumerate(row)), key=lambda x: -x[0])
        parts.append(sums)
        heap.append((sums[-1][0] - sums[0][0], next(order), i))
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        merged = []
        for (s, x), (t, y) in zip(parts[a], reversed(parts[b]), strict=True):
            if len(x) < len(y):
                x, y = y, x
            x.extend(y)
            merged.append((s + t, x))
        merged.sort(key=lambda x: -x[0])
        parts[a], parts[b] = merged, None
        heapq.heappush(heap, (merged[-1][0] - merged[0][0], next(order), a))
    out = [[0] * shards for _ in sizes]
    for shard, (_, places) in enumerate(parts[heap[0][2]] if heap else []):
        for i, j in places:
            out[i][j] = shard
    return out


def _cell(shards: int):
    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "g"], ascending=[False, True], ignore_index=True)
        places = difference([[s] + [0] * (shards - 1) for s in pdf["size"].tolist()], shards)
        return pd.DataFrame({"g": pdf["g"], "cell": pdf["cell"], "part": [p[0] for p in places], "size": pdf["size"], "n": pdf["n"]})

    return of


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's shard and place: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stored(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.md5(F.encode(text, "UTF-8")).alias("g"),
    ), "shard-rows")
    total = rows.count()
    cells = max(1, min(MAX_CELLS, -(-total // CELL_GROUPS)))
    groups = rows.groupBy("g").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    groups = groups.withColumn("cell", F.pmod(F.xxhash64("g"), F.lit(cells)).cast("int"))
    dealt = stored(groups.groupBy("cell").applyInPandas(_cell(shards), "g string, cell int, part int, size long, n long"), "shard-groups")
    sums = dealt.groupBy("cell", "part").agg(F.sum("size").alias("size")).collect()  # at most cells x shards rows
    found: dict[int, list[int]] = {}
    for r in sums:
        found.setdefault(r["cell"], [0] * shards)[r["part"]] = r["size"]
    keys = sorted(found)
    to = difference([found[c] for c in keys], shards)
    spark = docs.sparkSession
    where = spark.createDataFrame([(c, j, to[i][j]) for i, c in enumerate(keys) for j in range(shards)], "cell int, part int, shard int")
    dealt = dealt.join(F.broadcast(where), ["cell", "part"])
    # A row's shard: the few heavy groups go by broadcast, so that no task gathers a heavy group.
    heavy = F.col("n") >= max(2.0, HEAVY * total)
    few = dealt.filter(heavy).select("g", F.col("shard").alias("heavy_shard"))
    rows = rows.join(F.broadcast(few), "g", "left")
    # Rows of a heavy group are spread over the blocks one by one, since many may have one doc_id as well.
    block = lambda *of: F.pmod(F.xxhash64("doc_id", "g", *of), F.lit(4 * cells)).cast("int")
    placed = rows.filter("heavy_shard is not null").withColumnRenamed("heavy_shard", "shard").withColumn("block", block(F.monotonically_increasing_id())).unionByName(
        rows.filter("heavy_shard is null").drop("heavy_shard").join(dealt.filter(~heavy).select("g", "shard"), "g").withColumn("block", block()))
    placed = stored(placed.drop("g"), "shard-placed")
    # Slots: a block's rows are numbered apart, after the counts of the blocks before it.
    counts = placed.groupBy("shard", "block").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("block")) - F.col("rows")
    counts = counts.select("shard", "block", before.alias("before"))  # at most shards x 4 x MAX_CELLS rows
    inside = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32")) - 1
    return placed.withColumn("inside", inside).join(counts, ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("before") + F.col("inside")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
