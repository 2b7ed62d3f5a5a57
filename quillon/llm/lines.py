"""Line deduplication by an exact set-similarity join.

A line's set has its distinct words. Lines are joined as in setjoin: words in order of rarity, prefix, length
and positional filters, then the exact Jaccard test. A line goes if an earlier one, by (doc_id, line number),
has a similar or equal set. Of two texts under one doc_id, lines of the same number are ordered by hashes.

Defined cases: blank lines have no set and stay; a null text stays null and has no lines; rows that
repeat a doc_id with its text are one document, so their equal lines stay together, different texts are
documents of their own; a null doc_id is the last; an empty table gives no rows; other columns are kept as
they are; texts and lines may have any length; bytes that
aren't UTF-8 are compared as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import setjoin
from .common import attach, fresh, small_or_shuffled, stored


def removed_lines(docs: DataFrame) -> DataFrame:
    """doc (doc_id, or the largest long for null), src (a hash of its text) and removed (its line numbers
    that go, from 0), of docs (doc_id, text, src)."""
    units, ranks, places = setjoin.counted_units(docs, lines=True, k=1)
    pairs, open_ = setjoin.met(docs, ranks, places, lines=True, k=1)
    sets = setjoin.fetched(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).union(open_.select("key")), units, docs, ranks, lines=True, k=1)
    classes = stored(units.groupBy("key").agg(F.min(F.struct("doc", "line", "src")).alias("first"), F.count("*").alias("members")), "classes")
    places = stored(classes.join(sets.select("key"), "key", "left_semi").select("key", "first.doc", "first.line"), "places")

    def later(links: DataFrame) -> DataFrame:
        """The class of each link that comes later."""
        for side in ("a", "b"):
            links = links.join(places.select(F.col("key").alias(side), F.struct("doc", "line", "key").alias(f"{side}_at")), side)
        return links.select(F.when(F.col("a_at") < F.col("b_at"), F.col("b")).otherwise(F.col("a")).alias("key")).distinct()

    gone = stored(later(setjoin.verified(pairs, sets)), "gone")
    # A line of an open list that isn't similar to those it met may still be to another earlier one.
    own = open_.join(gone.withColumn("gone", F.lit(True)), "key", "left").join(places, "key")
    own = stored(own.select("tok", "key", F.col("gone").isNull().alias("stray"), F.col("key").alias("grp"), "doc", "line"), "strays")
    if not own.isEmpty():
        gone = stored(gone.union(setjoin.second_links(own, sets, True).select("b")).distinct(), "gone")
    classes = stored(classes.join(gone.withColumn("gone", F.lit(True)), "key", "left").filter("gone or members > 1"), "classes")
    out = attach(units.drop("n"), classes, "key", "members", units.count(), "inner").filter("gone or doc <> first.doc or line <> first.line or src <> first.src")
    return stored(out.groupBy("doc", "src").agg(F.array_sort(F.collect_set("line")).alias("removed")), "removed")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_lines: str = "n_lines", removed: str = "removed_lines") -> DataFrame:
    """docs with the lines gone from the text, and n_lines, removed_lines (their numbers, from 0) under these names,
    which docs mustn't have."""
    if fresh(docs, n_lines, removed) != [n_lines, removed]:
        raise ValueError(f"the table has a column {n_lines} or {removed} already")
    at, src, which = fresh(docs, "_doc", "_src", "_removed")
    gone = removed_lines(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("src")))
    gone = gone.select(F.col("doc").alias(at), F.col("src").alias(src), F.col("removed").alias(which))
    lines = F.split(text_col, "\n", -1)
    out = docs.join(small_or_shuffled(gone, gone.count()), (F.coalesce(F.col(id_col).cast("long"), F.lit(setjoin.LAST)) == F.col(at)) & (F.xxhash64(text_col) == F.col(src)), "left").drop(at, src)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(which, i)), "\n")
    out = out.withColumn(n_lines, F.coalesce(F.size(lines), F.lit(0))).withColumn(text_col, F.when(F.col(which).isNull(), F.col(text_col)).otherwise(kept))
    return out.withColumn(removed, F.coalesce(which, F.array().cast("array<int>"))).drop(which)
