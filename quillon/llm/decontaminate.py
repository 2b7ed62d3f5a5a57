"""Benchmark decontamination by winnowing, in DataFrame operations only.

A window is SPAN consecutive words of a benchmark item (all of a shorter item's words). With k-grams
of GRAM words and SPAN - GRAM + 1 k-gram hashes under a sliding window, the least hash of a window
is a fingerprint of its SPAN words: two equal spans have equal k-grams and so the same least hash.
Every SPAN words of a document are such a window, so no shared span is missed. Neighbouring
windows mostly keep the same least hash; only where it changes does a document give a row. These
fingerprints are joined with the benchmark's, and a hit is extended: all windows with that
fingerprint are compared with the benchmark's as text.

Items shorter than SPAN have fingerprints by their own length, in a pass for each length. The
benchmark is broadcast in blocks of at most BLOCK_WINDOWS windows, with a pass over the documents
for each block, so what is broadcast is bounded whatever the benchmark's size.

Defined cases: null has no words, neither as document nor as item; an item without item_id counts
by the id "null"; an empty benchmark hits nothing; repeated documents each get their row; an empty
table gives no rows; other columns are ignored; texts are taken whole.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN, GRAM = 10, 5
BLOCK_WINDOWS = 200_000


def words(text: Column) -> Column:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lowered."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def winnowed(df: DataFrame, span: int) -> DataFrame:
    """df (with column words) and least: for each run of span words the least hash of its k-grams."""
    k = min(GRAM, span)
    w = span - k + 1
    df = df.withColumn("hashes", F.transform("words", lambda x: F.xxhash64(x)))
    gram = ", ".join(["x"] + [f"get(hashes, i + {j})" for j in range(1, k)])
    df = df.withColumn("grams", F.expr(f"transform(slice(hashes, 1, greatest(0, size(hashes) - {k - 1})), (x, i) -> xxhash64({gram}))"))
    if w == 1:
        return df.withColumn("least", F.col("grams")).drop("hashes", "grams")
    least = ", ".join(["x"] + [f"get(grams, i + {j})" for j in range(1, w)])
    df = df.withColumn("least", F.expr(f"transform(slice(grams, 1, greatest(0, size(grams) - {w - 1})), (x, i) -> least({least}))"))
    return df.drop("hashes", "grams")


def _windows(items: DataFrame, span: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of items, and the text of their windows with the items that have it."""
    items = winnowed(items, span)
    prints = items.select(F.explode_outer("least").alias("print")).filter("print is not null").distinct()
    at = items.select("item", "words", F.explode_outer(F.expr(f"sequence(1, size(words) - {span - 1})")).alias("s"))
    return prints, at.groupBy(F.array_join(F.slice("words", F.col("s"), span), " ").alias("window")).agg(F.collect_set("item").alias("items"))


# explode_outer, not explode: from the latter Spark infers a filter on its argument, which it pushes
# below the projections that compute it, so that each is evaluated anew inside the others.


def _hits(docs: DataFrame, items: DataFrame, span: int, every: bool) -> DataFrame:
    """doc_id, th, n_words, and either one row for each document (s null, with every) or a row for
    each span of words that is a window of an item."""
    prints, windows = _windows(items, span)
    d = winnowed(docs, span)
    d = d.withColumn("heads", F.expr("filter(sequence(-1, size(least) - 1), j -> j < 0 or j = 0 or get(least, j) <> get(least, j - 1))"))
    d = d.select("doc_id", "th", "n_words", "words", "least", "heads", F.posexplode_outer("heads").alias("at", "head"))
    d = d.withColumn("print", F.expr("get(least, head)"))
    d = d.join(F.broadcast(prints.select("print", F.lit(True).alias("met"))), "print", "left" if every else "inner")
    d = d.filter("met or head < 0")
    ends = F.expr("case when head < 0 then array(-1) else sequence(head, coalesce(get(heads, at + 1), size(least)) - 1) end")
    d = d.select("doc_id", "th", "n_words", "words", F.explode_outer(ends).alias("s"))
    d = d.select("doc_id", "th", "n_words", "s", F.when(F.col("s") >= 0, F.array_join(F.slice("words", F.col("s") + 1, span), " ")).alias("window"))
    d = d.join(F.broadcast(windows), "window", "left" if every else "inner").filter("s < 0 or items is not null")
    return d.select("doc_id", "th", "n_words", F.when(F.col("s") >= 0, F.struct("s", F.lit(span).alias("n"))).alias("span"), "items")


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and items (their ids as strings), text_hash
    (xxhash64 of the text)."""
    text = F.col(text_col)
    d = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), words(text).alias("words")).withColumn("n_words", F.size("words"))
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), words(F.col(item_text_col)).alias("words")).filter("size(words) > 0")
    found = items.groupBy(F.least(F.size("words"), F.lit(span)).alias("span")).agg(F.sum(F.size("words") - F.least(F.size("words"), F.lit(span)) + 1).alias("windows")).collect()
    sizes = {span: 0} | {r["span"]: r["windows"] for r in found}  # at most span rows
    parts = []
    for n, total in sizes.items():
        blocks = max(1, -(-total // block_windows))
        own = items.filter(F.least(F.size("words"), F.lit(span)) == n)
        for b in range(blocks):
            part = own.filter(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == b) if blocks > 1 else own
            parts.append(_hits(d, part, n, n == span and b == 0))
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    rows = hits.groupBy("doc_id", "th", "n_words").agg(
        F.collect_set("span").alias("spans"), F.collect_set("items").alias("items"), F.count(F.when(F.col("span").isNull(), 1)).alias("copies"))
    hit = F.expr("aggregate(array_sort(spans), struct(0 as upto, 0 as n), (a, x) -> struct(greatest(a.upto, x.s + x.n) as upto, a.n + greatest(0, x.s + x.n - greatest(a.upto, x.s)) as n)).n")
    rows = rows.withColumn("n_hit", hit.cast("long")).withColumn("items", F.array_sort(F.array_distinct(F.flatten("items"))))
    return rows.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items", F.col("th").alias("text_hash"),
        F.explode(F.expr("sequence(1, copies)")).alias("_copy")).drop("_copy")
