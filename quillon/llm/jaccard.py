"""Size-aware n-gram Jaccard join of documents, and the groups that its links form.

Sets of word shingles are split by size. Small sets (light) enumerate the fixed-size subsets that a
partner of each possible size must share; sets that meet in one are linked. Large sets (heavy), and
small ones whose partner may be large, scan inverted lists of their rarest elements and are
verified. The boundary is chosen by cost from the counts of texts by size.

Defined cases: a null, empty or blank text has the empty set, which links with nothing; a document
without doc_id is joined as any other, but has component_id null, and null if all of its group have none;
repeated rows are documents with equal sets; different texts under one doc_id are documents of their own;
an empty table gives no rows; other columns are ignored; texts are taken whole, of any length; bytes that
aren't UTF-8 are compared as they are.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import setjoin
from .common import SHINGLE, attach, components, stored

#: What a list entry costs that is shuffled, scanned and may have to be verified, against that of a subset.
LIST_COST = 4


def _subsets(n: int) -> int:
    """Subsets that a set of n elements enumerates for partners of any size."""
    return sum(comb(n, c) for _, c in setjoin.subsets_of(n, 2 * n))


def boundary(by_size: list[int]) -> int:
    """The size up to which enumerating is the cheaper side: the least of summed costs. by_size: texts by the
    places for elements that they have. From the size on where a set has more than LIST_COST subsets for
    each of its prefix elements every further one adds to the cost, so that sizes beyond aren't tried."""
    cost = best = chosen = 0
    for n in range(1, len(by_size)):
        prefix = n + (-setjoin.SIMILAR * n // 100) + 1
        cost += by_size[n] * (_subsets(n) - LIST_COST * prefix)
        if cost <= best:
            best, chosen = cost, n
        if n > 10 and _subsets(n) > LIST_COST * prefix:
            break
    return chosen


def _light_links(rows: DataFrame) -> DataFrame:
    """Links between classes that share an enumerated subset: each with the first on the other side."""
    small, large = F.col("side") == -1, F.col("side") == -2
    rows = rows.withColumnRenamed("skey", "key")
    first = rows.groupBy("subset").agg(F.min(F.when(small, F.col("key"))).alias("lo"), F.min(F.when(large, F.col("key"))).alias("hi"), F.min(F.when(F.col("side") == -3, F.col("key"))).alias("even"), F.count("*").alias("members")).filter("members > 1")
    met = rows.join(first, "subset")
    other = F.when(small, F.col("hi")).when(large, F.col("lo")).otherwise(F.col("even"))
    return stored(met.select(other.alias("a"), F.col("key").alias("b")).filter("a is not null and a <> b").distinct(), "light")


def links(docs: DataFrame, k: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(doc, src, key, n) of every document (doc_id, text, src), and (node, root) of every class with a link."""
    ranks, sizes, places = setjoin.order(docs, k)
    light = boundary(sizes)
    units, subsets = setjoin.units(docs, k=k, light=light)
    pairs, open_ = setjoin.met(docs, ranks, places, k=k, light=light)
    sets = setjoin.fetched(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).union(open_.select("key")), units, docs, ranks, k=k)
    found = setjoin.verified(pairs, sets)
    if light:
        found = found.unionByName(_light_links(subsets))
    roots = stored(components(found, "a", "b"), "roots")
    # Second step: the classes of an open list that aren't in the component of most of its classes, held against
    # those of other components. Lists with one component of most are taken together, so that a class and a
    # pair come once for many lists.
    own = open_.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("grp", F.coalesce("root", "key")).drop("root")
    most = own.groupBy("tok", "grp").count().groupBy("tok").agg(F.max_by("grp", F.struct("count", "grp")).alias("most"), F.count("*").alias("groups")).filter("groups > 1")
    own = own.join(most.drop("groups"), "tok").select(F.col("most").alias("tok"), "key", (F.col("grp") != F.col("most")).alias("stray"), "grp").distinct()
    own = stored(own.withColumns({"doc": F.lit(0).cast("long"), "line": F.lit(0)}), "strays")
    if not own.isEmpty() and not (more := setjoin.second_links(own, sets, False)).isEmpty():
        roots = stored(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), "a", "b"), "roots")
    return units, roots


def groups(docs: DataFrame, k: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every document, and text_hash, and first: whether doc_id and text_hash are
    the least of its group, a null doc_id last."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("src"))
    units, roots = links(docs, k)
    place = F.struct("doc", "src")
    classes = units.filter("n > 0").groupBy("key").agg(F.min(place).alias("least"), F.count("*").alias("members"))
    classes = classes.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    classes = stored(classes, "classes")
    lowest = classes.groupBy("root").agg(F.min("least").alias("lowest"), F.sum("members").alias("all")).filter("all > 1")
    classes = stored(classes.join(lowest, "root").select("key", "lowest", "members"), "classes")
    out = attach(units.drop("line"), classes, "key", "members", units.count())
    lowest = F.when(F.col("n") > 0, F.col("lowest"))
    known = lambda c: F.when(c != setjoin.LAST, c)
    doc = known(F.col("doc"))
    component = F.when(doc.isNotNull(), F.coalesce(known(lowest["doc"]), doc))
    return out.select(doc.alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), F.col("src").alias("text_hash"), F.coalesce(place == lowest, F.lit(True)).alias("first"))
