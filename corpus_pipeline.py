"""The corpus pipeline: language ID, line dedup, one document of each near-duplicate group,
benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents, whatever their names, the last one
those of the packed pieces. Stages run one after the other, each on the written rows of the one before.

Defined cases: a null doc_id is a document as any other, the last in order; different texts under one doc_id are
documents of their own; a null or blank text has no language and goes in the first stage; an empty table gives
no rows; texts are taken whole, of any length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontaminate, jaccard, langid, lines, packing
from quillon.llm.common import fresh, small_or_shuffled, stored


def _without(docs: DataFrame, gone: DataFrame, how: str = "left_anti") -> DataFrame:
    """docs without (or, left_semi, only) the rows whose id and text hash are in gone (doc_id, text_hash)."""
    at, text_hash = fresh(docs, "_id", "_hash")
    gone = stored(gone.select(F.col("doc_id").alias(at), F.col("text_hash").alias(text_hash)).distinct(), "gone")
    return docs.join(small_or_shuffled(gone, gone.count()), F.col("doc_id").eqNullSafe(F.col(at)) & (F.xxhash64("text") == F.col(text_hash)), how)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no letters) go; a missing lang is filled with the prediction."""
    lang, score = fresh(docs, "lang_pred", "score")
    out = langid.with_language(docs, ~langid.held_out(), new=(lang, score)).filter(F.col(lang) != "und")
    return out.withColumn("lang", F.coalesce("lang", lang)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines similar to an earlier one go, and documents of which no word is left."""
    n_lines, removed = fresh(docs, "n_lines", "removed_lines")
    out = lines.dedup(docs, n_lines=n_lines, removed=removed)
    out = out.filter((F.size(removed) == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id (then text hash; a null doc_id last) stays;
    so does one row of those that repeat a doc_id with an equal text."""
    groups = stored(jaccard.groups(docs), "groups")
    kept = _without(docs, groups.filter("not first"))
    twice = groups.filter("first").groupBy("doc_id", "text_hash").count().filter("count > 1")
    if twice.isEmpty():
        return kept
    return _without(kept, twice).unionByName(_without(kept, twice, "left_semi").dropDuplicates(["doc_id", "text"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.filter("contaminated"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document, as packing.SCHEMA has it."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("packing", packed),
]

#: Packing isn't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
