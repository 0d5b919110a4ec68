"""A training corpus from raw documents: five stages over one table of documents.

toxicity, quality, near duplicates, mixing to source weights, packing. Every stage
works on all that the one before kept; all but the last return the columns of
documents. ORACLE_SQL is None: three stages learn or link what SQL cannot say, so
tests compare the stages with brute force instead. Null texts are empty texts, null
ids are ids of their own, an empty table stays one, and columns of any further names
go along untouched.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import jaccard, mixing, packing, quality, toxicity
from riskloom.llm.io import forget, free_name, table, written
from riskloom.llm.linear import THRESHOLD
from riskloom.llm.tokens import vocabulary_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text is not toxic; learnt from the labelled documents among docs. Without labels all stay."""
    model, name = toxicity.train(docs, table(spark, sf_dir, "labels")), free_name(docs.columns, "pipeline_score")
    return toxicity.score(docs, model, name).where(F.col(name) < THRESHOLD).select(*docs.columns)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that op4_quality would predict as good; learnt from the labelled documents among docs. Without labels none is rejected."""
    weights, name = quality.train(docs, table(spark, sf_dir, "labels")), free_name(docs.columns, "pipeline_score")
    # nothing was learnt
    if np.all(weights == 0):
        return docs
    return quality.score(docs, weights, name).where(F.col(name) >= THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates; all without words or id.

    Where an id stands on several rows, a row goes only if its own set is in the component of a smaller id.
    """
    columns, sig = docs.columns, free_name(docs.columns, "sig")
    groups = jaccard.components_of_sets(docs.select("doc_id", "text"))
    gone = groups.where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id"), F.col("sig").alias(sig)).distinct()
    repeated = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if not repeated.limit(1).count():
        return docs.join(gone, "doc_id", "left_anti").select(*columns)
    gone = written(gone, "gone")
    # rows that repeat an id are compared by set and text, the others by id
    once = docs.join(repeated, "doc_id", "left_anti").join(gone, "doc_id", "left_anti").select(*columns)
    several = jaccard.signed(docs.join(repeated, "doc_id", "left_semi").select(*columns), sig).join(gone, ["doc_id", sig], "left_anti")
    return once.unionByName(several.select(*columns).dropDuplicates(["doc_id", "text"]))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences."""
    return packing.pack_documents(docs, vocabulary_path())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each a table that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
