"""The corpus pipeline: filter by quality rules, keep one of each near-duplicate group, sample by target weights, segment.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframes.llm import ngram_join, piece_lattice, quality_rules, source_mixing
from skyframes.llm.common import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host does."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return ngram_join.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of documents with the target shares of source, language and topic."""
    return source_mixing.sample(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's best segmentation, its score and the n best scores."""
    return piece_lattice.segment(docs.select("doc_id", F.col("text")), with_ids=True)


STAGES = [("quality rules", quality), ("n-gram join", near_duplicates), ("source mixing", mixture), ("piece lattice", pieces)]

#: SQL can't express the stages (A-star search, raking until sampled); tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
