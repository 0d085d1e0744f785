"""From raw documents to token files: five stages, each one of the training-data operators.

A stage takes all that its predecessor kept and returns the columns of ``documents``; the last one
returns, per document of the written files, its place, length and checksum. Stages run one after another
in the same executors, so each bounds the Arrow batches its tasks hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivano.llm import decontamination, jaccard_join, mixing, quality, token_files
from scrivano.llm.scratch import Scratch, table
from scrivano.session import bounded_batches, scratch_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier rejects go."""
    bounded_batches(spark)
    scored = quality.score(docs, table(spark, sf_dir, "labels"), carry=True)
    return scored.filter(F.col(scored.columns[-1]) >= quality.THRESHOLD).select(*[f"`{c}`" for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays."""
    bounded_batches(spark)
    return jaccard_join.one_per_component(docs, Scratch(spark))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    bounded_batches(spark)
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"), Scratch(spark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are taken to their target weights; a document may come twice or not at all."""
    bounded_batches(spark)
    return mixing.mixed_documents(docs, Scratch(spark))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids go to compressed files and are read back."""
    bounded_batches(spark)
    return token_files.document_digests(docs, Scratch(spark), scratch_path(spark, "token-files"))


STAGES = [
    ("quality_classifier", keep_quality),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing_sources", mix_sources),
    ("token_files", write_tokens),
]

# Classifier, metric join, singular vectors and coder have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
