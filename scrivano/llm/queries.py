"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from scrivano.llm import (
    ann,
    decontamination,
    divergence,
    embedding_dedup,
    hard_negatives,
    html_text,
    jaccard_join,
    line_dedup,
    mixing,
    quality,
    sharding,
    substring_dedup,
    token_files,
)
from scrivano.llm.scratch import Scratch, table
from scrivano.session import scratch_path
from scrivano.workloads import Registry

REGISTRY = Registry()


@REGISTRY.add("op3_html_extraction")
def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@REGISTRY.add("op4_mixing", mixing.ORACLE)
def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), Scratch(spark)).drop("copies")


@REGISTRY.add("op7_quality_classifier")
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id",
        quality.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


@REGISTRY.add("op8_nearest_neighbours")
def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


@REGISTRY.add("op9_sharding")
def sharding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), Scratch(spark))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@REGISTRY.add("op1_ngram_jaccard_join")
def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = jaccard_join.link_classes(table(spark, sf_dir, "documents"), Scratch(spark))
    return linked.drop("text_hash", "component")


@REGISTRY.add("op5_token_files")
def token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    return token_files.document_digests(
        table(spark, sf_dir, "documents"), scratch, scratch_path(spark, "token-files")
    )


@REGISTRY.add("op2_line_dedup")
def fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), Scratch(spark))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@REGISTRY.add("op6_decontamination")
def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@REGISTRY.add("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


@REGISTRY.add("op10_suffix_array_dedup")
def suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), Scratch(spark))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256"))


@REGISTRY.add("op11_embedding_dedup", embedding_dedup.ORACLE)
def embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup(table(spark, sf_dir, "embeddings"), Scratch(spark))


@REGISTRY.add("op12_source_divergence", divergence.ORACLE)
def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), Scratch(spark))


@REGISTRY.add("op13_hard_negatives", hard_negatives.ORACLE)
def hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hard_negatives.mine(rows, Scratch(spark))
