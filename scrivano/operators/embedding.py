"""Embedding pipeline: instruction prefix, batch encoding, index assignment, manifest, checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrivano.operators.sweep import running_total
from scrivano.session import cut_lineage

# The default model name and the instruction its family expects.
DEFAULT_MODEL = "BAAI/bge-base-en-v1.5"
INSTRUCTED_FAMILY = "bge"
INSTRUCTION = "Represent this sentence for searching relevant passages:"

DEFAULT_DIMENSION = 768

# A factory is called once per Python worker; the encoder it returns turns a batch of texts into a matrix.
Encoder = Callable[[Sequence[str]], np.ndarray]
EncoderFactory = Callable[[], Encoder]


def with_instruction(text: Column, model: Column | str, instruction: str = INSTRUCTION) -> Column:
    """Prefix documents and queries alike when the model family expects an instruction."""
    name = F.lit(model) if isinstance(model, str) else model
    prefixed = F.concat(F.lit(instruction + " "), text)
    return F.when(F.contains(F.lower(name), F.lit(INSTRUCTED_FAMILY)), prefixed).otherwise(text)


def encode_hashed(
    df: DataFrame, text: str, dimension: int = DEFAULT_DIMENSION, out: str = "embedding"
) -> DataFrame:
    """Default encoder: word counts hashed into ``dimension`` buckets, unit length, in the JVM."""
    words = RegexTokenizer(
        inputCol=text, outputCol="_words", pattern=r"[\p{L}\p{N}]+", gaps=False, toLowercase=True
    )
    hashed = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dimension)
    unit = Normalizer(inputCol="_counts", outputCol="_unit", p=2.0)
    ready = df.withColumn(text, F.coalesce(F.col(text), F.lit("")))
    scaled = unit.transform(hashed.transform(words.transform(ready)))
    vector = vector_to_array("_unit", "float32")
    return scaled.withColumn(out, vector).drop("_words", "_counts", "_unit")


def encode_with(
    df: DataFrame,
    text: str,
    factory: EncoderFactory,
    out: str = "embedding",
    normalize: bool = True,
    batch_size: int = 64,
) -> DataFrame:
    """Encode ``text`` with a pluggable encoder, loaded once per Python worker and fed ``batch_size`` texts.

    The encoding is a column like any other: what does not select it does not encode.
    """

    def load():
        encoder = factory()

        def predict(texts: np.ndarray) -> np.ndarray:
            matrix = np.asarray(encoder([t or "" for t in texts.tolist()]), dtype=np.float64)
            if normalize:
                length = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
                matrix = np.divide(matrix, length, out=matrix.copy(), where=length > 0)
            return matrix.astype(np.float32)

        return predict

    encode = predict_batch_udf(load, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return df.withColumn(out, encode(F.coalesce(F.col(text), F.lit(""))))


def embed(
    df: DataFrame,
    text: str,
    model: str = DEFAULT_MODEL,
    factory: EncoderFactory | None = None,
    dimension: int = DEFAULT_DIMENSION,
    out: str = "embedding",
) -> DataFrame:
    """Prefix and encode; the same operator serves document and query tables."""
    staged = df.withColumn("_input", with_instruction(F.col(text), model))
    if factory is None:
        encoded = encode_hashed(staged, "_input", dimension, out)
    else:
        encoded = encode_with(staged, "_input", factory, out)
    return encoded.drop("_input")


def with_embedding_index(df: DataFrame, *order: str) -> DataFrame:
    """Number rows of any frame 0..n-1 in the given order without a one-task window.

    Rows are range-partitioned on the order and fixed by a checkpoint; each partition knows its
    rows' positions, and an offset per partition (one row each) is joined back.
    """
    placed = cut_lineage(df.orderBy(*order).withColumn("_slot", F.monotonically_increasing_id()))
    part = F.shiftright("_slot", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition of the sorted table, so the window below is small by construction.
    offsets = sizes.selectExpr(
        "_part",
        "coalesce(sum(_n) over (order by _part rows between unbounded preceding and 1 preceding),"
        " 0) as _offset",
    )
    within = F.col("_slot") - F.shiftleft(F.col("_part"), 33)
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn("embedding_index", F.col("_offset") + within)
        .drop("_slot", "_part", "_offset")
    )


MAX_BROADCAST_DOCUMENTS = 1_000_000


def with_slot(sections: DataFrame, slot: str = "slot") -> DataFrame:
    """Mark each row with its place in its task; keep the mark by writing the table."""
    return sections.withColumn(slot, F.monotonically_increasing_id())


def document_starts(sections: DataFrame, doc: str = "doc_id", slot: str = "slot") -> DataFrame:
    """Per document: rows, first slot, and the number of rows of all documents before it.

    Counts are combined before they move; their running total is the only pass over all documents.
    """
    counted = sections.groupBy(doc).agg(
        F.count(F.lit(1)).alias("n"), F.min(slot).alias("first"), F.max(slot).alias("last")
    )
    return running_total(counted, [doc], "n").withColumn("start", F.col("upto") - F.col("n")).drop("upto")


def number_sections(
    sections: DataFrame, doc: str = "doc_id", slot: str = "slot", order: tuple[str, ...] = ("line_number", "content_length")
) -> DataFrame:
    """Number the sections of all documents 0..n-1, documents in order; the content never moves.

    ``sections`` is a written table with slots, in which the rows of a document are consecutive and in
    order, as :func:`~scrivano.operators.sections.sectionize` returns them. The index is a row's slot
    shifted by its document's start. Up to ``MAX_BROADCAST_DOCUMENTS`` documents the starts are broadcast,
    beyond that they are joined on the document, which a table bucketed by it answers in place. Where rows of
    some document are not together (an id that several documents share), all are sorted by ``order`` instead.
    """
    starts = cut_lineage(document_starts(sections, doc, slot))
    size = starts.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("last") - F.col("first") + 1 != F.col("n")).alias("torn")).first()
    if size.torn:
        return with_embedding_index(sections.drop(slot), doc, *order)
    shift = starts.select(F.col(doc).alias("_doc"), (F.col("start") - F.col("first")).alias("_shift"))
    if size.n <= MAX_BROADCAST_DOCUMENTS:
        shift = F.broadcast(shift)
    joined = sections.join(shift, F.col(doc).eqNullSafe(F.col("_doc")))
    return joined.withColumn("embedding_index", F.col(slot) + F.col("_shift")).drop(slot, "_doc", "_shift")


def section_id(index: Column) -> Column:
    return F.concat(F.lit("section_"), index.cast("string"))


def manifest(embedded: DataFrame, model: str = DEFAULT_MODEL, embedding: str = "embedding") -> DataFrame:
    """One row: model, dimension, count; the time columns are left to the writer."""
    size = F.size(embedding)
    return embedded.agg(
        F.lit(model).alias("model_name"),
        F.when(F.min(size) == F.max(size), F.max(size)).alias("embedding_dimension"),
        F.count(F.lit(1)).alias("num_embeddings"),
    )


def throughput(embedded: DataFrame, seconds: float, embedding: str = "embedding") -> DataFrame:
    return embedded.agg(
        F.count(F.lit(1)).alias("texts"),
        (F.count(F.lit(1)) / F.lit(float(seconds))).alias("texts_per_second"),
        (F.sum(F.size(embedding).cast("long") * 4) / F.lit(1024.0 * 1024.0)).alias("megabytes"),
    )


def unmatched_counts(
    dataset: DataFrame, embeddings: DataFrame, key: str = "embedding_index"
) -> DataFrame:
    """Rows on either side without a partner: (``only_dataset``, ``only_embeddings``)."""
    left = dataset.select(key, F.lit(1).alias("_d"))
    right = embeddings.select(key, F.lit(1).alias("_e"))
    return left.join(right, key, "full_outer").agg(
        F.count_if(F.col("_e").isNull()).alias("only_dataset"),
        F.count_if(F.col("_d").isNull()).alias("only_embeddings"),
    )


def check_alignment(
    dataset: DataFrame, embeddings: DataFrame, key: str = "embedding_index"
) -> None:
    """Raise ``ValueError`` with both counts unless every row has its vector and vice versa."""
    row = unmatched_counts(dataset, embeddings, key).first()
    if row.only_dataset or row.only_embeddings:
        raise ValueError(
            f"dataset and embeddings differ: {row.only_dataset} rows without a vector, "
            f"{row.only_embeddings} vectors without a row"
        )


def build_collection(sections: DataFrame) -> DataFrame:
    """Embedded, indexed sections in the collection layout."""
    return sections.select(
        section_id(F.col("embedding_index")).alias("id"),
        F.col("embedding_index").cast("long").alias("embedding_index"),
        "embedding",
        F.col("content").alias("document"),
        F.col("section_number").cast("string").alias("section_number"),
        F.col("section_path").cast("string").alias("section_path"),
        F.col("content_length").cast("int").alias("content_length"),
        F.col("line_number").cast("int").alias("line_number"),
    )
