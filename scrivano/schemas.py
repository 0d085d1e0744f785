"""Explicit schemas of the tables the operators exchange (nothing is inferred)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
)

DOCUMENT_PAGES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("page_no", T.IntegerType()),
        T.StructField("text", T.StringType()),
    ]
)

SECTION_CSV = T.StructType(
    [
        T.StructField("section_number", T.StringType()),
        T.StructField("section_path", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("content_length", T.IntegerType()),
        T.StructField("line_number", T.IntegerType()),
    ]
)

REQUIRED_SECTION_COLUMNS = ("section_number", "section_path", "content")

MANIFEST = T.StructType(
    [
        T.StructField("model_name", T.StringType()),
        T.StructField("embedding_dimension", T.IntegerType()),
        T.StructField("num_embeddings", T.LongType()),
        T.StructField("processing_time", T.DoubleType()),
    ]
)

COLLECTION = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("embedding_index", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("document", T.StringType()),
        T.StructField("section_number", T.StringType()),
        T.StructField("section_path", T.StringType()),
        T.StructField("content_length", T.IntegerType()),
        T.StructField("line_number", T.IntegerType()),
    ]
)

TEST_CASES = T.StructType(
    [
        T.StructField("query", T.StringType()),
        T.StructField("expected_sections", T.ArrayType(T.StringType())),
        T.StructField("category", T.StringType()),
    ]
)

TURN_METADATA = T.StructType(
    [
        T.StructField("standards_found", T.IntegerType()),
        T.StructField("standards", T.ArrayType(T.StringType())),
        T.StructField("query_type", T.StringType()),
    ]
)

HISTORY_TURN = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("response", T.StringType()),
        T.StructField("metadata", TURN_METADATA),
    ]
)

HISTORY_FILE = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("conversation_history", T.ArrayType(HISTORY_TURN)),
        T.StructField("saved_at", T.StringType()),
    ]
)


def require_columns(df: DataFrame, names, what: str) -> DataFrame:
    """Raise ``ValueError`` naming every missing column; return ``df`` unchanged otherwise."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks required columns: {', '.join(missing)}")
    return df
