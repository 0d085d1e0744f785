"""Readers. Schemas are explicit; missing columns and missing tables raise clear errors."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrivano import schemas
from scrivano.functions.text import is_blank
from scrivano.operators.embedding import DEFAULT_MODEL, check_alignment
from scrivano.sources import quoted_csv, text_files

# The built-in evaluation cases (query, expected section paths, category).
DEFAULT_CASES = [
    ("What is Murabahah?", ["3//1"], "definition"),
    ("currency trading", ["2//1", "2//1//1", "2//1//2"], "rules"),
    ("What is Riba and when is it prohibited?", ["2//1", "2//2"], "prohibition"),
    ("Mudarabah", ["5//1", "5//2"], "definition"),
    ("Ijarah contract", ["4//1", "4//1//1"], "conditions"),
    ("Salam contract", ["6//1", "6//1//1"], "definition"),
    ("Musharakah", ["5//1", "5//1//1"], "rules"),
    ("currency transactions", ["2//2", "2//3"], "prohibition"),
]

CSV_OPTIONS = {
    "header": True,
    "multiLine": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def _json_or(
    spark: SparkSession, path: str | None, schema: T.StructType, default, multi_line: bool = True
) -> DataFrame:
    """JSON file under ``schema``, or the ``default`` rows where there is no such file."""
    if path:
        try:
            return spark.read.schema(schema).option("multiLine", multi_line).json(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    return spark.createDataFrame(default, schema)


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Every ``*.txt`` below ``folder`` that is not itself an output: ``path, filename, stem, text``."""
    if text_files.holds(folder):
        raw = text_files.open_texts(spark, folder).filter(F.endswith("filename", F.lit(".txt")))
    else:
        raw = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True).select(
            F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("filename"), "value"
        )
    raw = raw.select("path", "filename", F.col("value").alias("text"))
    return raw.filter(~F.contains("filename", F.lit("cleaned"))).withColumn(
        "stem", F.regexp_replace("filename", r"\.[^.]*$", "")
    )


def read_contracts(spark: SparkSession, *paths: str) -> DataFrame:
    """Contract texts, one row per file; blank files are dropped."""
    ours = [p for p in paths if text_files.holds(p)]
    frames = [text_files.open_texts(spark, p).select("path", "value") for p in ours]
    if others := [p for p in paths if p not in ours]:
        raw = spark.read.text(others, wholetext=True)
        frames.append(raw.select(F.col("_metadata.file_path").alias("path"), "value"))
    contracts = reduce(DataFrame.unionByName, frames)
    return contracts.withColumnRenamed("value", "query").filter(~is_blank(F.col("query")))


# A packed corpus: records of name and text; both marks are escaped in texts by the first.
RECORD, FIELD, ESCAPE = "\x1e", "\x1f", "\x1d"


def read_packed(spark: SparkSession, folder: str) -> DataFrame:
    """``path, name, text`` of the documents that ``writers.write_packed`` packed, many to a file.

    Files are split between tasks at the record mark, so neither few large nor many small files matter.
    """
    records = spark.read.option("lineSep", RECORD).text(folder).select(F.col("_metadata.file_path").alias("path"), "value")
    fields = F.split("value", FIELD, 2)
    text = fields[1]
    for code, mark in (("2", FIELD), ("1", RECORD), ("0", ESCAPE)):
        text = F.replace(text, F.lit(ESCAPE + code), F.lit(mark))
    return records.select("path", fields[0].alias("name"), text.alias("text"))


def join_pages(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Pages to documents in page order; a page without text counts as empty, blank line between."""
    page = F.struct(F.col("page_no"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = F.transform(F.array_sort(F.collect_list(page)), lambda p: p["text"])
    return pages.groupBy(doc).agg(
        F.array_join(ordered, "\n\n").alias("text"), F.count(F.lit(1)).cast("int").alias("pages")
    )


def drop_empty(documents: DataFrame, text: str = "text", blank: bool = False) -> DataFrame:
    """Drop documents whose extraction yielded nothing (``blank``: nothing but white space)."""
    if blank:
        return documents.filter(~is_blank(F.col(text)))
    return documents.filter(F.length(text) > 0)


def read_sections_csv(spark: SparkSession, path: str) -> DataFrame:
    """Section CSV with the required columns checked on the header; a large file is read by many tasks."""
    header = spark.read.options(**{**CSV_OPTIONS, "multiLine": False}).csv(path).columns
    missing = [c for c in schemas.REQUIRED_SECTION_COLUMNS if c not in header]
    if missing:
        raise ValueError(f"section file lacks required columns: {', '.join(missing)}")
    known = {f.name: f for f in schemas.SECTION_CSV.fields}
    fields = [known.get(c, T.StructField(c, T.StringType())) for c in header]
    # An empty cell stays an empty text, and words such as NA or null stay text.
    options = {k: str(v).lower() if isinstance(v, bool) else v for k, v in CSV_OPTIONS.items() if k != "header"}
    return quoted_csv.read_csv(spark, path, T.StructType(fields), {**options, "nullValue": "\x00", "emptyValue": ""})


def read_embedded_sections(spark: SparkSession, sections: str, vectors: str) -> DataFrame:
    """Sections with their vectors, joined on ``embedding_index``; unequal sides raise."""
    dataset = spark.read.parquet(sections)
    embeddings = spark.read.parquet(vectors).select("embedding_index", "embedding")
    check_alignment(dataset, embeddings)
    return dataset.join(embeddings, "embedding_index")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Embedding manifest; the default model name stands in for a missing file or field."""
    rows = _json_or(spark, path, schemas.MANIFEST, [(None, None, None, None)])
    return rows.withColumn("model_name", F.coalesce("model_name", F.lit(DEFAULT_MODEL)))


def open_collection(spark: SparkSession, path: str) -> DataFrame:
    """Collection table; a clear error when it was not built."""
    try:
        table = spark.read.parquet(path)
    except AnalysisException as error:
        raise FileNotFoundError(f"no vector collection at {path}; build it first") from error
    return schemas.require_columns(table, ("embedding_index", "embedding", "document"), "collection")


def read_test_cases(
    spark: SparkSession, path: str | None = None, multi_line: bool = True
) -> DataFrame:
    """Evaluation cases from JSON; the built-in set when there is no file.

    A JSON array is one record to Spark and is read by one task; large sets come as one case per
    line, with ``multi_line=False``.
    """
    cases = _json_or(spark, path, schemas.TEST_CASES, DEFAULT_CASES, multi_line)
    return cases.select(
        F.xxhash64("query", "category", "expected_sections").alias("case_id"),
        "query",
        F.coalesce("expected_sections", F.array().cast("array<string>")).alias("expected_sections"),
        F.coalesce("category", F.lit("unknown")).alias("category"),
    )


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Turns from saved conversation files, one row per turn in saved order."""
    files = spark.read.schema(schemas.HISTORY_FILE).json(path)
    return files.select(
        "session_id", F.posexplode("conversation_history").alias("turn_no", "turn")
    ).select(
        "session_id",
        F.col("turn_no").cast("long"),
        F.col("turn.timestamp").alias("timestamp"),
        "turn.query",
        "turn.response",
        "turn.metadata",
    )
