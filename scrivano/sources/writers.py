"""Writers. Tables are Parquet; CSV and JSON where the file itself is the interface."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrivano.operators.embedding import DEFAULT_MODEL, manifest
from scrivano.session import cut_lineage
from scrivano.sources.readers import ESCAPE, FIELD, RECORD

QUOTED = {
    "header": True,
    "quoteAll": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def write_cleaned(documents: DataFrame, path: str, doc: str = "doc_id", text: str = "text") -> None:
    documents.select(doc, text).write.mode("overwrite").parquet(path)


def write_packed(documents: DataFrame, path: str, name: str = "name", text: str = "text") -> None:
    """Documents packed many to a file, for ``readers.read_packed``; a null text is an empty one."""
    packed = F.coalesce(F.col(text), F.lit(""))
    for code, mark in (("0", ESCAPE), ("1", RECORD), ("2", FIELD)):
        packed = F.replace(packed, F.lit(mark), F.lit(ESCAPE + code))
    record = F.concat(F.col(name).cast("string"), F.lit(FIELD), packed)
    documents.select(record.alias("value")).write.mode("overwrite").option("lineSep", RECORD).text(path)


def document_manifest(documents: DataFrame) -> DataFrame:
    """``filename, stem, path, pages`` from documents with ``path`` and ``pages``."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return documents.select(
        name.alias("filename"),
        F.regexp_replace(name, r"(?<=.)\.[^.]*$", "").alias("stem"),
        "path",
        "pages",
    )


def write_manifest_csv(documents: DataFrame, path: str) -> None:
    document_manifest(documents).write.mode("overwrite").options(header=True, escape='"').csv(path)


def write_sections(sections: DataFrame, path: str, csv_path: str | None = None) -> None:
    sections.write.mode("overwrite").parquet(path)
    if csv_path:
        sections.write.mode("overwrite").options(**QUOTED).csv(csv_path)


def write_embeddings(
    embedded: DataFrame,
    vectors_path: str,
    sections_path: str,
    manifest_path: str,
    model: str = DEFAULT_MODEL,
    processing_time: float | None = None,
) -> None:
    """Vectors, the sections with their index, and the one-row manifest.

    ``embedded`` is computed once: it is kept in the shared checkpoint folder, and all outputs are
    derived from there, whatever encoded it.
    """
    kept = cut_lineage(embedded)
    kept.select("embedding_index", "embedding").write.mode("overwrite").parquet(vectors_path)
    kept.drop("embedding").write.mode("overwrite").parquet(sections_path)
    written = embedded.sparkSession.read.parquet(vectors_path)
    row = manifest(written, model).withColumn(
        "processing_time", F.lit(processing_time).cast("double")
    )
    row.coalesce(1).write.mode("overwrite").json(manifest_path)


def replace_collection(collection: DataFrame, path: str) -> None:
    collection.write.mode("overwrite").parquet(path)


def write_bucketed(collection: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """The collection as a table bucketed and sorted by ``embedding_index``, which has to be unique.

    Joins on the index then read the texts in place: only the other side is exchanged.
    """
    spark = collection.sparkSession
    collection.write.mode("overwrite").bucketBy(buckets, "embedding_index").sortBy("embedding_index").option(
        "path", path
    ).saveAsTable(table)
    written = spark.table(table)
    again = written.groupBy("embedding_index").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or embedding_index is null")
    if again.limit(1).count():
        raise ValueError("embedding_index is missing or not unique")
    return written


def create_collection(collection: DataFrame, path: str) -> bool:
    """Write the collection only where none exists; tells whether it was written.

    A folder without any file holds no collection. Any other fault of the folder is raised.
    """
    spark = collection.sparkSession
    try:
        spark.read.parquet(path)
        return False
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    collection.write.mode("append").parquet(path)
    return True


def write_evaluation(per_case: DataFrame, report: DataFrame, path: str) -> None:
    """Per-case rows and the report as JSON lines in two folders below ``path``."""
    per_case.write.mode("overwrite").json(f"{path}/cases")
    report.write.mode("overwrite").json(f"{path}/report")


def history_records(turns: DataFrame, saved_at: str, max_history: int = 10) -> DataFrame:
    """One record per session with its retained turns in order, as saved to a file."""
    newest = Window.partitionBy("session_id").orderBy(F.col("turn_no").desc())
    kept = turns.withColumn("_back", F.row_number().over(newest)).filter(
        F.col("_back") <= max_history
    )
    turn = F.struct("turn_no", "timestamp", "query", "response", "metadata")
    ordered = F.transform(
        F.array_sort(F.collect_list(turn), lambda a, b: (a["turn_no"] - b["turn_no"]).cast("int")),
        lambda t: t.dropFields("turn_no"),
    )
    return kept.groupBy("session_id").agg(ordered.alias("conversation_history")).withColumn(
        "saved_at", F.lit(saved_at)
    )


def write_history(turns: DataFrame, path: str, saved_at: str, max_history: int = 10) -> None:
    history_records(turns, saved_at, max_history).write.mode("overwrite").json(path)


def write_json_records(records: DataFrame, path: str) -> None:
    """One JSON text per line, from a frame with a ``json`` column."""
    records.select("json").write.mode("overwrite").text(path)
