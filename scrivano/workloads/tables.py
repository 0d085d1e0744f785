"""Sources and sinks: whole tables are written to the shared scratch folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrivano.operators import embedding as emb
from scrivano.operators import evaluation as ev
from scrivano.session import scratch_path
from scrivano.sources import readers, text_files, writers
from scrivano.workloads import Registry, evaluation, search, table

REGISTRY = Registry()


@REGISTRY.add(
    "corpus_files",
    "select doc_id, text || chr(10) as text, doc_id || '' as folder from documents",
)
def corpus_files(spark, sf_dir):
    """One text file per document, scanned as whole texts."""
    folder = scratch_path(spark, "corpus")
    name = F.concat(F.lit("doc_id="), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(".txt"))
    text_files.write_texts(table(spark, sf_dir, "documents").select(name.alias("name"), F.col("text").alias("value")), folder)
    corpus = readers.read_corpus(spark, folder)
    number = F.nullif(F.regexp_extract("path", r"/doc_id=(-?\d*)\.txt$", 1), F.lit(""))
    return corpus.select(
        number.cast("long").alias("doc_id"), "text", number.alias("folder")
    )


@REGISTRY.add("packed_corpus", "select doc_id, text from documents")
def packed_corpus(spark, sf_dir):
    """The corpus in a few large files, split between tasks by records."""
    folder = scratch_path(spark, "packed")
    writers.write_packed(table(spark, sf_dir, "documents"), folder, name="doc_id")
    corpus = readers.read_packed(spark, folder)
    return corpus.select(F.col("name").cast("long").alias("doc_id"), "text")


@REGISTRY.add(
    "contract_files",
    r"select turn, conv_id, text || chr(10) as query from conversations where regexp_matches(text, '\S')",
)
def contract_files(spark, sf_dir):
    """Contracts read by path; every message is a file."""
    folder = scratch_path(spark, "contracts")
    turn, conv = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("turn", "conv_id"))
    name = F.concat(F.lit("turn="), turn, F.lit(",conv_id="), conv, F.lit(".txt"))
    text_files.write_texts(table(spark, sf_dir, "conversations").select(name.alias("name"), F.col("text").alias("value")), folder)
    contracts = readers.read_contracts(spark, folder)
    return contracts.select(
        *[
            F.nullif(F.regexp_extract("path", rf"[/,]{c}=(-?\d*)[,.][^/]*$", 1), F.lit("")).cast("long").alias(c)
            for c in ("turn", "conv_id")
        ],
        "query",
    )


@REGISTRY.add(
    "sections_csv_split",
    """select 'n' || doc_id as section_number, lang || '//' || doc_id as section_path,
      replace(text, ' ', ' "' || chr(10)) as content, doc_id as line_number from documents""",
)
def sections_csv_split(spark, sf_dir):
    """Files whose cells are full of quotes and line breaks, one per writing task, read in many byte ranges."""
    sections = table(spark, sf_dir, "documents").select(
        F.expr("'n' || doc_id").alias("section_number"),
        F.expr("lang || '//' || doc_id").alias("section_path"),
        F.replace(F.col("text"), F.lit(" "), F.lit(' "\n')).alias("content"),
        F.length("text").alias("content_length"),
        F.col("doc_id").cast("int").alias("line_number"),
    )
    plain, csv = scratch_path(spark, "sections"), scratch_path(spark, "sections-csv")
    writers.write_sections(sections, plain, csv)
    back = readers.read_sections_csv(spark, csv)
    return back.drop("content_length").withColumn("line_number", F.col("line_number").cast("long"))


_CONTENT = "'say \"' || text || '\", NA' || chr(10) || ' null '"


@REGISTRY.add(
    "sections_csv",
    f"""select 'n' || doc_id as section_number, lang || '//' || doc_id as section_path,
      {_CONTENT} as content, len({_CONTENT}) as content_length, doc_id as line_number
    from documents""",
)
def sections_csv(spark, sf_dir):
    """Section table to Parquet and CSV; the CSV is read with its header checked."""
    sections = table(spark, sf_dir, "documents").select(
        F.expr("'n' || doc_id").alias("section_number"),
        F.expr("lang || '//' || doc_id").alias("section_path"),
        F.expr(_CONTENT).alias("content"),
        F.expr(f"length({_CONTENT})").alias("content_length"),
        F.col("doc_id").cast("int").alias("line_number"),
    )
    plain, csv = scratch_path(spark, "sections"), scratch_path(spark, "sections-csv")
    writers.write_sections(sections, plain, csv)
    back = readers.read_sections_csv(spark, csv)
    return back.withColumn("content_length", F.col("content_length").cast("long")).withColumn(
        "line_number", F.col("line_number").cast("long")
    )


@REGISTRY.add(
    "cleaned_documents", "select doc_id, text from documents"
)
def cleaned_documents(spark, sf_dir):
    path = scratch_path(spark, "cleaned")
    writers.write_cleaned(table(spark, sf_dir, "documents"), path)
    return spark.read.parquet(path)


@REGISTRY.add(
    "manifest_csv",
    """select regexp_extract(url, '[^/]*$') as filename,
      regexp_replace(regexp_extract(url, '[^/]*$'), '(.)\\.[^.]*$', '\\1') as stem, url as path,
      len(html) as pages from pages""",
)
def manifest_csv(spark, sf_dir):
    path = scratch_path(spark, "manifest")
    pages = table(spark, sf_dir, "pages").select(
        F.col("url").alias("path"), F.length("html").alias("pages")
    )
    writers.write_manifest_csv(pages, path)
    schema = "filename string, stem string, path string, pages long"
    return spark.read.schema(schema).options(**readers.CSV_OPTIONS, nullValue="\x00").csv(path)


@REGISTRY.add(
    "embedded_sections",
    """select vec_id as embedding_index, 'label ' || label as content,
      round(list_sum(list_transform(embedding, lambda x: x::double)), 4) as total,
      'hashed' as model_name, 64::bigint as embedding_dimension,
      (select count(*) from embeddings) as num_embeddings
    from embeddings""",
)
def embedded_sections(spark, sf_dir):
    """Vectors, indexed sections and manifest, written and joined back by index."""
    embedded = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("embedding_index"),
        F.concat(F.lit("label "), F.col("label")).alias("content"),
        "embedding",
    )
    vectors, sections, about = (scratch_path(spark, x) for x in ("vectors", "indexed", "about"))
    writers.write_embeddings(embedded, vectors, sections, about, "hashed")
    row = readers.read_manifest(spark, about).first()
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return readers.read_embedded_sections(spark, sections, vectors).select(
        "embedding_index",
        "content",
        F.round(total, 4).alias("total"),
        F.lit(row.model_name).alias("model_name"),
        F.lit(row.embedding_dimension).cast("long").alias("embedding_dimension"),
        F.lit(row.num_embeddings).cast("long").alias("num_embeddings"),
    )


@REGISTRY.add(
    "collection_table",
    f"""with {search._SQL_SECTIONS} select 'section_' || doc_id as id, doc_id as embedding_index,
      content as document, section_number, section_path, content_length, 256::bigint as dimension
    from sections""",
)
def collection_table(spark, sf_dir):
    """Collection replaced, then not created again because it exists, then opened."""
    path = scratch_path(spark, "collection")
    collection = search._collection(spark, sf_dir)
    writers.replace_collection(collection, path)
    if writers.create_collection(collection.limit(0), path):
        raise AssertionError("an existing collection was written again")
    return readers.open_collection(spark, path).select(
        "id",
        "embedding_index",
        "document",
        "section_number",
        "section_path",
        F.col("content_length").cast("long").alias("content_length"),
        F.size("embedding").cast("long").alias("dimension"),
    )


@REGISTRY.add(
    "test_case_files",
    f"""select 'vector ' || vec_id as query, array_to_string({evaluation._EXPECTED_SQL}, ' ')
      as expected, coalesce({evaluation._CATEGORY}, 'unknown') as category from embeddings""",
)
def test_case_files(spark, sf_dir):
    path = scratch_path(spark, "cases")
    cases, _ = evaluation._cases_and_hits(spark, sf_dir)
    cases.drop("case_id").write.json(path)
    loaded = readers.read_test_cases(spark, path, multi_line=False)
    return loaded.select(
        "query", F.array_join("expected_sections", " ").alias("expected"), "category"
    )


@REGISTRY.add(
    "evaluation_files",
    f"""with {evaluation._SQL_PER_CASE} select case_id, round(mrr, 6) as mrr,
      round(precision_at_5, 6) as precision_at_5 from per_case""",
)
def evaluation_files(spark, sf_dir):
    path = scratch_path(spark, "results")
    per_case, report = ev.run(*evaluation._cases_and_hits(spark, sf_dir))
    writers.write_evaluation(per_case, report, path)
    schema = "case_id long, mrr double, precision_at_5 double"
    back = spark.read.schema(schema).json(f"{path}/cases")
    return back.select(
        "case_id", F.round("mrr", 6).alias("mrr"), F.round("precision_at_5", 6).alias("precision_at_5")
    )


@REGISTRY.add(
    "section_identifiers",
    "select vec_id, 'section_' || vec_id as id from embeddings",
)
def section_identifiers(spark, sf_dir):
    vecs = table(spark, sf_dir, "embeddings")
    return vecs.select("vec_id", emb.section_id(F.col("vec_id")).alias("id"))
