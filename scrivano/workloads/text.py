"""Cleaning queries over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrivano.functions import text as tx
from scrivano.sources import readers, writers
from scrivano.workloads import Registry, table

REGISTRY = Registry()

# Faults put into the documents: doubled letters, doubled marks, page numbers, carriage returns.
_MARKED = """replace(replace(replace(replace({x}, ', ',
  case when doc_id % 3 = 0 then ',, ' else ', ' end), '. ',
  case when doc_id % 3 = 1 then '.. ' when doc_id % 7 = 2 then '... ' else '. ' end), ' de ',
  case when doc_id % 4 = 1 then '--' else ' de ' end), chr(10),
  case when doc_id % 5 = 0 then chr(13) || chr(10) when doc_id % 5 = 1
    then chr(10) || chr(10) || ' 12 ' || chr(10) || chr(10) || chr(10)
    when doc_id % 5 = 2 then ' page 3 OF 9' || chr(10) else chr(10) end)"""
_DOUBLED_SPARK = "case when doc_id % 2 = 0 then regexp_replace(text, '([A-Za-z0-9])', '$1$1') else text end"
_DOUBLED_SQL = (
    r"case when doc_id % 2 = 0 then regexp_replace(text, '([A-Za-z0-9])', '\1\1', 'g') else text end"
)


def _documents(spark, sf_dir, doubled=True, marked=True):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    if doubled:
        docs = docs.withColumn("text", F.expr(_DOUBLED_SPARK))
    if marked:
        docs = docs.withColumn("text", F.expr(_MARKED.format(x="text")))
    return docs


def _sql_documents(doubled=True, marked=True):
    inner = f"select doc_id, {_DOUBLED_SQL if doubled else 'text'} as text from documents"
    outer = _MARKED.format(x="text") if marked else "text"
    return f"src as (select doc_id, {outer} as text from ({inner}))"


def _sql_letters(source, name):
    """SQL has no back-references: one replacement per letter and digit that may be doubled."""
    ascii_chars = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    accented = "äöüßéèêçñíóÄÖÜÉÈÊÇÑÍÓ"
    collapsed = "text"
    for char in ascii_chars + accented:
        collapsed = f"replace({collapsed}, '{char}{char}', '{char}')"
    pairs = "|".join(c + c for c in ascii_chars)
    return f"""{name} as (select doc_id, case when alnum > 30 and pairs / alnum > 0.2
      then {collapsed} else text end as text from (select doc_id, text,
        len(regexp_extract_all(text, '{pairs}'))::double as pairs,
        len(regexp_extract_all(text, '[A-Za-z0-9]'))::double as alnum
      from {source}))"""


def _sql_marks(source, name):
    fixed = "text"
    for pair in tx.DOUBLED_MARKS:
        quoted, single = pair.replace("'", "''"), pair[0].replace("'", "''")
        gate = f"case when contains(head, '{quoted}') then '{quoted}' else chr(7) end"
        fixed = f"replace({fixed}, {gate}, '{single}')"
    word = r"[\p{L}\p{N}_]"
    return f"""{name} as (select doc_id, case when regexp_matches(head, '{word}--{word}')
      then regexp_replace(text, '({word})--({word})', '\\1-\\2', 'g') else text end as text
      from (select doc_id, head, {fixed} as text
        from (select doc_id, text, text as head from {source})))"""


def _sql_basic(source, name):
    out = r"regexp_replace(replace(text, chr(13), chr(10)), '\n{2,}', chr(10) || chr(10), 'g')"
    out = rf"regexp_replace({out}, 'Page\s*\d+\s*of\s*\d+', '', 'gi')"
    out = rf"regexp_replace({out}, '(?m)^\s*\d+\s*$', '', 'g')"
    out = rf"regexp_replace({out}, '^\s+|\s+$', '', 'g')"
    return f"{name} as (select doc_id, {out} as text from {source})"


@REGISTRY.add(
    "fix_double_characters",
    f"with {_sql_documents(marked=False)}, {_sql_letters('src', 'done')} select * from done",
)
def fix_double_characters(spark, sf_dir):
    return tx.with_collapsed_letters(_documents(spark, sf_dir, marked=False))


@REGISTRY.add(
    "fix_double_punctuation",
    f"with {_sql_documents(doubled=False)}, {_sql_marks('src', 'done')} select * from done",
)
def fix_double_punctuation(spark, sf_dir):
    return tx.with_collapsed_marks(_documents(spark, sf_dir, doubled=False))


@REGISTRY.add(
    "clean_text",
    f"with {_sql_documents()}, {_sql_letters('src', 'a')}, {_sql_marks('a', 'b')}, "
    f"{_sql_basic('b', 'done')} select * from done",
)
def clean_text(spark, sf_dir):
    return tx.clean_text(_documents(spark, sf_dir))


@REGISTRY.add(
    "size_change",
    f"""with {_sql_documents()}, {_sql_basic('src', 'done')},
    pair as (select s.doc_id, s.text as a, d.text as b from src s join done d using (doc_id)),
    lines as (select *, len(regexp_extract_all(a, '\\r\\n|\\r|\\n'))
        + (case when a <> '' and not regexp_matches(a, '[\\r\\n]$') then 1 else 0 end) as la,
      len(regexp_extract_all(b, '\\n'))
        + (case when b <> '' and not regexp_matches(b, '\\n$') then 1 else 0 end) as lb from pair)
    select doc_id, len(a) as chars_before, len(b) as chars_after, la as lines_before,
      lb as lines_after, len(a) - len(b) as removed_chars,
      round(case when len(a) > 0 then (len(a) - len(b)) / len(a) * 100 else 0 end, 6) as removed_pct
    from lines""",
)
def size_change(spark, sf_dir):
    both = _documents(spark, sf_dir).withColumn("cleaned", tx.basic_clean(F.col("text")))
    sizes = tx.size_change(F.col("text"), F.col("cleaned"))
    sizes = {
        name: F.round(c, 6) if name == "removed_pct" else c.cast("long") for name, c in sizes.items()
    }
    return both.select("doc_id", *[c.alias(n) for n, c in sizes.items()])


@REGISTRY.add(
    "split_lines",
    f"""with {_sql_documents()}, unified as (select doc_id,
      string_split(regexp_replace(text, '\\r\\n|\\r', chr(10), 'g'), chr(10)) as parts from src),
    lines as (select doc_id, unnest(parts) as line, generate_subscripts(parts, 1) as line_no,
      len(parts) as n from unified)
    select doc_id, line_no, line from lines where line_no < n or line <> ''""",
)
def split_lines(spark, sf_dir):
    lines = F.posexplode(tx.lines_of(F.col("text"))).alias("pos", "line")
    return _documents(spark, sf_dir).select("doc_id", lines).select(
        "doc_id", (F.col("pos") + 1).cast("long").alias("line_no"), "line"
    )


@REGISTRY.add(
    "collapse_blank_lines",
    f"""with {_sql_documents()} select doc_id,
      regexp_replace(text, '\\n{{3,}}', chr(10) || chr(10), 'g') as text from src""",
)
def collapse_blank_lines(spark, sf_dir):
    return _documents(spark, sf_dir).select(
        "doc_id", tx.collapse_blank_lines(F.col("text")).alias("text")
    )


@REGISTRY.add(
    "text_previews",
    """select doc_id, substr(text, 1, 500) || case when len(text) > 500 then '...' else '' end as
      shown, substr(text, 1, 200) || '...' as quoted, substr(text, 1, 60) as listed from documents""",
)
def text_previews(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        tx.preview(text, 500, "if_cut").alias("shown"),
        tx.preview(text, 200, "always").alias("quoted"),
        tx.preview(text, 60).alias("listed"),
    )


# Pages: the lines of a document, every ninth page without extracted text.
@REGISTRY.add(
    "join_pages",
    """with pages_of as (select doc_id, unnest(string_split(text, chr(10))) as text,
      generate_subscripts(string_split(text, chr(10)), 1) as page_no from documents)
    select doc_id, string_agg(case when page_no % 9 = 4 then '' else text end,
      chr(10) || chr(10) order by page_no) as text, count(*) as pages from pages_of group by doc_id""",
)
def join_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "text")
    )
    page_no = F.col("pos") + 1
    pages = pages.select(
        "doc_id", page_no.alias("page_no"), F.when(page_no % 9 != 4, F.col("text")).alias("text")
    )
    return readers.join_pages(pages).withColumn("pages", F.col("pages").cast("long"))


_EMPTIED = "case when doc_id % 6 = 0 then '' when doc_id % 6 = 1 then chr(10) || ' ' else text end"


@REGISTRY.add(
    "drop_empty_documents",
    f"""select doc_id, len({_EMPTIED}) as chars, trim({_EMPTIED}, chr(10) || ' ') <> '' as has_text
    from documents where {_EMPTIED} <> ''""",
)
def drop_empty_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(_EMPTIED).alias("text"))
    return readers.drop_empty(docs).select(
        "doc_id",
        F.length("text").cast("long").alias("chars"),
        (~tx.is_blank(F.col("text"))).alias("has_text"),
    )


_PATH = "'/corpus/' || lang || '/' || source || '.' || doc_id || '.txt'"


@REGISTRY.add(
    "document_manifest",
    f"""select regexp_extract(path, '[^/]*$') as filename,
      regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '') as stem, path, pages
    from (select {_PATH} as path, len(string_split(text, chr(10))) as pages from documents)""",
)
def document_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.expr(_PATH).alias("path"), F.size(F.split("text", "\n", -1)).cast("long").alias("pages")
    )
    return writers.document_manifest(docs)
