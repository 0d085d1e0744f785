"""From cleaned document text to numbered sections, without a shuffle.

A document is one row, so everything about its lines can be decided inside that row. Two idioms
carry the state that a line-by-line reader would keep:

* every line is reduced to a one-letter class, and the sequence of classes becomes a short string;
  a rule such as "skip entries until the table of contents closes" is then a regular expression
  over that string;
* section starts are marked with control characters that cannot occur inside a line, so ``split``
  yields the sections of a document as an array, which is exploded.

The lines of a document are never exploded into rows and never moved between executors; the plan
is a chain of projections over the scan, and it scales with the number of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivano.functions.text import collapse_blank_lines, lines_of, strip

# Headers, leader lines and section numbers as they appear in the corpus.
STANDARD_WITH_NUMBER = r"(?iuU)Shari['’]ah Standard No\.[\s\x1c-\x1f]*\((\d+)\)"
CLOSES_CONTENTS = r"(?iuU)Shari['’]ah Standard No\.|^\d+//"
LEADER_LINE = r"(?dU)^[A-Z][^:]*\.{3,}[\s\x1c-\x1f]*\d+$"
CONTENTS_TITLES = ("Contents", "Table of Contents")
SUBJECT_TITLE = "Subject Page"
TOC_PATTERNS = (
    r"(?dU)\.{3,}[\s\x1c-\x1f]*\d+$",
    r"(?dU)^\d+//\d+(?://\d+)?,.*\.{3,}[\s\x1c-\x1f]*\d+",
    r"(?dU)^\d+\.[\s\x1c-\x1f]+.*\.{3,}[\s\x1c-\x1f]*\d+$",
    r"(?diuU)^Appendix[\s\x1c-\x1f]*\([a-z]\):.*\.{3,}[\s\x1c-\x1f]*\d+$",
    r"(?dU)^\d+//\d+(?://\d+)?,\d+//\d+(?://\d+)?,.*\.{3,}",
)
NUMBER_LIST = r"(?dU)^\d+//\d+(?://\d+)?,\d+//\d+(?://\d+)?,"
LEADER_INSIDE = r"(?dU)\.{3,}[\s\x1c-\x1f]*\d+"
SECTION_HEADER = r"(?dU)^(\d+)(?://(\d+)(?://(\d+))?)?[\s\x1c-\x1f]+(.+)$"
APPENDIX_TITLES = ("Appendices", "Appendix")
STANDARD_HEADER_CURLY = r"(?iuU)^Shari’ah Standard No\."
REVISION_NOTE = "(Revised Standard)"

# Control characters that end a line and so never occur inside one.
FLUSH, FIELD, SECTION = "\x1c", "\x1d", "\x1e"


def _rlike(col: Column, pattern: str) -> Column:
    return F.regexp_like(col, F.lit(pattern))


def _with_leader(line: Column, *patterns: str) -> Column:
    """Any of ``patterns``, all of which need three dots: a byte search spares most lines the rest."""
    hit = _rlike(line, patterns[0])
    for pattern in patterns[1:]:
        hit = hit | _rlike(line, pattern)
    return F.contains(line, F.lit("...")) & hit


def is_toc_entry(line: Column) -> Column:
    """Any of the five table-of-contents shapes, on an already stripped line."""
    return _with_leader(line, *TOC_PATTERNS)


def cut_to_first_standard(df: DataFrame, text: str = "text") -> DataFrame:
    """Text from the first numbered standard header on; documents without one yield no row."""
    tail = F.regexp_extract(F.col(text), rf"{STANDARD_WITH_NUMBER}(?s:.*)", 0)
    return df.withColumn(text, tail).filter(F.col(text) != "")


def _kept(lines: Column, flags: Column, keep: str) -> Column:
    """The elements of ``lines`` whose one-letter flag is ``keep``."""
    pairs = F.zip_with(lines, flags, lambda x, c: F.struct(x.alias("x"), c.alias("c")))
    return F.transform(F.filter(pairs, lambda p: p["c"] == keep), lambda p: p["x"])


def _classes(stripped_lines: Column, classify) -> Column:
    return F.array_join(F.transform(stripped_lines, classify), "")


def drop_contents_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """Remove contents tables and leader lines, collapse blank runs: the cleaned document text.

    Classes: ``c`` opens a contents table; ``d`` is an entry, dropped in and outside a table;
    ``s`` is an entry that names a standard or section: inside a table it closes the table and
    stays, outside it goes; ``k`` stays. An ``s`` is inside a table exactly when only ``d`` lines lie
    between it and the nearest ``c``.
    """

    def classify(line):
        entry = (line == SUBJECT_TITLE) | _with_leader(line, LEADER_LINE)
        return (
            F.when(line.isin(*CONTENTS_TITLES), "c")
            .when(~entry, "k")
            .when(_rlike(line, CLOSES_CONTENTS), "s")
            .otherwise("d")
        )

    staged = df.withColumn("_lines", lines_of(F.col(text)))
    codes = _classes(F.transform(F.col("_lines"), strip), classify)
    flags = F.split(F.regexp_replace(codes, "(cd*)s", "$1k"), "")
    return staged.withColumn(
        text, collapse_blank_lines(F.array_join(_kept(F.col("_lines"), flags, "k"), "\n"))
    ).drop("_lines")


def _tag_line(line: Column, index: Column) -> Column:
    """Line as it enters the section text: marked header, flush mark, plain text, or null (gone)."""
    gone = (
        is_toc_entry(line)
        | line.isin(*APPENDIX_TITLES)
        | (_with_leader(line, LEADER_INSIDE) & _rlike(line, NUMBER_LIST))
    )
    path = F.concat_ws(
        "//",
        *[F.nullif(F.regexp_extract(line, SECTION_HEADER, g), F.lit("")) for g in (1, 2, 3)],
    )
    title = F.regexp_extract(line, SECTION_HEADER, 4)
    header = F.concat(
        F.lit(SECTION), (index + 1).cast("string"), F.lit(FIELD), path, F.lit(FIELD), title
    )
    names_standard = F.contains(line, F.lit("’")) & _rlike(line, STANDARD_HEADER_CURLY)
    body = (line != "") & (line != REVISION_NOTE) & ~names_standard
    return (
        F.when(gone, F.lit(None).cast("string"))
        .when(
            _rlike(line, SECTION_HEADER),
            F.when(_with_leader(title, LEADER_INSIDE), F.lit(FLUSH)).otherwise(header),
        )
        .when(body, line)
    )


def extract_sections(
    df: DataFrame, text: str = "text", doc: str = "doc_id", emit_prefixes: bool = True
) -> DataFrame:
    """Split cleaned text into section rows.

    A header whose title holds leader dots emits the section collected so far and leaves it open,
    so a section with *f* such lines appears *f* + 1 times, each time a longer prefix.
    ``emit_prefixes=False`` keeps only the longest.
    """
    stripped = F.transform(lines_of(F.col(text)), strip)
    marked = F.array_join(F.transform(stripped, _tag_line), "\n")
    sections = F.split(marked, SECTION, -1)
    # The outer form keeps the optimizer from testing the array first, that is, computing it twice.
    rows = df.select(
        doc, F.explode_outer(F.slice(sections, F.lit(2), F.length(F.col(text)) + 1)).alias("s")
    )
    fields = F.split(F.col("s"), FIELD, 3)
    rows = rows.filter(F.col("s").isNotNull()).select(
        doc,
        fields[0].cast("int").alias("line_number"),
        fields[1].alias("section_path"),
        F.split(fields[2], rf"\n?{FLUSH}", -1).alias("parts"),
    )
    count = F.size("parts")
    first = F.lit(1) if emit_prefixes else count
    rows = rows.select(
        doc,
        "line_number",
        "section_path",
        "parts",
        F.explode_outer(F.sequence(first, count)).alias("n"),
    )
    return (
        rows.withColumn(
            "content",
            strip(F.array_join(F.slice(F.col("parts"), F.lit(1), F.col("n")), "")),
        )
        .filter(F.col("content") != "")
        .select(
            doc,
            F.col("section_path").alias("section_number"),
            "section_path",
            "content",
            F.length("content").alias("content_length"),
            "line_number",
        )
    )


def drop_toc_sections(sections: DataFrame) -> DataFrame:
    """Drop sections that are mostly or wholly table-of-contents lines, whatever their length."""
    content = F.col("content")
    lines = F.split(content, "\n", -1)
    toc_lines = F.size(F.filter(F.transform(lines, strip), is_toc_entry))
    total = F.regexp_count(content, F.lit("\n")) + 1
    mostly = F.contains(content, F.lit("...")) & (toc_lines > total * 0.5)
    return sections.filter(~(mostly | is_toc_entry(strip(content))))


def sectionize(
    documents: DataFrame, text: str = "text", doc: str = "doc_id", emit_prefixes: bool = True
) -> DataFrame:
    """Documents to section rows: cut, drop contents, split, filter. All documents are unioned."""
    cut = cut_to_first_standard(documents.select(doc, text), text)
    cleaned = drop_contents_lines(cut, text)
    return drop_toc_sections(extract_sections(cleaned, text, doc, emit_prefixes))


def corpus_totals(sections: DataFrame) -> DataFrame:
    return sections.agg(
        F.count(F.lit(1)).alias("sections"),
        F.coalesce(F.sum(F.col("content_length").cast("long")), F.lit(0)).alias("total_length"),
    )


def first_sections(sections: DataFrame, n: int = 10, doc: str = "doc_id") -> DataFrame:
    """The report's first ``n`` sections in corpus order."""
    return (
        sections.orderBy(doc, "line_number", "content_length")
        .limit(n)
        .select(doc, "section_number", "content_length")
    )
