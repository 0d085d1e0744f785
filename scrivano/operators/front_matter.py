"""Remove front matter: contents tables, prefaces and everything before the first standard.

The rule is a small automaton over lines. As in :mod:`scrivano.operators.sections`, lines become
one-letter classes, and one regular expression cuts the class string into the pieces that the
automaton would consume: a contents table with the line that closes it, a preface up to the line
that ends it, or a single line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivano.functions.text import collapse_blank_lines, lines_of, strip
from scrivano.operators.sections import (
    CONTENTS_TITLES,
    LEADER_LINE,
    SUBJECT_TITLE,
    _classes,
    _kept,
    _rlike,
    _with_leader,
)

# This remover knows the straight apostrophe only.
FIRST_STANDARD = r"(?iuU)Shari'ah Standard No\.[\s\x1c-\x1f]*\((\d+)\)"
NAMES_STANDARD = r"(?iu)Shari'ah Standard No\."
STATEMENT = r"(?iu)Statement of the Standard"
SECTION_START = r"(?U)^\d+//"
PREFACE_LEADER = r"(?dU)^Preface[\s\x1c-\x1f]*\.{3,}[\s\x1c-\x1f]*\d+$"
PREFACE = "Preface"

# Line classes. Lower case: leader lines and titles that go; upper case: lines that stay.
#   c, t the two contents titles   p subject-page title   b blank   q bare preface title
#   f preface leader
#   plain / with statement / with standard name / with both:  leader lines g h i j, others K L M N
#   S starts with a section number
IN_CONTENTS = "ctpbfgh"  # swallowed while a contents table is open
ENDS_PREFACE = "hjLNS"  # ends a preface that carried a leader
ENDS_BARE_PREFACE = "hijLMNS"  # ends a bare preface title
PIECES = (
    rf"[ct][{IN_CONTENTS}]*[^{IN_CONTENTS}]?"
    rf"|f[^{ENDS_PREFACE}]*"
    rf"|q[bcp][^{ENDS_BARE_PREFACE}]*"
    r"|."
)


def _classify(line):
    leader = _with_leader(line, LEADER_LINE)
    statement = _rlike(line, STATEMENT)
    named = _rlike(line, NAMES_STANDARD)

    def kind(plain, with_statement, with_name, both):
        return (
            F.when(statement & named, both)
            .when(statement, with_statement)
            .when(named, with_name)
            .otherwise(plain)
        )

    return (
        F.when(line == "", "b")
        .when(line == CONTENTS_TITLES[0], "c")
        .when(line == CONTENTS_TITLES[1], "t")
        .when(line == SUBJECT_TITLE, "p")
        .when(line == PREFACE, "q")
        .when(_rlike(line, SECTION_START), "S")
        .when(_with_leader(line, PREFACE_LEADER), "f")
        .when(leader, kind("g", "h", "i", "j"))
        .otherwise(kind("K", "L", "M", "N"))
    )


def _flags(piece):
    """One flag per line of a piece: ``k`` kept, ``x`` dropped."""
    size = F.length(piece)
    first = F.substring(piece, 1, 1)
    closed = F.regexp_like(piece, F.lit(rf"[^{IN_CONTENTS}]\z"))
    dropped = F.repeat(F.lit("x"), size)
    return (
        F.when(
            first.isin("c", "t"),
            F.when(closed, F.concat(F.repeat(F.lit("x"), size - 1), F.lit("k"))).otherwise(dropped),
        )
        .when(first.isin("f", "p", "g", "h", "i", "j") | (size > 1), dropped)
        .otherwise(F.lit("k"))
    )


def remove_front_matter(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace ``text`` by its content from the first standard on, without front matter."""
    staged = df.withColumn("_lines", lines_of(F.col(text)))
    staged = staged.withColumn(
        "_first",
        F.array_position(
            F.transform(F.col("_lines"), lambda x: _rlike(strip(x), FIRST_STANDARD)), True
        ),
    )
    everything = F.size("_lines") + 1
    start = F.greatest(F.col("_first").cast("int"), F.lit(1))
    staged = staged.withColumn("_rest", F.slice(F.col("_lines"), start + 1, everything))
    codes = _classes(F.transform(F.col("_rest"), strip), _classify)
    pieces = F.regexp_extract_all(codes, F.lit(PIECES), F.lit(0))
    flags = F.split(F.array_join(F.transform(pieces, _flags), ""), "")
    body = F.concat(
        F.slice(F.col("_lines"), start, F.lit(1)), _kept(F.col("_rest"), flags, "k")
    )
    cleaned = strip(collapse_blank_lines(F.array_join(body, "\n")))
    return staged.withColumn(
        text, F.when(F.col("_first") > 0, cleaned).when(F.col(text).isNotNull(), F.lit(""))
    ).drop("_lines", "_first", "_rest")
