"""Text columns: strip, line splitting, document cleaning and size statistics.

Patterns are Java regexes. ``(?U)`` gives Unicode ``\\s`` and ``\\d``; ``(?d)`` makes ``.``, ``^`` and
``$`` see only ``\\n``. The four information separators ``\\x1c-\\x1f`` count as white space as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f]"
BREAKS = r"\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"
BREAK = rf"\r\n|[{BREAKS}]"
# The same boundaries, in the form that is quickest to count.
COUNTED_BREAK = r"\R|[\x1c-\x1e]"

# The characters that Unicode and the separators above count as white space.
WHITE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# The thresholds that decide whether a text was extracted doubled.
MIN_ALNUM = 30
DOUBLED_RATIO = 0.20

# Doubled marks that collapse to one, in the order in which they are applied.
DOUBLED_MARKS = (",,", "..", "::", ";;", "''", "``", "((", "))", "’’")


def strip(col: Column) -> Column:
    """Remove leading and trailing Unicode white space (plain ``trim`` removes spaces only)."""
    return F.trim(col, F.lit(WHITE))


def is_blank(col: Column) -> Column:
    return F.length(strip(col)) == 0


def lines_of(col: Column) -> Column:
    """Array of lines without terminators: every Unicode boundary splits, no empty last element."""
    without_last_break = F.regexp_replace(col, rf"(?:{BREAK})\z", "")
    return F.when(col == "", F.array().cast("array<string>")).otherwise(
        F.split(without_last_break, BREAK, -1)
    )


def collapse_doubled_letters(col: Column) -> Column:
    """Collapse each equal alphanumeric pair when the text shows the doubled-extraction fault."""
    pairs = F.regexp_count(col, F.lit(r"([A-Za-z0-9])\1"))
    # Whole runs are taken out, which needs a match per word instead of one per character.
    alnum = F.length(col) - F.length(F.regexp_replace(col, "[A-Za-z0-9]+", ""))
    doubled = (alnum > MIN_ALNUM) & (pairs / alnum > DOUBLED_RATIO)
    return F.when(doubled, F.regexp_replace(col, r"([\p{L}\p{N}])\1", "$1")).otherwise(col)


def with_collapsed_letters(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn(text, collapse_doubled_letters(F.col(text)))


def with_collapsed_marks(df: DataFrame, text: str = "text") -> DataFrame:
    """Collapse doubled punctuation; each mark is gated by the *incoming* text.

    ``replace`` with an empty search string returns its input, so a closed gate costs nothing and
    the text is referenced once per step, which keeps the expression linear in the number of marks.
    """
    whole = F.col(text)
    fixed = F.col(text)
    for pair in DOUBLED_MARKS:
        gate = F.when(F.contains(whole, F.lit(pair)), F.lit(pair)).otherwise(F.lit(""))
        fixed = F.replace(fixed, gate, F.lit(pair[0]))
    word = r"[\p{L}\p{N}_]"
    open_gate = F.contains(whole, F.lit("--")) & F.regexp_like(whole, F.lit(f"{word}--{word}"))
    # A closed gate runs no pattern over the text.
    return df.withColumn(
        text, F.when(open_gate, F.regexp_replace(fixed, f"({word})--({word})", "$1-$2")).otherwise(fixed)
    )


def basic_clean(col: Column) -> Column:
    """Newline normalisation, page-number removal and strip."""
    out = F.replace(col, F.lit("\r"), F.lit("\n"))
    out = F.regexp_replace(out, r"\n{2,}", "\n\n")
    out = F.regexp_replace(out, rf"(?U)[Pp][Aa][Gg][Ee]{SPACE}*\d+{SPACE}*[Oo][Ff]{SPACE}*\d+", "")
    out = F.regexp_replace(out, rf"(?mdU)^{SPACE}*\d+{SPACE}*$", "")
    return strip(out)


def clean_text(
    df: DataFrame, text: str = "text", fix_doubles: bool = True, fix_punctuation: bool = True
) -> DataFrame:
    if fix_doubles:
        df = with_collapsed_letters(df, text)
    if fix_punctuation:
        df = with_collapsed_marks(df, text)
    return df.withColumn(text, basic_clean(F.col(text)))


def collapse_blank_lines(col: Column) -> Column:
    return F.regexp_replace(col, r"\n{3,}", "\n\n")


def line_count(col: Column) -> Column:
    """Number of lines under the same boundaries as :func:`lines_of`: the breaks, and a last line without one."""
    closed = F.lit(False)
    for mark in "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029":
        closed = closed | F.endswith(col, F.lit(mark))
    return F.regexp_count(col, F.lit(COUNTED_BREAK)) + ((F.octet_length(col) > 0) & ~closed).cast("int")


def size_change(before: Column, after: Column) -> dict[str, Column]:
    """Characters and lines before and after, removed characters and their share in percent."""
    removed = F.length(before) - F.length(after)
    return {
        "chars_before": F.length(before),
        "chars_after": F.length(after),
        "lines_before": line_count(before),
        "lines_after": line_count(after),
        "removed_chars": removed,
        "removed_pct": F.when(
            F.length(before) > 0, removed / F.length(before) * 100
        ).otherwise(F.lit(0.0)),
    }


def preview(col: Column, n: int, ellipsis: str = "never") -> Column:
    """First ``n`` characters; ``ellipsis`` is ``never``, ``always`` or ``if_cut``."""
    head = F.substring(col, 1, n)
    if ellipsis == "always":
        return F.concat(head, F.lit("..."))
    if ellipsis == "if_cut":
        return F.concat(head, F.when(F.length(col) > n, F.lit("...")).otherwise(F.lit("")))
    return head


def any_contains(col: Column, needles) -> Column:
    """True when any of the fixed ``needles`` occurs in ``col``."""
    hit = F.lit(False)
    for needle in needles:
        hit = hit | F.contains(col, F.lit(needle))
    return hit
