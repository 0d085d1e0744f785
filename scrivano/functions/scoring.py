"""Rule-based re-ranking scores (lower is better) and relevance tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrivano.functions.text import any_contains

# Phrases and score adjustments of the definition boost.
DEFINITION_WORD = "definition"
DEFINING_PHRASES = (" is ", " means ", " refers to ")
DEFINITION_BONUS = 0.2
PHRASE_BONUS = 0.1
SHORT_PENALTY = 0.1
# (word present, word absent, penalty): a section on the first term only is a likely mix-up.
CONFUSABLE_TERMS = (("mudarabah", "murabahah", 0.15),)


def definition_marks(
    content: Column, penalties=(), head_chars: int | None = None, short_below: int | None = None
) -> Column:
    """What :func:`marked_score` needs to know of a content, as flags: these may move in its place.

    The whole content counts. ``head_chars`` looks for the phrases in its first characters only;
    ``short_below`` marks shorter contents.
    """
    low = F.lower(content)
    head = F.substring(low, 1, head_chars) if head_chars else low
    short = F.length(content) < short_below if short_below else F.lit(False)
    mixed_up = [F.contains(low, F.lit(p)) & ~F.contains(low, F.lit(a)) for p, a, _ in penalties]
    return F.struct(
        F.contains(head, F.lit(DEFINITION_WORD)).alias("defines"),
        any_contains(head, DEFINING_PHRASES).alias("phrased"),
        short.alias("short"),
        *[m.alias(f"mixed_up_{i}") for i, m in enumerate(mixed_up)],
    )


def marked_score(distance: Column, marks: Column, penalties=()) -> Column:
    """Distance lowered for defining sections and raised for short ones and confusable terms."""
    score = distance - F.when(marks["defines"], DEFINITION_BONUS).otherwise(0.0)
    score = score - F.when(marks["phrased"], PHRASE_BONUS).otherwise(0.0)
    score = score + F.when(marks["short"], SHORT_PENALTY).otherwise(0.0)
    for i, (_, _, penalty) in enumerate(penalties):
        score = score + F.when(marks[f"mixed_up_{i}"], penalty).otherwise(0.0)
    return score


def definition_score(
    distance: Column,
    content: Column,
    penalties=(),
    head_chars: int | None = None,
    short_below: int | None = None,
) -> Column:
    """:func:`marked_score` of a content with its :func:`definition_marks`."""
    return marked_score(distance, definition_marks(content, penalties, head_chars, short_below), penalties)


def is_relevant(path: Column, expected: Column, match: str = "contains") -> Column:
    """A hit is relevant when any expected path is a substring of its path (or equals it)."""
    if match == "exact":
        return F.coalesce(F.array_contains(expected, path), F.lit(False))
    if match != "contains":
        raise ValueError("match must be 'contains' or 'exact'")
    return F.coalesce(F.exists(expected, lambda e: F.contains(path, e)), F.lit(False))
