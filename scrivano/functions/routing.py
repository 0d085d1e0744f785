"""Query classification, search strategy and query variants as columns."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrivano.functions.bind import let
from scrivano.functions.text import SPACE, any_contains, strip

# Keyword lists, tested as substrings of the lower-cased query in this order.
DEFINITION_KEYWORDS = (
    "what is", "what are", "define", "definition", "explain", "meaning", "concept", "describe",
)
RULES_KEYWORDS = (
    "rules", "requirements", "conditions", "criteria", "guidelines", "procedures", "how to",
    "steps",
)
PROHIBITION_KEYWORDS = (
    "prohibited", "forbidden", "not allowed", "cannot", "must not", "should not", "haram",
    "impermissible",
)
COMPARISON_KEYWORDS = (
    "compare", "difference", "versus", "vs", "between", "similar", "different",
)
QUESTION_WORDS = ("what", "why", "how", "when", "where", "which", "who")
INTENT_PHRASES = ("what is", "what are", "define", "definition", "explain")
EXPANSION_PHRASES = INTENT_PHRASES + ("meaning of",)



class Strategy(NamedTuple):
    n_results: int
    boost_definitions: bool
    use_query_expansion: bool
    rerank: bool


# The strategy of each query type.
STRATEGIES = {
    "definition": Strategy(n_results=3, boost_definitions=True, use_query_expansion=True, rerank=False),
    "rules": Strategy(n_results=7, boost_definitions=False, use_query_expansion=True, rerank=False),
    "prohibition": Strategy(n_results=5, boost_definitions=False, use_query_expansion=True, rerank=False),
    "complex": Strategy(n_results=10, boost_definitions=False, use_query_expansion=True, rerank=True),
    "simple": Strategy(n_results=3, boost_definitions=False, use_query_expansion=False, rerank=False),
}
COMPARISON_COMPLEXITY = 0.8
COMPLEX_ABOVE = 0.6
WIDEN_ABOVE = 0.7
WIDEN_BY = 2
MAX_RESULTS = 15


def keyword_class(low: Column) -> Column:
    """First keyword list that matches the lower-cased query; null when none does."""
    return (
        F.when(any_contains(low, DEFINITION_KEYWORDS), "definition")
        .when(any_contains(low, RULES_KEYWORDS), "rules")
        .when(any_contains(low, PROHIBITION_KEYWORDS), "prohibition")
        .when(any_contains(low, COMPARISON_KEYWORDS), "comparison")
    )


def text_complexity(query: Column) -> Column:
    """Score in [0, 1] from length, number of clauses, question words and mean word length."""
    low = F.lower(query)
    length_part = F.least(F.length(query) / 200, F.lit(1.0)) * 0.3
    clauses = F.regexp_count(query, F.lit("[.!?]")) + 1
    clause_part = F.least(clauses / 5, F.lit(1.0)) * 0.2
    asked = sum((F.contains(low, F.lit(w)).cast("int") for w in QUESTION_WORDS), F.lit(0))
    question_part = F.least(asked / 3, F.lit(1.0)) * 0.2
    words = F.regexp_count(query, F.lit(rf"(?U)[^\s\x1c-\x1f]+"))
    letters = F.length(F.regexp_replace(query, rf"(?U){SPACE}+", ""))
    mean_word = F.when(words > 0, letters / words).otherwise(F.lit(0.0))
    word_part = F.greatest(F.least((mean_word - 4) / 5, F.lit(1.0)) * 0.3, F.lit(0.0))
    return F.least(length_part + clause_part + question_part + word_part, F.lit(1.0))


def complexity(query: Column, keywords: Column) -> Column:
    """Comparisons count as complex outright; other queries are scored."""
    return F.when(keywords == "comparison", F.lit(COMPARISON_COMPLEXITY)).otherwise(
        text_complexity(query)
    )


def query_type(keywords: Column, score: Column) -> Column:
    """Type from the keyword class and the complexity score."""
    return (
        F.when(keywords == "comparison", "complex")
        .when(keywords.isNotNull(), keywords)
        .when(score > COMPLEX_ABOVE, "complex")
        .otherwise("simple")
    )


def strategy(qtype: Column, score: Column) -> Column:
    """Strategy struct for a type; complex queries fetch more and ask for re-ranking."""

    def pick(field: str) -> Column:
        out = F.lit(getattr(STRATEGIES["simple"], field))
        for name, values in STRATEGIES.items():
            out = F.when(qtype == name, F.lit(getattr(values, field))).otherwise(out)
        return out

    wide = score > WIDEN_ABOVE
    n_results = F.when(wide, F.least(pick("n_results") + WIDEN_BY, F.lit(MAX_RESULTS))).otherwise(pick("n_results"))
    return F.struct(
        pick("use_query_expansion").alias("use_query_expansion"),
        n_results.cast("int").alias("n_results"),
        pick("boost_definitions").alias("boost_definitions"),
        (wide | pick("rerank")).alias("rerank"),
    )


def route(query: Column) -> Column:
    """Struct ``query_type, complexity, strategy`` of a query; shared parts are bound once."""

    def record(qtype, score):
        return F.struct(
            qtype.alias("query_type"),
            score.alias("complexity"),
            strategy(qtype, score).alias("strategy"),
        )

    def with_keywords(keywords):
        return let(
            complexity(query, keywords),
            lambda score: let(query_type(keywords, score), lambda qtype: record(qtype, score)),
        )

    return let(F.lower(query), lambda low: let(keyword_class(low), with_keywords))


def has_definition_intent(query: Column) -> Column:
    return any_contains(F.lower(query), INTENT_PHRASES)


def query_variants(query: Column) -> Column:
    """The query itself, followed by five phrasings of the term when a definition is asked for."""
    low = F.lower(query)
    asks = r"(?U)(?:what is|what are|define|definition of|explain|meaning of)" + SPACE + "+([^?]+)"
    term = strip(F.regexp_extract(low, asks, 1))
    phrased = F.array(
        query,
        F.concat(F.lit("Definition of "), term),
        F.concat(term, F.lit(" definition")),
        F.concat(term, F.lit(" is")),
        F.concat(term, F.lit(" means")),
        F.concat(F.lit("Concept of "), term),
    )
    matched = any_contains(low, EXPANSION_PHRASES) & F.regexp_like(low, F.lit(asks))
    return F.when(matched, phrased).otherwise(F.array(query))
