"""Conversation memory over a table of turns: retention, context strings, history listing.

Turns are ``session_id, turn_no, query, response[, metadata]``; ``turn_no`` is the order of arrival
within a session. A session may hold a large share of all turns: retention keeps the last turns
with a ranked filter that Spark applies before the shuffle as well, and contexts for every turn are
computed in slices of a session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivano.functions.text import preview
from scrivano.operators.calllog import ascii_json
from scrivano.operators.sweep import running_total

# Retained turns, turns in a context, recent queries and listed characters.
MAX_HISTORY = 10
CONTEXT_TURNS = 5
RECENT_QUERIES = 3
LISTED_PREVIEW = 60

SLICE_TURNS = 10_000
BEFORE_ALL = -(1 << 62)


def turns_from_messages(
    messages: DataFrame, session: str = "conv_id", position: str = "turn"
) -> DataFrame:
    """Pair each user message with the assistant message that comes next in its session.

    Positions may have gaps but do not repeat within a session. One running total over the keys alone
    gives every message its place in the order of all messages, so the pair is an equi-join on
    neighbouring places and no session is collected; the texts are joined to the pairs. Messages without
    a session form one session.
    """
    keys = messages.select(F.col(session).cast("string").alias("session_id"), F.col(position).cast("long").alias("turn_no"), "role")
    placed = running_total(keys.withColumn("_one", F.lit(1).cast("long")), ["session_id", "turn_no"], "_one", "_place")

    def of(role: str, place: Column, *names: str) -> DataFrame:
        return placed.filter(F.col("role") == role).select(place.alias("_place"), *[F.col(c).alias(f"{role}_{c}") for c in names])

    next_to = of("user", F.col("_place") + 1, "session_id", "turn_no").join(
        of("assistant", F.col("_place"), "session_id", "turn_no"), "_place"
    )
    pairs = next_to.filter(F.col("user_session_id").eqNullSafe(F.col("assistant_session_id"))).drop("_place", "assistant_session_id")

    def texts(role: str, name: str) -> DataFrame:
        return messages.filter(F.col("role") == role).select(
            F.col(session).cast("string").alias("_session"), F.col(position).cast("long").alias("_turn"), F.col("text").alias(name)
        )

    def at(turn: str) -> Column:
        return F.col("user_session_id").eqNullSafe(F.col("_session")) & F.col(turn).eqNullSafe(F.col("_turn"))

    asked = pairs.join(texts("user", "query"), at("user_turn_no")).drop("_session", "_turn")
    both = asked.join(texts("assistant", "response"), at("assistant_turn_no"))
    return both.select(F.col("user_session_id").alias("session_id"), F.col("user_turn_no").alias("turn_no"), "query", "response")


def last_turns(turns: DataFrame, n: int = MAX_HISTORY) -> DataFrame:
    """The last ``n`` turns of every session, with ``back`` = 1 for the newest."""
    newest = Window.partitionBy("session_id").orderBy(F.col("turn_no").desc())
    return turns.withColumn("back", F.row_number().over(newest)).filter(F.col("back") <= n)


def metadata_json(metadata: Column) -> Column:
    """Turn metadata as JSON indented by two, ASCII only; a missing query type is left out."""

    def quoted(value):
        return ascii_json(F.regexp_extract(F.to_json(F.array(value)), r"(?s)\A\[(.*)\]\z", 1))

    paths = metadata["standards"]
    listed = F.concat(
        F.lit("[\n    "), F.array_join(F.transform(paths, quoted), ",\n    "), F.lit("\n  ]")
    )
    entries = F.concat_ws(
        ",\n  ",
        F.concat(F.lit('"standards_found": '), metadata["standards_found"].cast("string")),
        F.concat(F.lit('"standards": '), F.when(F.size(paths) > 0, listed).otherwise("[]")),
        F.when(
            metadata["query_type"].isNotNull(),
            F.concat(F.lit('"query_type": '), quoted(metadata["query_type"])),
        ),
    )
    return F.concat(F.lit("{\n  "), entries, F.lit("\n}"))


def turn_part(include_metadata: bool = False, response_chars: int | None = None) -> Column:
    """One turn as it appears in a context; ``response_chars`` cuts the response and adds dots."""
    response = F.col("response")
    if response_chars is not None:
        response = preview(response, response_chars, "always")
    pieces = [
        F.concat(F.lit("User: "), F.col("query")),
        F.concat(F.lit("Assistant: "), response),
    ]
    if include_metadata:
        pieces.append(
            F.when(
                F.col("metadata").isNotNull(),
                F.concat(F.lit("Context: "), metadata_json(F.col("metadata"))),
            )
        )
    return F.concat_ws("\n\n", *pieces)


def _join_parts(parts: Column, max_chars: int | None) -> Column:
    whole = F.array_join(parts, "\n\n")
    return whole if max_chars is None else F.right(whole, F.lit(max_chars))


def session_context(
    turns: DataFrame,
    include_metadata: bool = False,
    max_history: int = MAX_HISTORY,
    context_turns: int = CONTEXT_TURNS,
    max_chars: int | None = None,
) -> DataFrame:
    """Context of every session after its last turn, oldest turn first."""
    kept = last_turns(
        turns.select("session_id", "turn_no", turn_part(include_metadata).alias("part")),
        min(context_turns, max_history),
    )
    parts = F.transform(
        F.array_sort(F.collect_list(F.struct("turn_no", "part"))), lambda t: t["part"]
    )
    return kept.groupBy("session_id").agg(_join_parts(parts, max_chars).alias("context"))


def context_before_turn(
    turns: DataFrame,
    include_metadata: bool = False,
    max_history: int = MAX_HISTORY,
    context_turns: int = CONTEXT_TURNS,
    max_chars: int | None = None,
    slice_turns: int = SLICE_TURNS,
) -> DataFrame:
    """The context that each turn saw, before it was added: ``session_id, turn_no, context``.

    A session is cut into slices of consecutive turn numbers. The last turns of each slice are
    handed on to the slice after it, so the window runs per slice and a session of any length is
    spread over many tasks. Turns without a session form one; turns without a number come before all others.
    """
    n = min(context_turns, max_history)
    number = F.col("turn_no")
    # One exchange by slice serves the tails and the final window alike. A missing session is a value of
    # its own inside a struct, so that it joins like any other.
    slice_no = F.floor((number - F.pmod(number, F.lit(slice_turns))) / slice_turns)
    parts = turns.select(
        F.struct("session_id").alias("session_id"),
        "turn_no",
        F.coalesce(slice_no, F.lit(BEFORE_ALL)).alias("slice"),
        turn_part(include_metadata).alias("part"),
    )
    parts = parts.repartition("session_id", "slice")
    newest = Window.partitionBy("session_id", "slice").orderBy(F.col("turn_no").desc())
    tails = (
        parts.withColumn("back", F.row_number().over(newest))
        .filter(F.col("back") <= n)
        .groupBy("session_id", "slice")
        .agg(F.array_sort(F.collect_list(F.struct("turn_no", "part"))).alias("tail"))
    )
    # Every slice holds at least one turn, so the n slices before one hold the n turns it needs.
    # Only slice numbers pass through the per-session window; the texts are joined to it.
    earlier = Window.partitionBy("session_id").orderBy("slice").rowsBetween(-n, -1)
    needs = (
        tails.select("session_id", "slice")
        .withColumn("sources", F.collect_list("slice").over(earlier))
        .select("session_id", "slice", F.explode("sources").alias("source"))
    )
    handed = (
        needs.join(tails.withColumnRenamed("slice", "source"), ["session_id", "source"])
        .groupBy("session_id", "slice")
        .agg(F.sort_array(F.flatten(F.collect_list("tail")), asc=False).alias("carried"))
        .select("session_id", "slice", F.explode(F.slice("carried", 1, n)).alias("t"))
        .select("session_id", "slice", "t.turn_no", "t.part", F.lit(True).alias("carried"))
    )
    both = parts.withColumn("carried", F.lit(False)).unionByName(handed)
    before = (
        Window.partitionBy("session_id", "slice").orderBy("turn_no").rowsBetween(-n, -1)
    )
    return (
        both.withColumn("context", _join_parts(F.collect_list("part").over(before), max_chars))
        .filter(~F.col("carried"))
        .select("session_id.session_id", "turn_no", "context")
    )


def recent_queries(
    turns: DataFrame, n: int = RECENT_QUERIES, max_history: int = MAX_HISTORY
) -> DataFrame:
    """The last ``n`` retained queries of every session, oldest first; 0 means all retained."""
    keep = min(n or max_history, max_history)
    kept = last_turns(turns.select("session_id", "turn_no", "query"), keep)
    ordered = F.array_sort(F.collect_list(F.struct("turn_no", "query")))
    return kept.groupBy("session_id").agg(
        F.transform(ordered, lambda t: t["query"]).alias("recent_queries")
    )


def clear_sessions(turns: DataFrame, cleared: DataFrame) -> DataFrame:
    """Drop the turns of cleared sessions up to their ``cleared_at`` turn (null: all turns)."""
    marks = cleared.groupBy("session_id").agg(
        F.max("cleared_at").alias("_upto"),
        F.bool_or(F.col("cleared_at").isNull()).alias("_all"),
    )
    gone = F.col("_all") | (F.col("turn_no") <= F.col("_upto"))
    return (
        turns.join(marks, "session_id", "left")
        .filter(~F.coalesce(gone, F.lit(False)))
        .drop("_upto", "_all")
    )


def session_sizes(turns: DataFrame, max_history: int = MAX_HISTORY) -> DataFrame:
    """Turns seen and turns retained per session."""
    seen = F.count(F.lit(1))
    return turns.groupBy("session_id").agg(
        seen.alias("turns_seen"), F.least(seen, F.lit(max_history)).alias("turns_retained")
    )


def contract_label(text: Column) -> Column:
    """The query text under which a contract analysis enters the history."""
    return F.format_string("Analyze contract (%d chars)", F.length(text))


def turn_metadata(hits: DataFrame, query_type: str | None = None) -> DataFrame:
    """Metadata of the turn that a query leaves behind: number and paths of its hits, by rank."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "section_path")))
    return hits.groupBy("query_id").agg(
        F.struct(
            F.count(F.lit(1)).cast("int").alias("standards_found"),
            F.transform(ranked, lambda h: h["section_path"]).alias("standards"),
            F.lit(query_type).cast("string").alias("query_type"),
        ).alias("metadata")
    )


def history_listing(history: DataFrame, max_history: int = MAX_HISTORY) -> DataFrame:
    """Labels of the retained entries, ``position`` 1 = newest; the number counts from the oldest.

    ``history``: ``session_id, turn_no, is_question, preview, standards_found, text_length``.
    """
    kept = last_turns(history, max_history)
    oldest = Window.partitionBy("session_id").orderBy("turn_no")
    numbered = kept.withColumn("number", F.row_number().over(oldest))
    short = F.substring("preview", 1, LISTED_PREVIEW)
    label = F.when(
        F.col("is_question"),
        F.format_string(
            "Question #%d - %s... (%d standards)", F.col("number"), short, F.col("standards_found")
        ),
    ).otherwise(
        F.format_string(
            "Analysis #%d - %s... (%d standards, %d chars)",
            F.col("number"),
            short,
            F.col("standards_found"),
            F.col("text_length"),
        )
    )
    return numbered.select(
        "session_id", F.col("back").alias("position"), "number", label.alias("label")
    )
