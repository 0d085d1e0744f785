"""Operators on a log of external calls: request keys, TTL de-duplication, rates, errors, summaries.

A key may account for a large share of all calls, so the time-dependent operators sweep over all
instants in the order (key, time), which range partitions split by count, wherever a key begins or ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivano.operators.sweep import join_counted, next_instants, running_total
from scrivano.session import cut_lineage

# Cache lifetime, rate limit, quota words and the wait that errors ask for.
TTL_SECONDS = 3600
MAX_CALLS = 15
RATE_WINDOW_SECONDS = 60
QUOTA_WORDS = ("429", "quota", "rate limit", "exceeded")
RETRY_AFTER = r"(?diuU)retry.*?(\d+(?:\.\d+)?)[\s\x1c-\x1f]*s"
RETRY_BUFFER = 2.0

MICROS = 1_000_000


def epoch_micros(ts: Column, ntz: bool = True) -> Column:
    """Microseconds since the epoch; a zone-less timestamp is read as UTC in any session zone."""
    if ntz:
        ts = F.convert_timezone(F.lit("UTC"), F.current_timezone(), ts).cast("timestamp")
    return F.unix_micros(ts)


def _json_value(value: Column) -> Column:
    return ascii_json(F.regexp_extract(F.to_json(F.array(value)), r"(?s)\A\[(.*)\]\z", 1))


def ascii_json(text: Column) -> Column:
    """JSON text with every character beyond ASCII as its escape, in two halves beyond 16 bits."""

    def unit(code: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))

    def escaped(char: Column) -> Column:
        code = F.ascii(char)
        high, low = F.shiftright(code - 0x10000, 10) + 0xD800, (code - 0x10000) % 0x400 + 0xDC00
        return (
            F.when(code < 128, char).when(code < 0x10000, unit(code)).otherwise(F.concat(unit(high), unit(low)))
        )

    plain = F.array_join(F.transform(F.split(text, ""), escaped), "")
    return F.when(F.regexp_like(text, F.lit(r"[^\x00-\x7F]")), plain).otherwise(text)


def request_key(name: Column, args=(), kwargs: dict[str, Column] | None = None) -> Column:
    """MD5 of the call's canonical JSON: function name, positional and sorted keyword arguments."""
    positional = F.concat_ws(", ", _json_value(name), *[_json_value(a) for a in args])
    named = [
        F.concat(F.lit(f'"{key}": '), _json_value(value))
        for key, value in sorted((kwargs or {}).items())
    ]
    keywords = F.concat_ws(", ", *named) if named else F.lit("")
    return F.md5(
        F.concat(
            F.lit('{"args": ['), positional, F.lit('], "kwargs": {'), keywords, F.lit("}}")
        )
    )


def call_rate(
    calls: DataFrame,
    key: str = "key",
    micros: str = "us",
    window_seconds: float = RATE_WINDOW_SECONDS,
    limit: int = MAX_CALLS,
) -> DataFrame:
    """Calls of the same key in the window that ends at each call, and whether it is at the limit.

    A call exactly ``window_seconds`` old has left the window. Calls are counted per instant before they
    move; one sweep over all instants, each adding its calls, and over the instants a window earlier gives
    the running totals whose difference is the rate. Calls without a key form one key; a call without a
    time is in no window and has a null count.
    """
    width = int(window_seconds * MICROS)
    instants = calls.filter(F.col(micros).isNotNull()).groupBy(key, micros).agg(F.count(F.lit(1)).alias("_n"))
    arrive = instants.select(key, F.col(micros).alias("_at"), F.lit(0).alias("_kind"), F.col(micros).alias("_of"), "_n")
    leave = instants.select(
        key, (F.col(micros) - width).alias("_at"), F.lit(1).alias("_kind"), F.col(micros).alias("_of"), F.lit(0).cast("long").alias("_n")
    )
    swept = running_total(arrive.unionByName(leave), [key, "_at", "_kind"], "_n")
    rates = swept.groupBy(key, F.col("_of").alias(micros)).agg(
        F.sum(F.when(F.col("_kind") == 0, F.col("upto")).otherwise(-F.col("upto"))).alias("calls_in_window"), F.sum("_n").alias("_n")
    )
    rated = join_counted(calls.filter(F.col(micros).isNotNull()), rates, [key, micros], "_n").drop("_n")
    timeless = calls.filter(F.col(micros).isNull()).withColumn("calls_in_window", F.lit(None).cast("long"))
    return rated.unionByName(timeless).withColumn(
        "over_limit", F.coalesce(F.col("calls_in_window") > limit, F.lit(False))
    )


def chain_rounds(instants: DataFrame, key: str, micros: str, ttl: int) -> int:
    """Doublings after which every store of the longest possible chain is marked."""
    spans = instants.groupBy(key).agg((F.max(micros) - F.min(micros)).alias("span"))
    longest = spans.agg(F.max("span")).first()[0] or 0
    return int(longest // max(ttl, 1) + 1).bit_length()


def ttl_hits(
    calls: DataFrame,
    key: str = "key",
    micros: str = "us",
    order: str = "event_id",
    ttl_seconds: float = TTL_SECONDS,
) -> DataFrame:
    """Mark each call as ``is_hit``: the key was *stored* less than the TTL before.

    Hits do not refresh the stored time, so the stores of a key are a chain: its first call, then each time
    the first call at least one TTL after the last store. Distinct instants are formed first (combined before
    the shuffle); of several calls at one instant the first by ``order`` may store. Every instant is linked to
    its successor by one sweep, and the chain is followed by pointer doubling: each round marks what the marked
    instants point to and lets every pointer jump twice as far, so a chain of *n* stores takes log *n* rounds
    of joins on (key, instant). Neither a key nor a TTL of it is ever one task's.
    """
    ttl = int(ttl_seconds * MICROS)
    valid = calls.filter(F.col(key).isNotNull() & F.col(micros).isNotNull())
    instants = cut_lineage(
        valid.groupBy(key, micros).agg(F.min(F.col(order).cast("long")).alias("_first"))
    )
    stores = instants.groupBy(key).agg(F.min(micros).alias(micros))
    rounds = chain_rounds(instants, key, micros, ttl)
    jumps = cut_lineage(next_instants(instants, key, micros, ttl)) if rounds > 1 else None
    for turn in range(rounds if jumps is not None else 0):
        reached = stores.join(jumps, [key, micros]).select(key, F.col("next").alias(micros))
        stores = cut_lineage(stores.unionByName(reached))
        if turn + 1 < rounds:
            further = jumps.select(key, F.col(micros).alias("next"), F.col("next").alias("_then"))
            # Many instants may share a successor; adaptive execution splits such a key on this side.
            jumps = cut_lineage(jumps.join(further, [key, "next"]).select(key, micros, F.col("_then").alias("next")))
    # The call that stores is one row, also where many calls share its instant.
    marks = instants.join(stores, [key, micros]).select(
        F.col(key).alias("_key"), F.col(micros).alias("_us"), "_first", F.lit(True).alias("_stored")
    )
    same = (F.col(key) == F.col("_key")) & (F.col(micros) == F.col("_us")) & (F.col(order).cast("long") == F.col("_first"))
    return (
        calls.join(marks, same, "left")
        # Calls without a key or an instant store nothing and find nothing.
        .withColumn("is_hit", F.col("_stored").isNull() & F.col(key).isNotNull() & F.col(micros).isNotNull())
        .drop("_key", "_us", "_first", "_stored")
    )


def is_quota_error(message: Column) -> Column:
    hit = F.lit(False)
    for word in QUOTA_WORDS:
        hit = hit | F.contains(F.lower(message), F.lit(word))
    return hit


def retry_delay(message: Column) -> Column:
    """Seconds to wait that an error message asks for, plus a buffer; null when it names none."""
    seconds = F.nullif(F.regexp_extract(message, RETRY_AFTER, 1), F.lit(""))
    return seconds.cast("double") + RETRY_BUFFER


def classify_errors(errors: DataFrame, message: str = "message") -> DataFrame:
    return errors.withColumn("is_quota_error", is_quota_error(F.col(message))).withColumn(
        "retry_delay",
        F.when(F.col("is_quota_error"), retry_delay(F.col(message))),
    )


def call_summary(
    calls: DataFrame, name: str = "name", duration: str = "duration", failed: str = "failed"
) -> DataFrame:
    """Calls, failures and mean duration per function; partial sums are combined before the shuffle."""
    return calls.groupBy(name).agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(F.col(failed)).alias("failures"),
        F.count_if(~F.col(failed)).alias("successes"),
        F.avg(duration).alias("mean_duration"),
        F.max(duration).alias("max_duration"),
    )
