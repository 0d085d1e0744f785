"""Streaming forms of the call-log operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from scrivano.operators.calllog import MICROS, RATE_WINDOW_SECONDS, TTL_SECONDS
from scrivano.streaming.state import use_rocksdb


def stream_rates(
    calls: DataFrame,
    key: str = "key",
    ts: str = "ts",
    window_seconds: int = RATE_WINDOW_SECONDS,
    step_seconds: int = 10,
    watermark: str = "5 minutes",
) -> DataFrame:
    """Calls per key in sliding windows; partial counts are combined before the shuffle.

    A window is written once the watermark has passed its end; :func:`closing_row` closes the last ones.
    """
    window = F.window(ts, f"{window_seconds} seconds", f"{step_seconds} seconds")
    return (
        calls.withWatermark(ts, watermark)
        .groupBy(key, window.alias("w"))
        .agg(F.count(F.lit(1)).alias("calls"))
        .select(key, F.col("w.start").alias("window_start"), "calls")
    )


def stream_first_calls(
    calls: DataFrame, key: str = "key", ts: str = "ts", watermark: str = "1 hour"
) -> DataFrame:
    """One call per key and watermark span: the built-in, approximate form of the TTL cache."""
    return calls.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([key])


def closing_row(calls: DataFrame, ts: str = "ts", seconds: float = RATE_WINDOW_SECONDS + 600) -> DataFrame:
    """One row, without a key and later than all ``calls`` by ``seconds``, that closes a stream.

    As the last file of a source it moves the watermark past every window of the calls, so each of them is
    written; its own windows stay open. ``seconds`` has to exceed window and watermark together.
    """
    late = F.max(ts) + F.make_dt_interval(secs=F.lit(float(seconds)))
    columns = [late.alias(ts) if f.name == ts else F.max(F.lit(None).cast(f.dataType)).alias(f.name) for f in calls.schema.fields]
    return calls.agg(*columns)


class TtlCache(StatefulProcessor):
    """The instant of a key's last store, forgotten by a timer once the watermark is a TTL beyond it."""

    def __init__(self, ttl: int, micros: str, order: str) -> None:
        self.ttl, self.micros, self.order = ttl, micros, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stored = handle.getValueState("stored", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.stored.get()[0] if self.stored.exists() else None
        before = held
        arrived = pd.concat(list(rows)).sort_values([self.micros, self.order], kind="stable")
        arrived = arrived[arrived[self.micros] >= timerValues.getCurrentWatermarkInMs() * 1000]
        times, hits = arrived[self.micros].to_numpy(), np.ones(len(arrived), bool)
        at = 0 if held is None else int(np.searchsorted(times, held + self.ttl))
        while at < len(times):  # from store to store
            hits[at], held = False, int(times[at])
            at = int(np.searchsorted(times, held + self.ttl))
        if held != before:
            self.stored.update((held,))
            if before is not None:
                self.handle.deleteTimer(self.expiry(before))
            self.handle.registerTimer(self.expiry(held))
        yield pd.DataFrame({self.order: arrived[self.order].to_numpy(), "is_hit": hits})

    def expiry(self, stored: int) -> int:
        """Milliseconds at which the store has expired."""
        return -(-(stored + self.ttl) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.stored.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_ttl_hits(
    calls: DataFrame,
    key: str = "key",
    micros: str = "us",
    order: str = "event_id",
    ttl_seconds: float = TTL_SECONDS,
    watermark: str = "1 minute",
) -> DataFrame:
    """Exact TTL cache on a stream: the state of a key is the time of its last store, for one TTL.

    Calls of a micro-batch are taken in time order; the source must not deliver calls of a key out of order
    across micro-batches. Calls behind the watermark are dropped, and a timer removes a key's state when
    the watermark says that no call can find it any more. The source's rate options bound what one
    micro-batch brings of a key.
    """
    use_rocksdb(calls.sparkSession)
    timed = calls.select(key, micros, order, F.timestamp_micros(micros).alias("ts")).withWatermark("ts", watermark)
    return timed.groupBy(key).transformWithStateInPandas(
        TtlCache(int(ttl_seconds * MICROS), micros, order), f"{order} long, is_hit boolean", "Append", "eventTime"
    )
