"""Streaming conversation memory: bounded state per session, one context per arriving turn."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from scrivano.operators.memory import (
    CONTEXT_TURNS,
    MAX_HISTORY,
    turn_part,
)
from scrivano.streaming.state import use_rocksdb

OUTPUT = "session_id string, turn_no long, context string"

# A session without a turn for this long is forgotten.
IDLE = "1 day"
WATERMARK = "10 minutes"


class SessionMemory(StatefulProcessor):
    """The last parts of a session, newest turn number and time.

    A timer forgets the session when the watermark is ``idle_ms`` beyond its newest turn.
    """

    def __init__(self, keep: int, max_chars: int | None, idle_ms: int) -> None:
        self.keep, self.max_chars, self.idle_ms = keep, max_chars, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getListState("parts", "part string")
        self.newest = handle.getValueState("newest", "turn_no long, ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, seen = tuple(self.newest.get()) if self.newest.exists() else (None, None)
        parts = [p[0] for p in self.parts.get()] if last is not None else []
        before, out = seen, []
        arrived = pd.concat(list(rows)).sort_values("turn_no", kind="stable")
        arrived = arrived[arrived["ms"] >= timerValues.getCurrentWatermarkInMs()]
        for turn_no, part, ms in zip(arrived["turn_no"], arrived["part"], arrived["ms"]):
            if seen is not None and ms - seen > self.idle_ms:
                parts, last = [], None
            if last is not None and turn_no <= last:
                continue
            context = "\n\n".join(parts)
            if self.max_chars is not None:
                context = context[-self.max_chars :] if self.max_chars else ""
            out.append((key[0], int(turn_no), context))
            parts = (parts + [part])[-self.keep :] if self.keep else []
            last, seen = int(turn_no), max(int(ms), seen if seen is not None else int(ms))
        if out:
            self.parts.put([(p,) for p in parts])
            self.newest.update((last, seen))
            if before is not None:
                self.handle.deleteTimer(before + self.idle_ms + 1)
            self.handle.registerTimer(seen + self.idle_ms + 1)
        yield pd.DataFrame(out, columns=["session_id", "turn_no", "context"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.parts.clear()
        self.newest.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_contexts(
    turns: DataFrame,
    max_history: int = MAX_HISTORY,
    context_turns: int = CONTEXT_TURNS,
    max_chars: int | None = None,
    watermark: str = WATERMARK,
    idle: str = IDLE,
) -> DataFrame:
    """The context each turn sees before it is added, from a stream of turns.

    Only the part of a turn that a context shows is shipped and kept, and no more turns than a
    context uses, so the state per session is bounded; the source's rate options bound what one
    micro-batch brings. Turns of a micro-batch are sorted; a turn at or before the newest one
    already seen is late and dropped.

    Time is that of ``ts``: turns behind the ``watermark`` are dropped, and a session is forgotten ``idle``
    after its last turn, so a turn later than that starts anew.
    """
    use_rocksdb(turns.sparkSession)
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    timed = turns.withWatermark("ts", watermark).select(
        "session_id", F.col("turn_no").cast("long").alias("turn_no"), turn_part().alias("part"), "ts", F.unix_millis("ts").alias("ms")
    )
    memory = SessionMemory(min(max_history, context_turns), max_chars, idle_ms)
    return timed.groupBy("session_id").transformWithStateInPandas(memory, OUTPUT, "Append", "eventTime")
