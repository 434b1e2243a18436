"""Structured Streaming: progress sessions, de-duplicated work, results as they come, a circuit breaker for providers.

Each function takes a streaming or a batch DataFrame of events (event_id, ts, user_id, event_type, value), so the
batch result is what the stream comes to.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

IDLE, LATE = "10 seconds", "1 minute"
FAILURES, COOLDOWN_MS = 3, 30_000


def timed(events: DataFrame) -> DataFrame:
    """Event time as a timestamp with a zone, which is what a stream's watermark takes."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")) if events.isStreaming else events


def sessions(events: DataFrame, idle: str = IDLE, late: str = LATE) -> DataFrame:
    """Stretches of progress of each user; one ends after ``idle`` without an event. Events later than ``late`` are dropped by a stream."""
    w = F.session_window("ts", idle).alias("w")
    out = timed(events).withWatermark("ts", late).groupBy("user_id", w).agg(F.count("*").alias("n_events"), F.sum("value").alias("total"))
    return out.select("user_id", F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "n_events", "total")


def windowed(events: DataFrame, size: str = "1 minute", late: str = LATE) -> DataFrame:
    """Events by type and minute."""
    out = timed(events).withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n_events"), F.round(F.avg("value"), 6).alias("mean"))
    return out.select(F.col("w.start").alias("began"), "event_type", "n_events", "mean")


def deduped(events: DataFrame, keys: tuple[str, ...] = ("event_id",), late: str = LATE) -> DataFrame:
    """The first event of each key; a stream remembers keys for as long as ``late``."""
    if events.isStreaming:
        return timed(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))
    return events.dropDuplicates(list(keys))


def step(state: str, failures: int, opened: float, failed: bool, now: float, limit: int = FAILURES, cooldown: float = COOLDOWN_MS) -> tuple[str, int, float, bool]:
    """A breaker after one call: (state, failures in a row, when it opened, whether the call was let through)."""
    if state == "open" and now - opened >= cooldown:
        state = "half_open"
    if state == "open":
        return state, failures, opened, False
    if not failed:
        return "closed", 0, opened, True
    failures += 1
    if state == "half_open" or failures >= limit:
        return "open", failures, now, True
    return state, failures, opened, True


_BREAKER = "user_id long, event_id long, state string, failures int, allowed boolean"


def _walk(user: int, rows: pd.DataFrame, state: tuple[str, int, float]) -> tuple[pd.DataFrame, tuple[str, int, float]]:
    out = []
    for r in rows.sort_values(["ts", "event_id"]).itertuples(index=False):
        name, failures, opened, allowed = step(*state, r.event_type == "error", r.ts.timestamp() * 1000)
        state = (name, failures, opened)
        out.append((user, r.event_id, name, failures, allowed))
    return pd.DataFrame(out, columns=["user_id", "event_id", "state", "failures", "allowed"]).astype({"failures": "int32"}), state


def breaker(events: DataFrame) -> DataFrame:
    """Each user's events run through a circuit breaker: three errors open it, thirty seconds later one call may try again."""
    rows = events.select("user_id", "event_id", "ts", "event_type")
    if not rows.isStreaming:
        return rows.groupBy("user_id").applyInPandas(lambda key, f: _walk(key[0], f, ("closed", 0, 0.0))[0], _BREAKER)

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else ("closed", 0, 0.0)
        f = pd.concat(list(frames))
        out, now = _walk(key[0], f, tuple(now))
        state.update(now)
        yield out

    return rows.groupBy("user_id").applyInPandasWithState(keep, _BREAKER, "state string, failures int, opened double", "append", GroupStateTimeout.NoTimeout)
