"""Event-time windows, deduplication and keyed limits over streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.observe import sessions, sliding, tumbling


def timed(events: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Event time as TIMESTAMP (watermarks refuse TIMESTAMP_NTZ) with a watermark."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def tumbling_stream(events: DataFrame, width: str = "5 minutes", *by: str, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    return tumbling(timed(events, ts, late), ts, width, *by)


def sliding_stream(events: DataFrame, width: str, step: str, *by: str, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    return sliding(timed(events, ts, late), ts, width, step, *by)


def session_stream(events: DataFrame, gap: str, *by: str, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    return sessions(timed(events, ts, late), ts, gap, *by)


def distinct_stream(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark: bounded state."""
    return timed(events, ts, late).dropDuplicatesWithinWatermark(keys)


def _limit_stream(events: DataFrame, key: str, ts: str, late: str, idle_ms: int, step: Callable[[tuple | None, float], tuple[tuple, bool]]) -> DataFrame:
    """(key, ts, allowed) per request. step(state or None, time) -> (state of two numbers, allowed).

    The state of a key is dropped once the watermark has passed its last request by idle_ms, so the
    state store holds live keys only. Requests later than the watermark are left out.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.get if state.exists else None
        last = 0.0
        times = sorted(t for part in batches for t in part["ts"])
        allowed = []
        for t in times:
            now, ok = step(now, t.timestamp())
            last = max(last, t.timestamp())
            allowed.append(ok)
        if not times:
            return
        state.update((float(now[0]), float(now[1])))
        state.setTimeoutTimestamp(max(int(last * 1000), state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame({"key": [str(k[0])] * len(times), "ts": times, "allowed": allowed})

    rows = timed(events.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts")), "ts", late)
    return rows.groupBy("key").applyInPandasWithState(run, "key string, ts timestamp, allowed boolean", "a double, b double", "append", GroupStateTimeout.EventTimeTimeout)


def token_bucket_stream(events: DataFrame, *, key: str = "user_id", ts: str = "ts", capacity: float = 60.0, per_second: float = 1.0, late: str = "10 minutes", idle_ms: int = 600_000) -> DataFrame:
    """(key, ts, allowed): tokens refill with time up to the capacity; a request takes one or is refused. State: tokens, last time."""

    def step(state: tuple | None, t: float) -> tuple[tuple, bool]:
        tokens = capacity if state is None else min(capacity, state[0] + max(0.0, t - state[1]) * per_second)
        return (tokens - (tokens >= 1), t), bool(tokens >= 1)

    return _limit_stream(events, key, ts, late, idle_ms, step)


def fixed_window_stream(events: DataFrame, *, key: str = "user_id", ts: str = "ts", limit: int = 60, seconds: float = 60.0, late: str = "10 minutes", idle_ms: int = 600_000) -> DataFrame:
    """(key, ts, allowed): `limit` requests per window, which opens at the first request after the last one closed. State: start, count."""

    def step(state: tuple | None, t: float) -> tuple[tuple, bool]:
        start, n = (t, 0.0) if state is None or t >= state[0] + seconds else state
        return (start, n + 1), n + 1 <= limit

    return _limit_stream(events, key, ts, late, idle_ms, step)


def not_revoked(tokens: DataFrame, revoked: DataFrame, now: Column) -> DataFrame:
    """Tokens without a live revocation (token_id, expires_at): expired revocations no longer count."""
    return tokens.join(revoked.where(F.col("expires_at") > now), "token_id", "left_anti")
