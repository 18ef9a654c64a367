"""Keyed state machines over event time: a queue with redelivery, revocations that end, buffers of the last samples.

All run on transformWithState and so need the RocksDB state store (see `state_store`). Rows of a
trigger are taken in the order of their times; timers fire as the watermark passes them, so the same
input gives the same output however it is cut into batches, as long as no row is later than the
watermark allows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestone.streaming.windows import timed

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = 86_400


def state_store(spark: SparkSession) -> None:
    """Sets the state store that these operators need, for queries started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _ms(t) -> int:
    return int(pd.Timestamp(t).value // 1_000_000)


def _in_order(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(by, kind="stable")


def _ordered(rows: Iterator[pd.DataFrame], ts: str, kind: str, more: str | None = None) -> list[tuple]:
    """(microseconds, kind, value of `more`) in the order of times and kinds; without the cost of sorting a frame for each key."""
    out = []
    for d in rows:
        us = d[ts].to_numpy("datetime64[us]").astype("int64").tolist()
        out += zip(us, d[kind].tolist(), d[more].tolist() if more else us, strict=True)
    return sorted(out, key=lambda r: (r[0], r[1] is None, r[1] or ""))


DELIVERY = "message_id string, event string, attempt int, ms long"


class Redelivery(StatefulProcessor):
    """A message is handed out when it is sent and again whenever it stays unacknowledged for `visibility` seconds.

    After `most` hand-outs it is dead; a message (or dead letter) that is `retention` seconds old is dropped.
    """

    def __init__(self, visibility: int, most: int, retention: int):
        self.visibility, self.most, self.retention = visibility * 1000, most, retention * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.message = handle.getValueState("message", "sent long, attempt int, due long, ended boolean")

    def _advance(self, m: tuple | None, now: int, out: list[tuple[str, int, int]]) -> tuple | None:
        """The message after what falls due up to now; out gets (event, attempt, time)."""
        while m is not None and m[2] <= now:
            sent, attempt, due, ended = m
            if ended or due >= sent + self.retention:
                if not ended:
                    out.append(("expired", attempt, sent + self.retention))
                m = None
            elif attempt < self.most:
                out.append(("delivered", attempt + 1, due))
                m = (sent, attempt + 1, min(due + self.visibility, sent + self.retention), False)
            else:
                out.append(("dead", attempt, due))
                m = (sent, attempt, sent + self.retention, True)  # known until then, so a repeated sending is none
        return m

    def _told(self, key: tuple, old: tuple | None, m: tuple | None, out: list[tuple[str, int, int]]) -> Iterator:
        """Stores the message: the state is asked and told once a call, as each time is a message to Spark."""
        if m is None and old is not None:
            self.message.clear()
        elif m != old:
            self.message.update(m)
            if old is None or old[2] != m[2]:
                self.handle.registerTimer(m[2])
        if out:
            yield from self._frames(key, out)

    def _frames(self, key: tuple, out: list[tuple[str, int, int]]) -> Iterator:
        yield pd.DataFrame({"message_id": [str(key[0])] * len(out), "event": [e for e, _, _ in out], "attempt": [a for _, a, _ in out], "at": pd.to_datetime([t for _, _, t in out], unit="ms")})

    def _stored(self) -> tuple | None:
        m = self.message.get()
        return None if m is None else tuple(m)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from self._taken(key, _ordered(rows, "ts", "kind"))

    def _taken(self, key: tuple, events: list[tuple]) -> Iterator:
        out, old = [], self._stored()
        m = old
        for us, kind, _ in events:
            now = us // 1000
            m = self._advance(m, now, out)
            if kind == "sent" and m is None:
                out.append(("delivered", 1, now))
                m = (now, 1, now + min(self.visibility, self.retention), False)
            elif kind == "done" and m is not None and not m[3]:
                out.append(("done", m[1], now))
                m = (m[0], m[1], m[0] + self.retention, True)
        yield from self._told(key, old, m, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        out, old = [], self._stored()
        yield from self._told(key, old, self._advance(old, timerValues.getCurrentWatermarkInMs(), out), out)

    def close(self) -> None: ...


class _RowRedelivery(Redelivery):
    """The same over rows: most messages have a few, for which frames cost more than all else."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        events = [(r["us"], r["kind"], None) for r in rows]
        yield from self._taken(key, sorted(events, key=lambda r: (r[0], r[1] is None, r[1] or "")))

    def _frames(self, key: tuple, out: list[tuple[str, int, int]]) -> Iterator[Row]:
        for event, attempt, ms in out:
            yield Row(message_id=str(key[0]), event=event, attempt=attempt, ms=ms)


def redelivery_stream(events: DataFrame, *, visibility: int = 300, most: int = 3, retention: int = 14 * DAY, late: str = "10 minutes") -> DataFrame:
    """(message_id, event, attempt, at) from events (message_id, kind, ts): kind `sent` puts a message in, `done` acknowledges it.

    Events: delivered (with the number of the hand-out), done, dead (the dead-letter output), expired.
    A repeated sending of a known message and an acknowledgement of one that has ended change nothing.
    """
    state_store(events.sparkSession)
    rows = timed(events.select("message_id", "kind", "ts"), "ts", late).withColumn("us", F.unix_micros("ts"))  # a row's time would be that of the worker's zone
    told = rows.groupBy("message_id").transformWithState(_RowRedelivery(visibility, most, retention), DELIVERY, "append", "eventTime")
    return told.select("message_id", "event", "attempt", F.timestamp_millis("ms").alias("at"))


class Revocations(StatefulProcessor):
    """Uses of a token are refused from its revocation until the revocation ends; then its state is gone."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.until = handle, handle.getValueState("until", "until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        told = self.until.get()  # asked once a call, as each time is a message to Spark
        old = end = told[0] if told else None
        uses, allowed = [], []
        for us, kind, until in _ordered(rows, "ts", "kind", "until"):  # a revocation comes before a use at the same time
            if kind == "revoked":
                end = max(_ms(until), end or 0)
            else:
                uses.append(us)
                allowed.append(end is None or us // 1000 >= end)
        if end != old:
            self.until.update((end,))
            self.handle.registerTimer(end)
        if uses:
            yield pd.DataFrame({"token": [str(key[0])] * len(uses), "ts": pd.to_datetime(uses, unit="us"), "allowed": allowed})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        told = self.until.get()
        if told is not None and told[0] <= expiredTimerInfo.getExpiryTimeInMs():
            self.until.clear()
        yield from ()

    def close(self) -> None: ...


def revocation_stream(events: DataFrame, *, late: str = "10 minutes") -> DataFrame:
    """(token, ts, allowed) of every use, from events (token, kind, ts, until): kind `revoked` bars the token until `until`, others are uses.

    The state holds the revocations that have not ended yet, and no others.
    """
    state_store(events.sparkSession)
    rows = timed(events.select("token", "kind", "ts", "until"), "ts", late)
    return rows.groupBy("token").transformWithStateInPandas(Revocations(), "token string, ts timestamp, allowed boolean", "append", "eventTime")


class LastSamples(StatefulProcessor):
    """The last `size` samples of a key in a ring of blocks; gives the percentiles of those after each trigger."""

    def __init__(self, size: int, shares: list[float], block: int = 250):
        self.size, self.shares, self.block = size, shares, block

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.blocks = handle.getMapState("blocks", "n long", "samples array<double>")
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = _in_order(rows, ["ts", "value"])["value"].tolist()
        n = (self.seen.get() or (0,))[0]
        for i in range(0, len(new)):
            at = (n + i) // self.block
            if (n + i) % self.block == 0 or i == 0:
                held = list(self.blocks.getValue((at,))[0]) if (n + i) % self.block else []
            held.append(new[i])
            if (n + i + 1) % self.block == 0 or i + 1 == len(new):
                self.blocks.updateValue((at,), (held,))
        n += len(new)
        self.seen.update((n,))
        first, kept = max(0, n - self.size), []
        for (at,), (samples,) in sorted(self.blocks.iterator()):
            if (at + 1) * self.block <= first:
                self.blocks.removeKey((at,))
            else:
                kept += samples[max(0, first - at * self.block) :]
        kept.sort()
        told = {f"p{round(100 * s)}": [kept[min(len(kept) - 1, int(s * len(kept)))]] for s in self.shares}
        yield pd.DataFrame({"key": [str(key[0])], "n": [len(kept)], "seen": [n]} | told)

    def close(self) -> None: ...


def last_samples_stream(events: DataFrame, key: str, value: str, *, ts: str = "ts", size: int = 10_000, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """(key, n, seen, p50, ...) after each trigger: percentiles of the last `size` samples of each key, by index floor(share * n) of the sorted samples.

    A trigger's samples count in the order of their times; a key has at most size + 250 of them in its state.
    """
    state_store(events.sparkSession)
    rows = events.selectExpr(f"cast(`{key}` as string) as key", f"cast(`{value}` as double) as value", f"cast(`{ts}` as timestamp) as ts")
    out = "key string, n long, seen long" + "".join(f", p{round(100 * s)} double" for s in shares)
    return rows.groupBy("key").transformWithStateInPandas(LastSamples(size, list(shares)), out, "update", "none")


MISSING = ("not breaching", "breaching", "ignore", "missing")


def judged(points: list[bool | None], rule: str, before: str) -> str:
    """The state of an alarm after some periods (breaching or not, None without data): ALARM, OK or INSUFFICIENT_DATA.

    All breaching is an alarm, any that does not breach is none. Periods without data count as the
    rule says; under `ignore` and `missing` they count as nothing, so the state stays as it was where
    the others do not decide, and under `missing` there is too little data where none of them has any.
    """
    if rule in ("not breaching", "breaching"):
        points = [rule == "breaching" if p is None else p for p in points]
    if any(p is False for p in points):
        return "OK"
    if all(points):
        return "ALARM"
    return "INSUFFICIENT_DATA" if rule == "missing" and all(p is None for p in points) else before


class Alarms(StatefulProcessor):
    """The state of an alarm after every period, also after those without data, as far as the watermark has come."""

    def __init__(self, seconds: int, threshold: float, periods: int, rule: str):
        self.length, self.threshold, self.periods, self.rule = seconds * 1000, threshold, periods, rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "next long, points array<int>, state string")

    def _period(self, told: tuple | None, start: int, value: float | None, out: list) -> tuple:
        points, state = ([*told[1]], told[2]) if told else ([], "INSUFFICIENT_DATA")
        points = [*points, -1 if value is None else int(value > self.threshold)][-self.periods :]
        full = [None] * (self.periods - len(points)) + [None if p < 0 else bool(p) for p in points]
        state = judged(full, self.rule, state)
        out.append((pd.Timestamp(start, unit="ms"), value, state))
        return start + self.length, points, state

    def _told(self, key: tuple, told: tuple | None, out: list) -> Iterator[pd.DataFrame]:
        if told is not None:
            self.seen.update(told)
            self.handle.registerTimer(told[0] + self.length)  # when the next period is over
        if out:
            yield pd.DataFrame({"alarm": [str(key[0])] * len(out), "period_start": [o[0] for o in out], "value": [o[1] for o in out], "state": [o[2] for o in out]}).astype({"value": "Float64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out, told = [], self.seen.get()
        for r in _in_order(rows, ["window_start"]).itertuples():
            start = _ms(r.window_start)
            while told is not None and told[0] < start:
                told = self._period(told, told[0], None, out)
            if told is None or told[0] == start:
                told = self._period(told, start, r.value, out)
        yield from self._told(key, told, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out, told = [], self.seen.get()
        while told is not None and told[0] + self.length <= timerValues.getCurrentWatermarkInMs():
            told = self._period(told, told[0], None, out)
        yield from self._told(key, told, out)

    def close(self) -> None: ...


def alarm_stream(events: DataFrame, key: str, value: Column, *, ts: str = "ts", seconds: int = 300, threshold: float, periods: int, rule: str = "not breaching", late: str = "10 minutes") -> DataFrame:
    """(alarm, period_start, value, state) for every period of every alarm: value is an aggregate of the period's events.

    Periods are aggregated in a streaming window, map-side first, and go to the alarm's state once the
    watermark has passed them; a period in a row without events counts as `rule` (of MISSING) says.
    """
    if rule not in MISSING:
        raise ValueError(f"a rule for missing data is one of {MISSING}")
    state_store(events.sparkSession)
    windows = timed(events, ts, late).groupBy(F.window(ts, f"{seconds} seconds"), F.col(key).cast("string").alias("alarm")).agg(value.cast("double").alias("value"))
    rows = windows.select("alarm", F.col("window.start").alias("window_start"), "value", F.window_time("window").alias("_time"))
    return rows.groupBy("alarm").transformWithStateInPandas(Alarms(seconds, threshold, periods, rule), "alarm string, period_start timestamp, value double, state string", "append", "eventTime")
