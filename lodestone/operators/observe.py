"""Request metrics, alarms, logs and limits over event tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.ordering import order_statistics


def route_percentiles(events: DataFrame, route: str, ms: str, quantiles: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """(route, n, p50, ...): the element at floor(n * q) of the sorted values, exact however many events a route has."""
    ranks = {f"p{round(q * 100)}": F.least(F.floor(F.col("n") * q), F.col("n") - 1) for q in quantiles}
    return order_statistics(events, [route], ms, ranks)


def ring_buffer(events: DataFrame, order: tuple[str, ...], size: int = 10_000) -> DataFrame:
    """The last `size` rows: a distributed top-k."""
    return events.orderBy(*[F.desc(c) for c in order]).limit(size)


def error_counts(events: DataFrame, route: str, is_error: Column) -> DataFrame:
    return events.groupBy(route).agg(F.count(F.lit(1)).alias("requests"), F.count_if(is_error).alias("errors"))


def _time(events: DataFrame, ts: str) -> Column:
    """The event time as TIMESTAMP. A column that is one stays as it is, as a cast would hide its watermark."""
    return F.col(ts) if events.schema[ts].dataType.simpleString() == "timestamp" else F.col(ts).cast("timestamp")


def tumbling(events: DataFrame, ts: str, width: str, *by: str, value: str | None = None) -> DataFrame:
    """(window_start, by, n[, total, highest, average, p99]) per tumbling window; batch or stream. p99 is approximate (1 in 10,000 ranks)."""
    more = [F.sum(value).alias("total"), F.max(value).alias("highest"), F.avg(value).alias("average"), F.percentile_approx(value, 0.99, 10_000).alias("p99")] if value else []
    return events.groupBy(F.window(_time(events, ts), width), *by).agg(F.count(F.lit(1)).alias("n"), *more).select(F.col("window.start").alias("window_start"), *by, "n", *[c for c in ("total", "highest", "average", "p99") if value])


def sliding(events: DataFrame, ts: str, width: str, step: str, *by: str) -> DataFrame:
    return events.groupBy(F.window(_time(events, ts), width, step), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), *by, "n")


def sessions(events: DataFrame, ts: str, gap: str, *by: str) -> DataFrame:
    return events.groupBy(F.session_window(_time(events, ts), gap), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *by, "n")


def alarms(events: DataFrame, ts: str, minutes: int, statistic: Column, threshold: float, periods: int) -> DataFrame:
    """(period_start, value, breaching, alarm): alarm after `periods` breaching periods in a row.

    Periods without events do not breach. The calendar runs over the periods between the first and
    the last event, whose number depends on the time span, not on the events.
    """
    rows = events.withColumn("p", F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / (60 * minutes)))
    stat = rows.groupBy("p").agg(statistic.alias("value"))
    ends = stat.agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    calendar = ends.where("lo is not null").select(F.explode(F.sequence("lo", "hi")).alias("p"))
    dense = calendar.join(stat, "p", "left").withColumn("breaching", F.coalesce(F.col("value") > threshold, F.lit(False)))
    # every period counts towards itself and the following ones: an aggregate instead of a window over the whole calendar
    later = dense.where("breaching").select(F.explode(F.sequence(F.col("p"), F.col("p") + (periods - 1))).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("_n"))
    dense = dense.join(later, "p", "left")
    n = F.coalesce("_n", F.lit(0))
    return dense.select(F.timestamp_seconds(F.col("p") * 60 * minutes).alias("period_start"), "value", "breaching", (n == periods).alias("alarm"))


def top_messages(logs: DataFrame, where: Column, by: str, k: int = 20) -> DataFrame:
    return logs.where(where).groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by).limit(k)


def exposition(metrics: DataFrame, name: str, label: str, value: str, *, column: str | None = None) -> DataFrame:
    """One line of metrics text per row: name{label="x"} value; x is the column (the label's own unless given)."""
    return metrics.select(F.format_string('%s{%s="%s"} %s', F.lit(name), F.lit(label), F.col(column or label), F.col(value).cast("string")).alias("line")).orderBy("line")


def _limited(events: DataFrame, key: str, ts: str, decide: Callable[[], Callable[[float, bool], bool]]) -> DataFrame:
    """(key, seq, allowed): a fold over each key's ordered times. seq: the time in microseconds.

    Keys are hashed to tasks and sorted there; a task streams through its rows and keeps the state
    of one key, so a key with any number of requests needs no more memory than one with few.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, allow = None, None
        for batch in batches:
            keys, times, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for k, us in zip(keys, times, strict=True):
                fresh = allow is None or k != now
                if fresh:
                    now, allow = k, decide()
                out.append(allow(us / 1e6, fresh))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], names=["key", "seq", "allowed"])

    rows = events.select(F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("seq"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.repartition("key").sortWithinPartitions("key", "seq").mapInArrow(run, f"key {kind}, seq long, allowed boolean")


def window_rule(limit: int, seconds: float) -> Callable[[], Callable[[float, bool], bool]]:
    """`limit` requests per window; a window opens at the first request after the last one closed."""

    def decide() -> Callable[[float, bool], bool]:
        start, n = 0.0, 0

        def allow(t: float, fresh: bool) -> bool:
            nonlocal start, n
            if fresh or t >= start + seconds:
                start, n = t, 0
            n += 1
            return n <= limit

        return allow

    return decide


def bucket_rule(capacity: float, per_second: float) -> Callable[[], Callable[[float, bool], bool]]:
    """Tokens refill with time up to the capacity; a request takes one or is refused."""

    def decide() -> Callable[[float, bool], bool]:
        tokens, last = capacity, 0.0

        def allow(t: float, fresh: bool) -> bool:
            nonlocal tokens, last
            tokens = capacity if fresh else min(capacity, tokens + (t - last) * per_second)
            last = t
            ok = tokens >= 1
            tokens -= ok
            return bool(ok)

        return allow

    return decide


def fixed_window_limit(events: DataFrame, key: str, ts: str, limit: int, seconds: int = 60) -> DataFrame:
    """(key, seq, allowed) by window_rule; streaming.windows.fixed_window_stream is the stream."""
    return _limited(events, key, ts, window_rule(limit, seconds))


def token_bucket(events: DataFrame, key: str, ts: str, capacity: float = 60, per_second: float = 1.0) -> DataFrame:
    """(key, seq, allowed) by bucket_rule; streaming.windows.token_bucket_stream is the stream."""
    return _limited(events, key, ts, bucket_rule(capacity, per_second))
