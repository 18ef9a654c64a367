"""Keyed state over streams of files."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lodestone.streaming import state

T = datetime(2024, 1, 1)
AT = lambda s: T + timedelta(seconds=s)


def run(spark, make, batches, schema, tmp_path):
    """The output of make(stream) over batches, each a file and a trigger."""
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").json(src)
        stream = spark.readStream.schema(schema).json(src)
        q = make(stream).writeStream.outputMode(MODE.get(make, "append")).option("checkpointLocation", cp)
        got = []
        q.foreachBatch(lambda d, n: got.append(d.collect())).trigger(availableNow=True).start().awaitTermination()
        yield [r for g in got for r in g]


MODE = {}
EVENTS = "message_id string, kind string, ts timestamp"


def test_redelivery(spark, tmp_path):
    sent = [(m, "sent", AT(0)) for m in ("ok", "slow", "twice", "never")]
    done = [("ok", "done", AT(5)), ("slow", "done", AT(305)), ("twice", "done", AT(605)), ("late", "done", AT(7))]
    clock = lambda s: [("clock", "sent", AT(s))]
    batches = [sent, [*done[:1], done[3], ("ok", "sent", AT(6))], done[1:3], clock(5000), clock(5001)]
    out = sorted((r.message_id, r.event, r.attempt, int((r.at - T).total_seconds())) for part in run(spark, state.redelivery_stream, batches, EVENTS, tmp_path) for r in part if r.message_id != "clock")
    assert out == sorted([
        ("ok", "delivered", 1, 0), ("ok", "done", 1, 5),
        ("slow", "delivered", 1, 0), ("slow", "delivered", 2, 300), ("slow", "done", 2, 305),
        ("twice", "delivered", 1, 0), ("twice", "delivered", 2, 300), ("twice", "delivered", 3, 600), ("twice", "done", 3, 605),
        ("never", "delivered", 1, 0), ("never", "delivered", 2, 300), ("never", "delivered", 3, 600), ("never", "dead", 3, 900)])


def test_retention_ends_a_message(spark, tmp_path):
    make = lambda s: state.redelivery_stream(s, visibility=300, most=9, retention=1000)
    out = [(r.event, r.attempt, int((r.at - T).total_seconds())) for part in run(spark, make, [[("m", "sent", AT(0))], [("clock", "sent", AT(9000))], [("clock", "sent", AT(9001))]], EVENTS, tmp_path) for r in part if r.message_id == "m"]
    assert sorted(out, key=lambda r: r[2]) == [("delivered", 1, 0), ("delivered", 2, 300), ("delivered", 3, 600), ("delivered", 4, 900), ("expired", 4, 1000)]


def test_revocations_end_and_leave_no_state(spark, tmp_path):
    schema = "token string, kind string, ts timestamp, until timestamp"
    rows = [[("a", "revoked", AT(10), AT(100)), ("a", "used", AT(5), None), ("a", "used", AT(20), None), ("b", "used", AT(20), None)], [("a", "used", AT(99), None), ("a", "used", AT(100), None)]]
    rows += [[("c", "used", AT(9000), None)], [("c", "used", AT(9001), None), ("a", "used", AT(9001), None)]]
    out = sorted((r.token, int((r.ts - T).total_seconds()), r.allowed) for part in run(spark, state.revocation_stream, rows, schema, tmp_path) for r in part)
    assert out == [("a", 5, True), ("a", 20, False), ("a", 99, False), ("a", 100, True), ("a", 9001, True), ("b", 20, True), ("c", 9000, True), ("c", 9001, True)]
    left = spark.read.format("statestore").option("stateVarName", "until").load(str(tmp_path / "cp"))
    assert left.count() == 0


def test_last_samples_are_those_of_the_batch_query(spark, tmp_path):
    import random

    r, schema = random.Random(1), "route string, ms double, ts timestamp"
    make = lambda s: state.last_samples_stream(s, "route", "ms", size=600)
    MODE[make] = "update"
    batches, every, k = [], {}, 0
    for n in (10, 700, 1, 499, 1300):
        batch = []
        for _ in range(n):
            batch.append((r.choice("xyy"), float(r.randrange(10_000)), AT(k)))
            k += 1
        batches.append(batch)
    for batch, out in zip(batches, run(spark, make, batches, schema, tmp_path), strict=True):
        for route, ms, _ in batch:
            every.setdefault(route, []).append(ms)
        want = {}
        for route in {b[0] for b in batch}:
            last = sorted(every[route][-600:])
            want[route] = (len(last), len(every[route]), *(last[min(len(last) - 1, int(s * len(last)))] for s in (0.5, 0.95, 0.99)))
        assert {o.key: (o.n, o.seen, o.p50, o.p95, o.p99) for o in out} == want


class _Told:
    """A state variable and a handle that count how often Spark is asked."""

    def __init__(self):
        self.value, self.calls = None, []

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def clear(self):
        self.calls.append("clear")
        self.value = None

    def registerTimer(self, at):  # noqa: N802
        self.calls.append("timer")


def test_state_is_asked_once_a_call_however_many_rows():
    import pandas as pd

    told, p = _Told(), state.Revocations()
    p.handle = p.until = told
    rows = pd.DataFrame({"kind": ["used"] * 50 + ["revoked"] * 2, "ts": [AT(k) for k in range(50)] + [AT(10), AT(12)], "until": [pd.NaT] * 50 + [AT(30), AT(20)]})
    (out,) = p.handleInputRows(("a",), iter([rows[:20], rows[20:]]), None)
    assert out["allowed"].tolist() == [not 10 <= k < 30 for k in range(50)] and out["ts"].tolist() == [AT(k) for k in range(50)]
    assert sorted(told.calls) == ["get", "timer", "update"]


def test_redelivery_asks_its_state_once_a_call():
    import pandas as pd

    told, p = _Told(), state.Redelivery(300, 9, 14 * state.DAY)
    p.handle = p.message = told
    (out,) = p.handleInputRows(("m",), iter([pd.DataFrame({"kind": ["done", "sent", "sent"], "ts": [AT(2000), AT(0), AT(1000)]})]), None)
    assert out["attempt"].tolist() == [1, 2, 3, 4, 5, 6, 7, 7] and out["event"].tolist() == ["delivered"] * 7 + ["done"]
    assert sorted(told.calls) == ["get", "timer", "update"]


def test_redelivery_takes_rows_as_it_takes_frames():
    import random

    import pandas as pd
    from pyspark.sql import Row

    r = random.Random(5)
    for _ in range(50):
        events = [(AT(r.randrange(3000)), r.choice(["sent", "done", "else", None])) for _ in range(r.randrange(1, 8))]
        framed, rowed = state.Redelivery(300, 3, 2000), state._RowRedelivery(300, 3, 2000)
        for p in (framed, rowed):
            p.handle = p.message = _Told()
        want = [x for d in framed.handleInputRows(("m",), iter([pd.DataFrame(events, columns=["ts", "kind"])]), None) for x in d.itertuples(index=False)]
        got = list(rowed.handleInputRows(("m",), iter([Row(us=pd.Timestamp(t).value // 1000, kind=k) for t, k in events]), None))
        assert [(x.message_id, x.event, x.attempt, x.at.value // 1_000_000) for x in want] == [tuple(x) for x in got]
        assert framed.message.value == rowed.message.value and sorted(framed.message.calls) == sorted(rowed.message.calls)
