import random

from pyspark.sql import functions as F

from lodestone.llm._common import copies_of, join_checked, let, parts_of, scan, text_slices


def test_scan_equals_running_values(spark):
    r = random.Random(1)
    for n in (0, 1, 5, 99, 100, 101, 2345):
        v = [r.randint(-50, 50) for _ in range(n)]
        df = spark.createDataFrame([(v,)], "v array<long>").select(scan(F.col("v"), lambda a, b: a + b, block=100).alias("s"), scan(F.col("v"), F.greatest, block=8).alias("m"))
        got = df.first()
        assert list(got.s) == [sum(v[: i + 1]) for i in range(n)] and list(got.m) == [max(v[: i + 1]) for i in range(n)]


def test_let(spark):
    assert spark.range(1).select(let(F.lit(3), lambda x: x * x)).first()[0] == 9


def test_copies_and_checked_joins(spark):
    rows = spark.range(1000).selectExpr("id", "if(id % 3 = 0, 'hot', cast(id as string)) as key")
    for hot in (10, 10_000):
        got = {r.id: r._rep for r in copies_of(rows, "key", "id", F.max, hot=hot).collect()}
        assert got == {i: 999 for i in range(0, 1000, 3)}
    few = spark.range(10).withColumnRenamed("id", "id")
    for most in (5, 100):
        assert join_checked(rows, few, "id", "left_semi", most).count() == 10


def test_parts_of_a_text(spark):
    r = random.Random(4)
    text = "".join(r.choice("aé漢😀\n") for _ in range(3000))
    spans = [sorted(r.choices(range(3001), k=2)) for _ in range(200)] + [[0, 0], [3000, 3000], [0, 3000], [256, 512], [255, 256]]
    df = spark.createDataFrame([(text, spans), ("", [[0, 0]]), ("", [])], "text string, spans array<struct<start:int,end:int>>")
    rows = df.select("spans", parts_of(F.col("text"), F.col("spans")).alias("p")).collect()
    assert [list(x.p) for x in rows] == [[text[a:b] for a, b in spans], [""], []]


def test_text_slices():
    import pyarrow as pa

    texts = ["a" * n for n in (5, 0, 30, 1, 1, 1, 12)] + [None]
    got = list(text_slices(pa.array(texts, pa.string()), 10))
    assert [x for _, run in got for x in run] == texts and [a for a, _ in got] == [0, 3, 7] and list(text_slices(pa.array([], pa.string()), 10)) == []
    assert [len(run) for _, run in text_slices(pa.array(texts, pa.string()), 10, 5)] == [2, 1, 2, 2, 1]
