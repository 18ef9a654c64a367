"""Join of texts with the longest name of a dimension table that they contain."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.storage import BROADCAST_ROWS, written

#: Characters of a name that texts and names are joined on where the names are too many to broadcast.
GRAM = 8


def longest_name(rows: DataFrame, names: DataFrame, *, text: str = "text", name: str = "name", out: str = "found", most: int = BROADCAST_ROWS) -> DataFrame:
    """rows with `out`: the longest name that the text contains, of equally long ones the first by alphabet; null if there is none.

    Names are compared as they are; null and empty ones are none. Up to `most` names go to the tasks as
    one Aho-Corasick automaton, built once per worker, so a text costs its length whatever the names.
    More are joined by their first characters and then compared whole.
    """
    dim = written(names.select(F.col(name).alias("n")).where("n <> ''").distinct(), "names")
    return _automaton(rows, dim, text, out) if dim.limit(most + 1).count() <= most else _by_grams(rows, dim, text, out)


def _automaton(rows: DataFrame, dim: DataFrame, text: str, out: str) -> DataFrame:
    known = rows.sparkSession.sparkContext.broadcast([r["n"] for r in dim.collect()])  # counted
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        tree = ahocorasick.Automaton()
        for n in known.value:
            tree.add_word(n, n)
        if known.value:
            tree.make_automaton()
        for batch in batches:
            found = []
            for t in batch.column(at):
                hits = (n for _, n in tree.iter(t.as_py())) if known.value and t.is_valid else ()
                found.append(min(hits, key=lambda n: (-len(n), n), default=None))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, `{out}` string")


def _by_grams(rows: DataFrame, dim: DataFrame, text: str, out: str) -> DataFrame:
    texts = written(rows.select(F.col(text).alias("t")).where("t is not null").distinct(), "texts")
    names = dim.withColumn("gram", F.substring("n", 1, GRAM))
    sizes = [r[0] for r in names.select(F.char_length("gram")).distinct().collect()]  # GRAM at most
    grams = None
    for size in sizes:
        part = texts.where(F.char_length("t") >= size).select("t", F.explode(F.sequence(F.lit(1), F.char_length("t") - size + 1)).alias("p")).select("t", "p", F.expr(f"substring(t, p, {size})").alias("gram"))
        grams = part if grams is None else grams.unionByName(part)
    if grams is None:
        return rows.withColumn(out, F.lit(None).cast("string"))
    met = grams.join(names, "gram").where("substring(t, p, char_length(n)) = n")
    best = met.groupBy("t").agg(F.min(F.struct((-F.char_length("n")).alias("l"), "n")).alias("b")).select(F.col("t").alias("_t"), F.col("b.n").alias(out))
    return rows.join(best, rows[text] == best["_t"], "left").drop("_t")
