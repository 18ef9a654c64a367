"""Order statistics and neighbours within groups, without one task for a hot group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.storage import join_checked, written


def order_statistics(rows: DataFrame, by: Sequence[str], value: str, ranks: dict[str, Column], *, accuracy: int = 10_000) -> DataFrame:
    """(by, n, one column per rank): the values at the given 0-based ranks of each group's sorted values, exactly.

    ranks: name -> expression of the group's count `n`. Approximate quantiles bracket each rank
    within about half a percent of the group; values below a bracket are only counted (partial sums
    on the map side), and only those inside one are shuffled and sorted. Null values are left out.
    """
    names = list(ranks)
    rows = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    size = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("_least"), F.percentile_approx("_v", [i / 1000 for i in range(1, 1001)], accuracy).alias("_q"))

    def bracket(name: str) -> Column:
        share = (ranks[name] + 0.5) / F.col("n") * 1000
        low, high = F.floor(share - 2).cast("int"), F.ceil(share + 2).cast("int")
        edge = lambda i: F.when(i < 1, F.col("_least")).otherwise(F.get(F.col("_q"), F.least(i, F.lit(1000)) - 1))
        return F.struct(ranks[name].cast("long").alias("rank"), edge(low).alias("low"), edge(high).alias("high")).alias(name)

    brackets = written(size.select(*by, "n", *map(bracket, names)), "brackets")
    each = join_checked(rows, brackets, list(by), "inner") if by else rows.crossJoin(F.broadcast(brackets))  # without groups there is one row
    below = each.groupBy(*by).agg(*[F.count_if(F.col("_v") < F.col(f"{x}.low")).alias(x) for x in names])
    inside = each.where(F.array_contains(F.array(*[F.col("_v").between(F.col(f"{x}.low"), F.col(f"{x}.high")) for x in names]), True)).groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("c"), *[F.first(F.col(x)).alias(x) for x in names])
    out = brackets.select(*by, "n")
    for x in names:
        near = inside.where((F.col("_v") >= F.col(f"{x}.low")) & (F.col("_v") <= F.col(f"{x}.high"))).select(*by, "_v", "c", F.col(f"{x}.rank").alias("r"))
        upto = near.withColumn("upto", F.sum("c").over(Window.partitionBy(*by).orderBy("_v")))
        at = upto.join(below.select(*by, F.col(x).alias("b")), list(by)) if by else upto.crossJoin(F.broadcast(below.select(F.col(x).alias("b"))))
        found = at.where(F.col("b") + F.col("upto") > F.col("r")).groupBy(*by).agg(F.min("_v").alias(x))
        out = out.join(found, list(by)) if by else out.crossJoin(F.broadcast(found))
    return out


def with_next_in_group(rows: DataFrame, group: str, order: Sequence[str], value: str, out: str) -> DataFrame:
    """Adds `out`: the value of the row that follows in its group, by the given order; null for the last.

    Rows are range-partitioned by group and order and written once; each part is a window of its
    own, and its last row looks up the first row of the next part. So a group of any size is spread.
    """
    keys = [group, *order]
    ranged = rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id())
    kept = written(ranged, "ranged")
    line = Window.partitionBy("_part").orderBy(*keys)
    following = F.struct(F.col(group).alias("g"), F.col(value).alias("v"))
    first = kept.groupBy("_part").agg(F.min(F.struct(*keys, F.col(value).alias("_value"))).alias("f"))
    first = first.withColumn("_from", F.lag("_part").over(Window.orderBy("_part"))).select(F.col("_from").alias("_part"), F.struct(F.col(f"f.{group}").alias("g"), F.col("f._value").alias("v")).alias("_later"))  # a row per part
    near = kept.withColumn("_next", F.lead(following).over(line)).join(F.broadcast(first.where("_part is not null")), "_part", "left")
    nxt = F.coalesce("_next", "_later")
    return near.withColumn(out, F.when(nxt["g"].eqNullSafe(F.col(group)), nxt["v"])).drop("_part", "_next", "_later")


def numbered_in_group(rows: DataFrame, group: str, order: Sequence[str], out: str = "row_no") -> DataFrame:
    """Adds `out`: the number of the row in its group, from 1, by the given order; null groups are one group.

    Rows are range-partitioned by group and order and written once. Each part numbers its own rows;
    a part whose first group began in earlier parts adds their rows of it, and there is at most one
    such group a part. So a group of any size is spread.
    """
    keys = [group, *order]
    kept = written(rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = kept.groupBy("_part", F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begun = sizes.select(F.col("_part").alias("_p"), "_g", F.sum("_n").over(earlier).alias("_before")).where("_before is not null")  # a row a part at most
    own = F.row_number().over(Window.partitionBy("_part", group).orderBy(*order))
    met = kept.withColumn(out, own).join(F.broadcast(begun), (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")), "left")
    return met.withColumn(out, F.col(out) + F.coalesce("_before", F.lit(0))).drop("_part", "_p", "_g", "_before")
