"""The citation graph as two DataFrames: nodes (source_id, ...) and edges (citing_id, cited_id, treatment, is_negative)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.fixed import OVERRULING
from lodestone.storage import written


def citing_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source_id, n_citing): in-degree with negative and repeated edges."""
    n = edges.groupBy(F.col("cited_id").alias("source_id")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.select("source_id").join(n, "source_id", "left").select("source_id", F.coalesce("n", F.lit(0)).alias("n_citing"))


def good_law(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source_id, is_good_law, overruled_by): the order of edges and nodes does not matter."""
    bad = edges.where(F.col("treatment").isin(*OVERRULING)).groupBy(F.col("cited_id").alias("source_id")).agg(F.max("citing_id").alias("overruled_by"))
    return nodes.select("source_id").join(bad, "source_id", "left").select("source_id", F.col("overruled_by").isNull().alias("is_good_law"), "overruled_by")


def precedents(edges: DataFrame, start: DataFrame, depth: int = 2) -> DataFrame:
    """(start_id, source_id, depth): what each start cites within `depth` hops, at its least depth."""
    hops = edges.select("citing_id", "cited_id").distinct()
    reached = start.select(F.col("source_id").alias("start_id"), "source_id", F.lit(0).alias("depth"))
    found = None
    for d in range(1, depth + 1):
        nxt = reached.join(hops, reached.source_id == hops.citing_id).select("start_id", F.col("cited_id").alias("source_id"), F.lit(d).alias("depth")).distinct()
        found = nxt if found is None else found.unionByName(nxt.join(found, ["start_id", "source_id"], "left_anti"))
        reached = nxt
    return found


def precedents_of_many(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """As precedents, for any depth and many starts: a written frontier and table of the reached pairs, so that the plan is that of one hop.

    A start that is cited by what it cites is found like any other source.
    """
    hops = written(edges.select("citing_id", "cited_id").distinct(), "hops")
    frontier = start.select(F.col("source_id").alias("start_id"), "source_id").distinct()
    found = None
    for d in range(1, depth + 1):
        nxt = frontier.join(hops, frontier.source_id == hops.citing_id).select("start_id", F.col("cited_id").alias("source_id")).distinct()
        nxt = nxt if found is None else nxt.join(found.select("start_id", "source_id"), ["start_id", "source_id"], "left_anti")
        # only pairs that are new are followed: what the others reach has been reached before
        frontier = written(nxt, "frontier")
        level = frontier.withColumn("depth", F.lit(d))
        found = level if found is None else found.unionByName(level)
        if not frontier.limit(1).count():
            break
    return found


def pagerank(nodes: DataFrame, edges: DataFrame, *, damping: float = 0.85, rounds: int = 30, every: int = 5) -> DataFrame:
    """(source_id, pagerank) divided by the largest.

    Negative edges pass nothing but count in a node's out-degree; edges from or to ids that are no
    nodes are ignored; dangling nodes give nothing back. The lineage is cut every few rounds with
    a checkpoint in the shared folder.
    """
    ids = nodes.select("source_id").distinct()
    real = edges.join(ids, edges.citing_id == ids.source_id, "left_semi").join(ids, edges.cited_id == ids.source_id, "left_semi")
    degree = real.groupBy("citing_id").agg(F.count(F.lit(1)).alias("out"))
    flow = real.where("not is_negative").join(degree, "citing_id").groupBy("citing_id", "cited_id").agg(F.sum(1 / F.col("out")).alias("w"))
    flow = written(flow, "flow")
    n = ids.count()
    rank = ids.withColumn("pagerank", F.lit(1.0 / max(n, 1)))
    for i in range(rounds):
        got = flow.join(rank, flow.citing_id == rank.source_id).groupBy("cited_id").agg(F.sum(F.col("w") * F.col("pagerank")).alias("got"))
        rank = ids.join(got, ids.source_id == got.cited_id, "left").select("source_id", (F.lit((1 - damping) / max(n, 1)) + F.lit(damping) * F.coalesce("got", F.lit(0.0))).alias("pagerank"))
        if (i + 1) % every == 0 or i + 1 == rounds:
            rank = rank.checkpoint()
    top = rank.agg(F.max("pagerank").alias("top"))
    return rank.crossJoin(F.broadcast(top)).select("source_id", (F.col("pagerank") / F.col("top")).alias("pagerank"))  # top has one row


def enrich(rows: DataFrame, ranks: DataFrame, law: DataFrame, counts: DataFrame, *, boost: float = 0.15) -> DataFrame:
    """Drops overruled sources, adds boost * pagerank to the score (at most 1) and annotates; unknown sources are good law."""
    joined = rows.join(law, "source_id", "left").where(F.coalesce("is_good_law", F.lit(True))).join(ranks, "source_id", "left").join(counts, "source_id", "left")
    return joined.withColumn("score", F.least(F.lit(1.0), F.col("score") + F.lit(boost) * F.coalesce("pagerank", F.lit(0.0))))


def sizes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: n_nodes, n_edges, n_negative."""
    counted = edges.agg(F.count(F.lit(1)).alias("n_edges"), F.count_if("is_negative").alias("n_negative"))
    return nodes.agg(F.count_distinct("source_id").alias("n_nodes")).crossJoin(F.broadcast(counted))  # one row each


def resolved(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose cited_id is a citation string, with the id of the node that carries it; others stay."""
    known = nodes.where("citation_string is not null").groupBy("citation_string").agg(F.min("source_id").alias("_id"))
    return edges.join(known, edges.cited_id == known.citation_string, "left").withColumn("cited_id", F.coalesce("_id", "cited_id")).drop("_id", "citation_string")
