"""Chat formatting of reply trees, in DataFrame functions only.

1. Paths: (leaf, ancestor) pairs grow by doubling. Jump pointers to the 2^s-th ancestor come from
   self-joins of the pointers, and each round joins the pairs found so far to the pointers, which
   doubles the covered length: log2(depth) rounds whatever the shape, one row per path node.
2. Branches are ranked per conversation by the mean score of their nodes; the best `branches` stay.
3. Each path is formatted as one string. A turn is `<turn ROLE>` TEXT `</turn>` and a line end.
   In roles and texts `\\` becomes `\\s` and `<` becomes `\\l`, in roles `>` becomes `\\g` as well, so
   none can hold a mark, and reading is a split at `<` and three replacements. The loss mask lists
   the code-point ranges of the trained role's texts in the formatted string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm._common import checkpointed, parts_of, scan


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit(">"), F.lit("\\g"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">")), F.lit("\\s"), F.lit("\\"))


def linear_tree(turns: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as trees in which each turn answers the one before.

    Rows of a conversation are ordered by turn (null first), then role and text, so ties and
    repeated rows keep a defined order. Adds node and parent (longs) and a score of 0.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return turns.select("conv_id", F.row_number().over(order).cast("long").alias("node"), "role", "text").select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(nodes: DataFrame, most: int = 40) -> DataFrame:
    """(conv_id, leaf, node, up): every node of every root-to-leaf path, `up` steps above the leaf.

    nodes: (conv_id, node, parent). A parent that is not a node makes its child a root; nodes on a
    cycle have no leaf and give no path. Null conversation ids form one group. A tree deeper than
    2**most fails.
    """
    mine = F.coalesce(F.to_json(F.struct("conv_id")), F.lit(""))
    keyed = nodes.select(mine.alias("k"), "node", "parent").distinct()
    real = keyed.select("k", F.col("node").alias("parent")).distinct()
    jump = checkpointed(keyed.where("parent is not null").join(real, ["k", "parent"]).select("k", F.col("node").alias("x"), F.col("parent").alias("up")))
    leaf = keyed.select("k", "node").distinct().join(jump.select("k", F.col("up").alias("node")).distinct(), ["k", "node"], "left_anti")
    found = checkpointed(leaf.select("k", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")))
    for s in range(most):
        if not jump.limit(1).count():
            break
        hop = jump.select("k", F.col("x").alias("node"), F.col("up").alias("to"))
        more = found.join(hop, ["k", "node"]).select("k", "leaf", F.col("to").alias("node"), (F.col("up") + F.lit(1 << s)).alias("up"))
        found = checkpointed(found.unionByName(more))
        second = jump.select("k", F.col("x").alias("up"), F.col("up").alias("far"))
        jump = checkpointed(jump.join(second, ["k", "up"]).select("k", "x", F.col("far").alias("up")))
    else:
        raise ValueError("the reply tree has a cycle or is too deep")
    return found.select(F.col("k").alias("conv_key"), "leaf", "node", "up")


def best_branches(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """(conv_id, branch, up, role, text): the nodes of the best branches of each conversation.

    Branches are ranked by the mean score of their nodes (null counts as 0), ties by the least
    leaf. up counts from the leaf.
    """
    keyed = nodes.withColumn("conv_key", F.coalesce(F.to_json(F.struct("conv_id")), F.lit("")))
    along = paths(nodes).join(keyed, ["conv_key", "node"])
    along = checkpointed(along)
    ranked = along.groupBy("conv_key", "leaf").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("mean"))
    ranked = ranked.withColumn("branch", F.row_number().over(Window.partitionBy("conv_key").orderBy(F.desc("mean"), "leaf"))).where(F.col("branch") <= branches)
    return along.join(ranked.select("conv_key", "leaf", "branch"), ["conv_key", "leaf"]).select("conv_id", "conv_key", "branch", "up", "role", "text")


def formatted(nodes: DataFrame, *, branches: int = 1, trained: str = "assistant") -> DataFrame:
    """(conv_id, branch, formatted, loss_mask array<struct<start, end>>), one row per chosen path.

    nodes: (conv_id, node, parent, role, text, score); null roles and texts are empty. Rows with a
    null conv_id are one conversation. A path of any length is one row. Other columns are ignored;
    an empty table gives no rows.
    """
    turn = F.struct((-F.col("up")).alias("at"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    gathered = best_branches(nodes, branches).groupBy("conv_key", "branch").agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(turn)).alias("turns"))
    part = F.transform("turns", lambda t: F.struct(F.concat(F.lit("<turn "), escape_role(t["role"]), F.lit(">")).alias("head"), escape(t["text"]).alias("body"), t["role"].alias("role")))
    rows = gathered.withColumn("parts", part)
    tail = "</turn>\n"
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(tail))), "")
    ends = scan(F.transform("parts", lambda p: (F.char_length(p["head"]) + F.char_length(p["body"]) + len(tail)).cast("long")), lambda a, b: a + b)
    spans = F.zip_with("parts", ends, lambda p, e: F.struct((e - len(tail) - F.char_length(p["body"])).alias("start"), (e - len(tail)).alias("end"), (p["role"] == trained).alias("loss")))
    mask = F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return rows.select("conv_id", "branch", text.alias("formatted"), mask.alias("loss_mask"))


def read_turns(text: str) -> Column:
    """array<struct<role, text>> read back from a formatted string."""
    pieces = F.filter(F.split(text, "<", -1), lambda p: p.startswith("turn "))
    return F.transform(pieces, lambda p: F.struct(unescape(F.substring(p, F.lit(6), F.locate(">", p) - 6)).alias("role"), unescape(F.substring(p, F.locate(">", p) + 1, F.char_length(p))).alias("text")))


def digest(done: DataFrame) -> DataFrame:
    rows = done.withColumn("turns", read_turns("formatted"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(parts_of(F.col("formatted"), F.col("loss_mask")), unescape), "")
    rows = rows.withColumn("loss", loss)
    return rows.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))
