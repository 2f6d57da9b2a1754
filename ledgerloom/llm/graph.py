"""Connected components by hooks and shortcuts on labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import MOST_BROADCAST, release, small, stored


def components(edges: DataFrame) -> DataFrame:
    """node, component for every node of an edge list (a, b): the smallest node it reaches.

    Labels fall from round to round: a node, and the node that is its label, take
    the label's label of each neighbour if that is smaller, and so the chains of
    labels get shorter too. Labels that no round changes are equal along all edges.
    A round is one aggregation; labels are broadcast to the edges if they are few,
    else joined in a shuffle.

    Each round's labels are written to the shared folder, so a lost executor costs
    one round. Loops and repeated edges do no harm; no edges give no rows.
    """
    edges = stored(edges.where("a <> b").select("a", "b"), "edges")
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("to")), F.struct(F.col("b").alias("node"), F.col("a").alias("to"))))
    first = edges.select(ends.alias("e")).groupBy("e.node").agg(F.min("e.to").alias("to")).select("node", F.least("node", "to").alias("component"))
    now, mark = stored(first, "labels"), None
    while True:
        new = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("node", "component"))).first())
        if new == mark:
            release(edges)
            return now
        last, now, mark = now, stored(_lowered(edges, now, new[0] * 64 <= MOST_BROADCAST // 4), "labels"), new
        release(last)


def _lowered(edges: DataFrame, labels: DataFrame, few: bool) -> DataFrame:
    held = F.broadcast if few else lambda table: table
    over = held(labels.select(F.col("node").alias("component"), F.col("component").alias("top")))
    tops = labels.join(over, "component").select("node", "component", "top")
    a, b = (held(tops.select(F.col("node").alias(x), F.col("component").alias(f"{x}_is"), F.col("top").alias(f"{x}_top"))) for x in ("a", "b"))
    hooks = F.array(*(F.struct(F.col(node).alias("node"), F.col(to).alias("component")) for node, to in (("a", "b_top"), ("a_is", "b_top"), ("b", "a_top"), ("b_is", "a_top"))))
    hooked = edges.join(a, "a").join(b, "b").where("a_is <> b_is or a_top <> b_top").select(F.explode(hooks).alias("h")).select("h.*")
    return hooked.unionByName(tops.select("node", F.col("top").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))


def joined_up(found: DataFrame, edges: DataFrame) -> DataFrame:
    """A stored table: the components of a graph, known as `components` gives them, that has got more edges (a, b).

    Only components that the new edges touch are searched.
    """
    a, b = (found.select(F.col("node").alias(x), F.col("component").alias(f"{x}_is")) for x in ("a", "b"))
    ends = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("a_is", "a").alias("a"), F.coalesce("b_is", "b").alias("b"))
    more = small(components(ends))
    moved = found.join(more.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    new = more.join(found.select("node"), "node", "left_anti")
    out = stored(moved.select("node", F.coalesce("to", "component").alias("component")).unionByName(new), "found")
    release(more)
    return out
