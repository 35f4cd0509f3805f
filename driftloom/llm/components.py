"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.llm.shared import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows ``(node, component)`` for each node with a link; component is the smallest node reachable.

    In each round every node merges into the neighbour of the lowest priority (or stays, if none is lower than its own),
    and the links are drawn anew between the merged nodes. Priorities are hashes that change every second round, so
    that about half of the nodes go in each round whatever the order of the ids: a chain of n links takes about log2(n)
    rounds. A component's node of the lowest priority always takes in a neighbour, so the links run out; there
    is no limit of rounds. All steps are aggregates with map-side partial sums and joins that adaptive execution can split
    at hot keys. Each round is written to the shared folder. Null ends and loops are ignored, repeated links count once; an
    empty table gives an empty result.
    """
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v").distinct()
    links = stored(links, "links")
    merged: list[DataFrame] = []
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min(_priority("v", len(merged) // 2)).alias("low"))
        into = F.when(F.col("low") < _priority("u", len(merged) // 2), F.col("low.node")).otherwise(F.col("u"))
        to = stored(low.select(F.col("u").alias("node"), into.alias("m")), "merge")
        merged.append(to)
        left = links.join(to, links.u == to.node).select(F.col("m").alias("mu"), "v")
        right = to.select(F.col("node").alias("n2"), F.col("m").alias("mv"))
        links = left.join(right, left.v == right.n2).where("mu != mv")
        links = links.select(F.least("mu", "mv").alias("u"), F.greatest("mu", "mv").alias("v")).distinct()
        links = stored(links, "links")
    if not merged:
        return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    # From the last round back, as each round has about half the nodes of the one before it.
    out = merged[-1].withColumnRenamed("m", "root")
    for step in reversed(merged[:-1]):
        out = out.select(F.col("node").alias("was"), "root")
        out = step.join(out, step.m == out.was, "left").select("node", F.coalesce("root", "m").alias("root"))
    out = stored(out, "roots")
    least = out.groupBy("root").agg(F.min("node").alias("component"))
    return out.join(least, "root").select("node", "component")


def _priority(node: str, seed: int) -> Column:
    return F.struct(F.xxhash64(node, F.lit(seed)).alias("hash"), F.col(node).alias("node"))
