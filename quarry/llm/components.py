"""Connected components of an undirected graph by randomised contraction.

Every round each node joins the neighbour with the least hash (or stays), the edges
are rewritten to the joined nodes and loops and repeats are dropped. With a new hash
each round the edges shrink by a constant factor on average, chains included.
Neighbours are only ever aggregated, never collected, so a node may have any number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b, both long and not null).

    `component` is the same for two nodes exactly if a path joins them; it is one of
    the nodes. Loops are allowed and make a node its own component.
    """
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    names = stored(nodes.select("node", F.col("node").alias("component")), "component-names")
    left = stored(edges.filter("a <> b").select("a", "b").distinct(), "component-edges")
    turn = 0
    while not left.isEmpty():
        turn += 1
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))

        def order(c: str, turn: int = turn):
            return F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("hash"), F.col(c).alias("node"))

        joins = both.groupBy("a").agg(F.least(F.min(order("b")), F.min(order("a")))["node"].alias("to"))
        joins = stored(joins.select(F.col("a").alias("from"), "to"), "component-joins")
        names = stored(
            names.join(joins, names["component"] == joins["from"], "left").select(
                "node", F.coalesce("to", "component").alias("component")
            ),
            "component-names",
        )
        ends = left.join(joins, left["a"] == joins["from"]).select(F.col("to").alias("a"), "b")
        ends = ends.join(joins, ends["b"] == joins["from"]).select("a", F.col("to").alias("b"))
        smaller, larger = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
        left = stored(ends.filter("a <> b").select(smaller, larger).distinct(), "component-edges")
    return names
