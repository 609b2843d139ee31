"""Connected components of any graph in a number of rounds that grows like the logarithm of its nodes."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coterie.sources.scratch import few, materialise


def union_groups(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component of every node that has an edge (a, b) to another.

    Every node points to its first neighbour in a random order (drawn anew each round) or to itself, one
    step of the path is skipped, and edges move to where their ends point: a constant share of the
    nodes goes in each round, whatever the ids.  The minimum per node is combined on the map side, and each
    round joins stored tables plainly, so a hub is a skewed join key that adaptive execution can split.
    """
    edges = materialise(edges.select("a", "b").filter("a <> b").distinct(), "links")
    forest: DataFrame | None = None
    turn = nodes = 0
    while left := edges.count():
        turn += 1
        nodes = nodes or 2 * left

        def rank(x: str, turn: int = turn):
            return F.struct(F.xxhash64(x, F.lit(turn)).alias("h"), F.col(x).alias("node"))

        low = F.least(rank("a"), rank("b"))
        ends = edges.select(F.explode(F.array(*[F.struct(F.col(x).alias("node"), low.alias("to")) for x in ("a", "b")])).alias("e"))
        parent = materialise(few(ends.groupBy("e.node").agg(F.min("e.to").alias("m")).select("node", F.col("m.node").alias("to")), 2 * left), "parents")
        above = parent.select(F.col("node").alias("to"), F.col("to").alias("top"))  # every node pointed to is in the table
        parent = materialise(few(parent.join(above, "to").select("node", F.col("top").alias("to")), 2 * left), "parents")
        for end in ("a", "b"):
            edges = edges.join(parent.select(F.col("node").alias(end), F.col("to").alias(f"r{end}")), end)
        edges = materialise(few(edges.select(F.col("ra").alias("a"), F.col("rb").alias("b")).filter("a <> b").distinct(), left), "links")
        if forest is None:
            forest = parent
        else:
            moved = parent.select(F.col("node").alias("to"), F.col("to").alias("top"))
            forest = materialise(few(forest.join(moved, "to", "left").select("node", F.coalesce("top", "to").alias("to")), nodes), "forest")
    if forest is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    smallest = materialise(few(forest.groupBy("to").agg(F.min("node").alias("root")), nodes), "roots")
    return forest.join(smallest, "to").select("node", "root")
