"""Connected components of a graph given as pairs of long identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylens.llm.tables import stored


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge to another; equal roots mean one component.

    ``edges`` has the columns a and b. In each round every node points to the smallest of
    itself and its neighbours in a hashed order, pointers are followed twice, and the
    edges are redrawn between what the nodes point to. As the order is random, a constant
    share of the nodes goes in each round, whatever the shape of the graph, and the work
    per round is that of its edges. A node with very many neighbours is combined before
    the shuffle; the joins are between stored tables, so a hot key can be split.
    """
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    left = stored(edges.where("a <> b").select("a", "b").distinct(), "edges")
    roots: DataFrame | None = None
    while not left.isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        points = both.groupBy("a").agg(F.min(order("b")).alias("m"))
        to = stored(points.select(F.col("a").alias("x"), F.least("m", order("a"))["v"].alias("y")), "points")
        onward = to.select(F.col("x").alias("y"), F.col("y").alias("z"))
        to = stored(to.join(onward, "y").select("x", F.col("z").alias("y")), "points")
        here = lambda c: to.select(F.col("x").alias(c), F.col("y").alias(f"{c}_to"))  # noqa: E731, B023
        if roots is None:
            roots = to.select(F.col("x").alias("node"), F.col("y").alias("root"))
        else:
            moved = roots.join(here("root"), "root", "left")
            roots = stored(moved.select("node", F.coalesce("root_to", "root").alias("root")), "roots")
        # a pointer that skipped a node stays an edge, as that node may have moved on
        skipped = onward.select(F.col("y").alias("a"), F.col("z").alias("b"))
        redrawn = left.union(skipped).join(here("a"), "a").join(here("b"), "b")
        left = stored(
            redrawn.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
            .where("a <> b")
            .distinct(),
            "edges",
        )
    if roots is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
