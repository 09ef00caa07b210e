"""Connected components of links between documents, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, written

#: The stars need about log(n) squared rounds at worst; a count that no input reaches.
MAX_ROUNDS = 64


def _least_about(edges: DataFrame) -> DataFrame:
    """``w, m``: the smallest v about each u.

    ``w`` is u, put so that a join shuffles these rows anew: Spark splits a
    hub's edges only if neither side of the join is already dealt out.
    """
    return edges.groupBy("u").agg(F.min("v").alias("m")).select(F.bitwise_not(F.bitwise_not(F.col("u"))).alias("w"), "m")


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """``node, component``: for every end of a link (a, b) the smallest node that it reaches.

    Each round points nodes at the smallest node about them: the large star
    moves a node's greater neighbours, the small star its lesser ones.  The
    smallest neighbour is a partial aggregate joined back to the edges, so no
    node's neighbours meet in one task.  Each round's edges are written to the
    shared folder and deleted when the next are there; the result is a table
    of written().  Links of a node to itself and repeated links do nothing.
    ``rows`` says how many links there are at most, about.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges", rows)
    for _ in range(MAX_ROUNDS):
        # done when no node has two lesser neighbours and none that is one has one
        twice = edges.groupBy("u").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
        if twice.join(edges.select(F.col("v").alias("u"), F.lit(1).alias("below")).distinct(), "u", "left").where("lo <> hi or below is not null").isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: greater neighbours of u point at the smallest of u and all about it
        large = both.join(_least_about(both), F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.least("w", "m").alias("v")).distinct()
        low = _least_about(large)
        # small star: u and its lesser neighbours point at the smallest of them
        small = large.join(low, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("w").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        before, edges = edges, written(small, "edges", rows)
        discard(before)
    ends = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    found = written(ends.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components", rows)
    discard(edges)
    return found
