"""Property graphs: nodes (id, labels, ...) and edges (source, target, rel_type)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import written


def union_nodes(producers: list[DataFrame], first_wins: bool = False) -> DataFrame:
    """All producers' nodes; of one id the last producer's (or the first's) counts."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (p.withColumn("_rank", F.lit(k)) for k, p in enumerate(producers)))
    order = F.col("_rank") if first_wins else F.col("_rank").desc()
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(order))).where("_n = 1").drop("_rank", "_n")


def live_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, in_degree, out_degree``; parallel edges count."""
    ends = edges.select(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    sums = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return nodes.select("id").join(sums, "id", "left").select("id", F.coalesce("in_degree", F.lit(0)).cast("long").alias("in_degree"), F.coalesce("out_degree", F.lit(0)).cast("long").alias("out_degree"))


def neighborhood(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """``id, distance``: nodes within ``depth`` steps of the roots, whatever the direction, roots included."""
    both = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    seen = roots.select("id").distinct().withColumn("distance", F.lit(0))
    front = seen
    for d in range(1, depth + 1):
        step = front.join(both, front.id == both.source).select(F.col("target").alias("id")).distinct().join(seen, "id", "left_anti")
        front = written(step.withColumn("distance", F.lit(d)), "front")
        seen = seen.unionByName(front)
    return seen


def neighbors(edges: DataFrame, nodes: DataFrame, root: str) -> DataFrame:
    """Neighbours of a node in either direction, by title; parallel edges repeat."""
    out = edges.where(F.col("source") == root).select(F.col("target").alias("id"), "rel_type", F.lit("out").alias("direction"))
    back = edges.where(F.col("target") == root).select(F.col("source").alias("id"), "rel_type", F.lit("in").alias("direction"))
    return out.unionByName(back).join(nodes.select("id", "title"), "id").orderBy("title", "id", "rel_type", "direction")


def write_bundle(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes by id and edges by (source, rel_type, target) as JSON lines."""
    nodes.orderBy("id").write.mode("overwrite").json(f"{path}/nodes")
    edges.orderBy("source", "rel_type", "target").write.mode("overwrite").json(f"{path}/edges")
