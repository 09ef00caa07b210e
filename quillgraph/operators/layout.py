"""A fixed layout of a graph: papers on a ring, sections outside, citations between their papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

RING, RING_GROWTH, SECTION_RADIUS, LANE, CITATION_OUT, JITTER = 260.0, 48.0, 150.0, 38.0, 220.0, 140.0


def _unit(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(1 << 20)) / float(1 << 20)


def _rank(df: DataFrame, order: list[str]) -> DataFrame:
    """Add ``n``, the place in a global order from 0, without bringing all rows to one task: ranges are numbered and offset by the counts before them."""
    ranged = df.repartitionByRange(64, *order).withColumn("_p", F.spark_partition_id())
    ranged = written(ranged, "layout")
    counts = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.withColumn("_b", F.sum("_c").over(Window.partitionBy(F.lit(0)).orderBy("_p")) - F.col("_c")).drop("_c")
    inner = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return ranged.withColumn("_i", inner).join(F.broadcast(before), "_p").withColumn("n", F.col("_i") + F.col("_b")).drop("_p", "_i", "_b")


def semantic_layout(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, x, y`` for nodes (id, kind, title): papers by title around a ring, their sections outwards by title, citations beyond the middle of their papers, the rest in a grid of eight columns.

    Jitter comes from a hash of the id.
    """
    papers = _rank(nodes.where("kind = 'Paper'").select("id", "title"), ["title", "id"])
    total = nodes.where("kind = 'Paper'").agg(F.count(F.lit(1)).alias("total"))
    ring = F.when(F.col("total") <= 1, 0.0).otherwise(RING + RING_GROWTH * F.sqrt("total"))
    angle = F.when(F.col("total") <= 1, 0.0).otherwise(2 * 3.141592653589793 * F.col("n") / F.col("total"))
    p = papers.crossJoin(F.broadcast(total)).withColumn("ring", ring).withColumn("angle", angle)
    p = p.select("id", "ring", (F.cos("angle") * F.col("ring")).alias("x"), (F.sin("angle") * F.col("ring")).alias("y"), F.when(F.col("total") <= 1, 1.0).otherwise(F.cos("angle")).alias("ox"), F.when(F.col("total") <= 1, 0.0).otherwise(F.sin("angle")).alias("oy"))
    s = edges.where("rel_type = 'HAS_SECTION'").select("source", F.col("target").alias("sid")).join(nodes.select(F.col("id").alias("sid"), "title"), "sid").join(p.withColumnRenamed("id", "source"), "source")
    own = Window.partitionBy("source")
    s = s.withColumn("k", F.row_number().over(own.orderBy("title", "sid")) - 1).withColumn("m", F.count(F.lit(1)).over(own))
    radial, lateral = SECTION_RADIUS + F.floor(F.col("k") / 6) * 18.0, (F.col("k") - (F.col("m") - 1) * 0.5) * LANE
    sections = s.select(F.col("sid").alias("id"), (F.col("x") + F.col("ox") * radial - F.col("oy") * lateral).alias("x"), (F.col("y") + F.col("oy") * radial + F.col("ox") * lateral).alias("y"))
    c = nodes.where("kind = 'Citation'").select(F.col("id").alias("cid"))
    by = edges.where("rel_type = 'CITES'").select("source", F.col("target").alias("cid")).join(p.select(F.col("id").alias("source"), "x", "y"), "source").groupBy("cid").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    c = c.join(by, "cid", "left").crossJoin(F.broadcast(p.agg(F.coalesce(F.max("ring"), F.lit(0.0)).alias("ring"))))
    far = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    ox, oy = F.when(far > 0, F.col("x") / far).otherwise(1.0), F.when(far > 0, F.col("y") / far).otherwise(0.0)
    shift, turn = (_unit(F.col("cid")) - 0.5) * JITTER, _unit(F.col("cid")) * 2 * 3.141592653589793
    cites = c.select(F.col("cid").alias("id"), F.coalesce(F.col("x") + ox * CITATION_OUT - oy * shift, F.cos(turn) * (F.col("ring") + 220.0)).alias("x"), F.coalesce(F.col("y") + oy * CITATION_OUT + ox * shift, F.sin(turn) * (F.col("ring") + 220.0)).alias("y"))
    placed = p.select("id", "x", "y").unionByName(sections.dropDuplicates(["id"])).unionByName(cites)
    rest = _rank(nodes.join(placed.select("id"), "id", "left_anti").select("id", "title"), ["title", "id"]).crossJoin(F.broadcast(p.agg(F.coalesce(F.max("ring"), F.lit(0.0)).alias("ring"))))
    rest = rest.select("id", (F.col("n") % 8 * 90.0 - 280.0).alias("x"), (F.col("ring") + 260.0 + F.floor(F.col("n") / 8) * 70.0).alias("y"))
    return placed.unionByName(rest)


def radius(kind_radius: Column, degree: Column) -> Column:
    return kind_radius + 0.3 * F.least(F.lit(10), degree)


def nearest(positions: DataFrame, x: float, y: float) -> DataFrame:
    """The node nearest to a point."""
    d = (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)
    return positions.withColumn("distance", F.sqrt(d)).orderBy("distance", "id").limit(1)
