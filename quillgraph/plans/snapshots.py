"""Queries that keep a table up to date behind commits and read the last one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import shared_dir
from ..sources.snapshots import SnapshotTable
from ..streaming import pipelines
from .hosts import table
from .registry import register


def _new_table(spark: SparkSession, name: str) -> SnapshotTable:
    return SnapshotTable(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")


@register(
    "rebuilt_sources",
    r"""WITH d AS (SELECT source, doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM documents)
SELECT source, count(*) AS documents, CAST(sum(words) AS BIGINT) AS words, CASE WHEN source = (SELECT min(source) FROM documents WHERE doc_id % 2 = 1) THEN 2 ELSE 1 END AS version FROM d GROUP BY source""",
)
def rebuilt_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by source, built over all documents but half of one source's, then brought up to date: that source alone is counted anew."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    late = docs.where("doc_id % 2 = 1").agg(F.min("source")).first()[0]
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    counts = _new_table(spark, "source-counts")
    for part in (docs.where(~((F.col("source") == F.lit(late)) & (F.col("doc_id") % 2 == 1)) | F.col("source").isNull()), docs):
        counts.rebuild(part, "source", lambda df: df.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(words).cast("long").alias("words")))
    versions = spark.createDataFrame([(p.part, p.version) for p in counts.parts()], "part string, version int")
    part = F.coalesce(F.concat(F.lit("v"), "source"), F.lit("null"))
    return counts.read().withColumn("part", part).join(versions, "part").drop("part")


@register(
    "updated_orders",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 1000 = 0 THEN 2 * o_totalprice ELSE o_totalprice END AS price FROM orders
UNION ALL SELECT -1 - o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 1000 = 0""",
)
def updated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders in 256 buckets, and a batch of changed and new ones that writes its own buckets alone."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.lit(0).alias("pos"))
    some = orders.where("o_orderkey % 1000 = 0").drop("pos")
    batch = some.withColumn("price", 2 * F.col("price")).unionByName(some.withColumn("o_orderkey", -1 - F.col("o_orderkey"))).withColumn("pos", F.lit(1))
    t = _new_table(spark, "orders")
    for rows in (orders, batch):
        t.update(rows, ["o_orderkey"], lambda current, new: pipelines.upsert(current, new, "o_orderkey", "pos"), buckets=256)
    return t.read().drop("pos")
