"""The engine's concepts on the tables of a star schema with documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as papers: title is the first line, abstract the first 400 characters, sections are the lines."""
    d = table(spark, sf_dir, "documents")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    return d.select("doc_id", "source", "lang", "text", lines[0].alias("title"), F.left(F.coalesce("text", F.lit("")), F.lit(400)).alias("abstract"), lines.alias("lines"))


def graph_nodes(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Producers of nodes: regions, nations, customers, suppliers, parts and orders."""
    t = lambda n: table(spark, sf_dir, n)
    node = lambda df, kind, key, title: df.select(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("label"), F.col(title).cast("string").alias("title"))
    return [node(t("region"), "region", "r_regionkey", "r_name"), node(t("nation"), "nation", "n_nationkey", "n_name"), node(t("customer"), "customer", "c_custkey", "c_name"), node(t("supplier"), "supplier", "s_suppkey", "s_name"), node(t("part"), "part", "p_partkey", "p_name"), node(t("orders"), "order", "o_orderkey", "o_orderpriority")]


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    edge = lambda df, a, ac, rel, b, bc: df.select(name(a, ac).alias("source"), F.lit(rel).alias("rel_type"), name(b, bc).alias("target"))
    parts = [edge(t("nation"), "nation", "n_nationkey", "IN_REGION", "region", "n_regionkey"), edge(t("customer"), "customer", "c_custkey", "IN_NATION", "nation", "c_nationkey"), edge(t("supplier"), "supplier", "s_suppkey", "IN_NATION", "nation", "s_nationkey"), edge(t("orders"), "order", "o_orderkey", "PLACED_BY", "customer", "o_custkey"), edge(t("lineitem"), "order", "l_orderkey", "HAS_PART", "part", "l_partkey"), edge(t("lineitem"), "part", "l_partkey", "FROM", "supplier", "l_suppkey")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


NODES_SQL = """(SELECT 'region:' || r_regionkey AS id, 'region' AS label, r_name AS title FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name FROM nation UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name FROM supplier UNION ALL SELECT 'part:' || p_partkey, 'part', p_name FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 'order', o_orderpriority FROM orders)"""
EDGES_SQL = """(SELECT 'nation:' || n_nationkey AS source, 'IN_REGION' AS rel_type, 'region:' || n_regionkey AS target FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'IN_NATION', 'nation:' || c_nationkey FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'IN_NATION', 'nation:' || s_nationkey FROM supplier
  UNION ALL SELECT 'order:' || o_orderkey, 'PLACED_BY', 'customer:' || o_custkey FROM orders UNION ALL SELECT 'order:' || l_orderkey, 'HAS_PART', 'part:' || l_partkey FROM lineitem
  UNION ALL SELECT 'part:' || l_partkey, 'FROM', 'supplier:' || l_suppkey FROM lineitem)"""
LINES_SQL = "(SELECT doc_id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))"
ASCII_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
