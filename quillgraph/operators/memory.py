"""Relations of memory nodes with code, documents and papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

# Kinds of memory nodes that describe code, and those that bind what they mention.
DESCRIBES = ("project_state", "decision", "gotcha")
BINDS = ("decision", "gotcha")


def relation_types(kind: Column, target_kind: Column) -> Column:
    """One or two relation types of a node kind with a target kind."""
    paper = target_kind.isin("paper", "paper_surface")
    documents = F.when((target_kind == "code_surface") & kind.isin(*DESCRIBES), "DOCUMENTS_CODE")
    constrains = F.when(kind.isin(*BINDS) & ~paper, "CONSTRAINS")
    relates = F.when(paper | (documents.isNull() & constrains.isNull()), "RELATES_TO")
    return F.array_compact(F.array(documents, constrains, relates))


def resolve(candidates: DataFrame, papers: DataFrame) -> DataFrame:
    """``node_id, target_id, target_kind, evidence`` from candidates (node_id, raw, kind) and papers (paper_id, citation_key, arxiv_id, stem).

    A path whose stem is a paper's, a citation key or an arXiv id names the
    paper; else a document, code or paper surface is made of it; a path that
    is neither document nor code names nothing.
    """
    names = papers.select("paper_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("name")) for k, c in (("path", "stem"), ("citation_key", "citation_key"), ("arxiv", "arxiv_id"))])).alias("x")).select("paper_id", "x.*").where("name is not null")
    names = names.groupBy("kind", "name").agg(F.min("paper_id").alias("paper_id"))
    stem = F.regexp_replace(F.substring_index("raw", "/", -1), r"\.[^.]+$", "")
    c = candidates.withColumn("name", F.when(F.col("kind") == "path", stem).otherwise(F.col("raw"))).join(names, ["kind", "name"], "left")
    surface = (
        F.when((F.col("kind") == "path") & text.is_doc_path("raw"), "doc_surface")
        .when((F.col("kind") == "path") & text.is_code_path("raw"), "code_surface")
        .when(F.col("kind") == "symbol", "code_surface")
        .when(F.col("kind").isin("citation_key", "arxiv"), "paper_surface")
    )
    shown = F.when(F.col("kind") == "citation_key", F.concat(F.lit("@"), F.col("raw"))).otherwise(F.col("raw"))
    part = F.when(F.col("kind") == "path", "repo").when(F.col("kind") == "symbol", "symbol").otherwise("ref")
    target = F.when(F.col("paper_id").isNotNull(), F.concat(F.lit("paper:"), "paper_id")).otherwise(F.concat_ws(":", surface, part, shown))
    kind = F.when(F.col("paper_id").isNotNull(), "paper").otherwise(surface)
    return c.select("node_id", target.alias("target_id"), kind.alias("target_kind"), shown.alias("evidence")).where("target_kind is not null")


def relations(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target, relation, target_kind, evidence``: targets of nodes (node_id, kind) by relation, with the sorted distinct evidence."""
    j = targets.join(nodes.select("node_id", F.col("kind").alias("node_kind")), "node_id")
    j = j.withColumn("relation", F.explode(relation_types(F.col("node_kind"), F.col("target_kind"))))
    return j.groupBy(F.col("node_id").alias("source"), F.col("target_id").alias("target"), "relation", "target_kind").agg(F.array_join(F.array_sort(F.collect_set("evidence")), "|").alias("evidence"))


def consolidation(history: DataFrame, backlog: DataFrame, marker: str, files: int = 8, items: int = 8) -> DataFrame:
    """``kind, name``: the newest history files (name, text) that have a marker and the first backlog rows by title."""
    newest = history.where(F.contains("text", F.lit(marker))).orderBy(F.desc("name")).limit(files).select(F.lit("history").alias("kind"), "name")
    return newest.unionByName(backlog.orderBy("title").limit(items).select(F.lit("backlog").alias("kind"), F.col("title").alias("name")))


def open_backlog(rows: DataFrame) -> DataFrame:
    """Backlog rows that aren't closed, by priority and id."""
    return rows.where(~F.coalesce("status", F.lit("")).isin("closed", "resolved", "done")).withColumn("rank", text.priority_rank(F.coalesce("priority", F.lit("")))).orderBy("rank", "id")


def backlog_edges(rows: DataFrame) -> DataFrame:
    """``source, rel_type, target``: todos with the known issues they serve, rows with what they refer to."""
    issues = rows.where("kind = 'issue'").select(F.col("id").alias("issue"))
    todo = rows.where("kind = 'todo'").select(F.concat(F.lit("backlog:todo:"), "id").alias("source"), F.explode("issue_ids").alias("issue")).join(issues, "issue", "left_semi")
    todo = todo.select("source", F.lit("ADDRESSES").alias("rel_type"), F.concat(F.lit("backlog:issue:"), "issue").alias("target"))
    refs = rows.select(F.concat_ws(":", F.lit("backlog"), "kind", "id").alias("source"), F.lit("REFERENCES").alias("rel_type"), F.explode("references").alias("r"))
    refs = refs.select("source", "rel_type", F.concat(F.lit("backlog_ref:"), text.slugify("r")).alias("target")).distinct()
    return todo.unionByName(refs)


def first_of_each(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Ordered distinct: of a key's rows the first."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")
