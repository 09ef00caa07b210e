"""The relational view of parsed papers: papers, sections, citations, edges, notebooks, cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

# Properties that a node is searched by, and how many characters of the long ones.
SEARCHED = (
    "title", "name", "label", "paper_id", "citation_key", "qualified_name", "signature", "doc_summary", "summary", "definition_short", "definition_long",
    "source_path", "repo_path", "file", "module", "text", "content", "aliases", "kg_tags",
)
SEARCHED_CHARS = 1200
# Labels of a document's and of its sections' nodes by kind.
DOCUMENT_LABELS = {"literature": ("Paper", "PaperSection"), "documentation": ("Document", "DocSection"), "transcript": ("Transcript", "TranscriptSection"), "research_note": ("ResearchNote", "ResearchNoteSection")}


def document_label(kind: Column | str, section: bool = False) -> Column:
    """Label of the node of a document of some kind, or of its sections'."""
    kind, out = text.col(kind), F.lit(None).cast("string")
    for name, labels in DOCUMENT_LABELS.items():
        out = F.when(kind == name, labels[section]).otherwise(out)
    return out


def bundle(papers: DataFrame, notebooks: DataFrame, inferred: DataFrame | None = None) -> dict[str, DataFrame]:
    """Six tables from papers (paper_id, title, abstract, sections, figures, tables, citations) and notebooks (notebook_id, paper_id, cells).

    ``inferred`` links (source, target, rel_type) join the edges; of equal
    edge ids the first counts, mentions before inferred ones.
    """
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    p = papers.select("paper_id", "title", "abstract", *[count(c).alias(f"{c[:-1]}_count") for c in ("sections", "figures", "tables", "citations")])
    s = papers.select("paper_id", F.posexplode("sections").alias("section_index", "s")).select(F.concat(F.col("paper_id"), F.lit(":section:"), F.col("section_index").cast("string")).alias("section_id"), "paper_id", "section_index", "s.level", "s.title", "s.content")
    c = papers.select("paper_id", F.posexplode("citations").alias("i", "citation"))
    c = c.select(F.concat(F.col("paper_id"), F.lit(":citation:"), F.col("i").cast("string")).alias("citation_row_id"), "paper_id", text.citation_id("citation", F.col("i")).alias("citation_id"), "citation")
    cells = notebooks.select("notebook_id", F.explode("cells").alias("c")).select(F.concat(F.col("notebook_id"), F.lit(":cell:"), F.col("c.index").cast("string")).alias("cell_id"), "notebook_id", "c.index", "c.kind", "c.source")
    edges = c.select(F.col("paper_id").alias("source"), F.lit("MENTIONS").alias("rel_type"), F.col("citation_row_id").alias("target"), F.lit(0).alias("rank"))
    if inferred is not None:
        edges = edges.unionByName(inferred.select("source", "rel_type", "target", F.lit(1).alias("rank")))
    edges = edges.withColumn("edge_id", F.concat_ws(":", "source", "rel_type", "target"))
    first = F.row_number().over(Window.partitionBy("edge_id").orderBy("rank"))
    edges = edges.withColumn("r", first).where("r = 1").select("edge_id", "source", "rel_type", "target")
    return {"papers": p, "sections": s, "citations": c, "edges": edges, "notebooks": notebooks.drop("cells"), "cells": cells}


def graph_of(papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of papers, their sections and citations; properties as JSON, nulls written out."""
    js = lambda *cols: F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    pid = F.concat(F.lit("paper:"), "paper_id")
    paper = papers.select(pid.alias("id"), F.array(F.lit("Paper")).alias("labels"), js("paper_id", "title", "abstract").alias("properties"))
    s = papers.select("paper_id", F.posexplode("sections").alias("i", "s"))
    sid = F.concat(F.lit("paper:"), "paper_id", F.lit(":section:"), F.col("i").cast("string"))
    section = s.select(sid.alias("id"), F.array(F.lit("PaperSection")).alias("labels"), js(F.col("paper_id"), F.col("s.level").alias("level"), F.col("s.title").alias("title"), F.col("s.content").alias("content")).alias("properties"))
    c = papers.select("paper_id", F.explode("citations").alias("citation_key"))
    cite = c.select(F.concat(F.lit("citation:"), "citation_key").alias("id"), F.array(F.lit("Citation")).alias("labels"), js("citation_key").alias("properties")).distinct()
    edges = s.select(pid.alias("source"), F.lit("HAS_SECTION").alias("rel_type"), sid.alias("target")).unionByName(c.select(pid.alias("source"), F.lit("CITES").alias("rel_type"), F.concat(F.lit("citation:"), "citation_key").alias("target")))
    return paper.unionByName(section).unionByName(cite), edges


def _json(*columns: Column | str) -> Column:
    """Properties as JSON, nulls written out."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("properties")


def _named(*parts: Column | str) -> Column:
    return F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def code_graph(code: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the tables of read_code(): files, modules and symbols; containment, resolved imports and calls."""
    labels = lambda name: F.array(F.lit(name)).alias("labels")
    s, source = code["symbols"], F.lit("python_ast").alias("source")
    files = code["files"].select(_named("code_file", F.col("path")).alias("id"), labels("CodeFile"), _json(F.col("path").alias("repo_path"), F.col("lines").alias("line_count"), source))
    modules = s.select("module", "path").distinct()
    modules = modules.select(_named("code_module", F.col("module")).alias("id"), labels("CodeModule"), _json(F.col("module").alias("name"), F.col("path").alias("repo_path"), source))
    own = ("qualified_name", "name", F.col("kind").alias("symbol_kind"), "module", F.col("path").alias("repo_path"), "line_start", "line_end", "signature", "doc_summary", source)
    symbols = s.select(_named("code_symbol", F.col("qualified_name")).alias("id"), labels("CodeSymbol"), _json(*own))
    symbol = lambda c: F.when(F.col(c).isNotNull(), _named("code_symbol", F.col(c)))
    parent = F.when(F.col("parent") == F.col("module"), _named("code_module", F.col("module"))).otherwise(symbol("parent"))
    held = s.select(parent.alias("source"), F.lit("CONTAINS").alias("rel_type"), symbol("qualified_name").alias("target"))
    files_hold = s.select("module", "path").distinct().select(_named("code_file", F.col("path")).alias("source"), F.lit("CONTAINS").alias("rel_type"), _named("code_module", F.col("module")).alias("target"))
    used = code["imports"].select(_named("code_module", F.col("module")).alias("source"), F.lit("IMPORTS").alias("rel_type"), F.coalesce(symbol("resolved"), _named("code_reference", F.col("target"))).alias("target"))
    called = code["calls"].where("resolved is not null").select(F.when(F.col("caller") == F.col("module"), _named("code_module", F.col("module"))).otherwise(symbol("caller")).alias("source"), F.lit("CALLS").alias("rel_type"), symbol("resolved").alias("target"))
    outside = used.where(F.startswith("target", F.lit("code_reference:"))).select(F.col("target").alias("id")).distinct().select("id", labels("CodeReference"), _json(F.substring_index("id", ":", -1).alias("name")))
    return files.unionByName(modules).unionByName(symbols).unionByName(outside), held.unionByName(files_hold).unionByName(used).unionByName(called).distinct()


def memory_graph(nodes: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of memory nodes (node_id, kind, title, text) and their relations (source, target, relation, target_kind, evidence); a target that is no paper is a surface."""
    own = nodes.select(F.col("node_id").alias("id"), F.array(F.lit("ProjectMemory")).alias("labels"), _json("kind", "title", "text"))
    label = F.when(F.col("target_kind") == "paper_surface", "PaperSurface").when(F.col("target_kind") == "doc_surface", "DocSurface").otherwise("RepoSurface")
    surfaces = relations.where("target_kind <> 'paper'").select(F.col("target").alias("id"), "target_kind").distinct()
    surfaces = surfaces.select("id", F.array(label).alias("labels"), _json(F.col("target_kind").alias("surface_kind"), F.substring_index("id", ":", -1).alias("name")))
    edges = relations.select("source", F.col("relation").alias("rel_type"), "target")
    return own.unionByName(surfaces), edges


def backlog_graph(rows: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of backlog rows (kind, id, title, status, priority, summary) and of what they refer to, and the edges of backlog_edges()."""
    label = F.when(F.col("kind") == "issue", "AgentBacklogIssue").otherwise("AgentBacklogTodo")
    own = rows.select(_named("backlog", F.col("kind"), F.col("id")).alias("id"), F.array(label).alias("labels"), _json("title", "status", "priority", "summary"))
    refs = edges.where("rel_type = 'REFERENCES'").select(F.col("target").alias("id")).distinct()
    refs = refs.select("id", F.array(F.lit("BacklogReference")).alias("labels"), _json(F.substring_index("id", ":", -1).alias("name")))
    return own.unionByName(refs), edges


def node_view(nodes: DataFrame) -> DataFrame:
    """Search rows of nodes (id, labels, properties JSON): ``id, kind, title, subtitle, description, path, search_text``."""
    n = nodes.withColumn("p", text.string_map("properties")).withColumn("kind", F.coalesce(F.get("labels", F.lit(0)), F.lit("")))
    g = lambda k: F.col("p")[k]
    first = lambda *keys: F.coalesce(*map(g, keys))
    by_kind = (
        F.when(F.col("kind").isin("Paper", "PaperSection"), g("title"))
        .when(F.col("kind") == "Citation", g("citation_key"))
        .when(F.col("kind") == "CodeSymbol", first("qualified_name", "name"))
        .when(F.col("kind").isin("CodeFile", "CodeModule"), first("repo_path", "name"))
        .when(F.col("kind").isin("DataContract", "Concept", "GeneratedContext"), first("title", "label", "name"))
        .otherwise(first("title", "name"))
    )
    filled = lambda c: F.nullif(c, F.lit(""))
    two = lambda a, b: F.concat_ws(" · ", filled(a), filled(b))
    subtitle = (
        F.when(F.col("kind") == "Paper", two(g("year"), F.concat(F.lit("arXiv:"), filled(g("arxiv_id")))))
        .when(F.col("kind") == "PaperSection", two(F.concat(F.lit("Level "), filled(g("level"))), g("paper_id")))
        .when(F.col("kind") == "Citation", g("citation_key"))
        .when(F.col("kind") == "CodeSymbol", two(g("symbol_kind"), g("repo_path")))
        .when(F.col("kind").isin("GeneratedContext", "DataContract", "Concept"), g("source_path"))
    )
    description = text.clip_ellipsis(F.trim(F.coalesce(*[text.blank_to_null(g(k)) for k in ("doc_summary", "summary", "definition_short", "definition_long", "text", "abstract", "content")], F.lit(""))), 700)
    path = F.trim(F.coalesce(*[text.blank_to_null(g(k)) for k in ("repo_path", "source_path", "file", "path")]))
    rest = F.concat_ws(" ", *[text.clip_ellipsis(g(k), SEARCHED_CHARS) if k in ("content", "text") else g(k) for k in SEARCHED])
    title = F.coalesce(filled(by_kind), F.col("id"))
    search = F.lower(F.concat_ws(" ", "id", "kind", F.array_join("labels", " "), description, F.nullif(rest, F.lit(""))))
    return n.select("id", "labels", F.col("p").alias("properties"), "kind", title.alias("title"), F.coalesce(subtitle, F.lit("")).alias("subtitle"), description.alias("description"), path.alias("path"), search.alias("search_text"))
