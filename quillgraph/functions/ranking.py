"""Ranking: source types, authority, freshness and final scores."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, plain_path

# Folders and files by the type of source they hold, first match counts.
SOURCE_TYPES = (
    ("canonical_memory", "within", (".agents/memory/state/",)),
    ("active_backlog", "ends", (".agents/issues.toml", ".agents/todos.toml", ".agents/refactors.toml", ".agents/resolved.toml")),
    ("episodic_memory", "within", (".agents/memory/history/", ".agents/work/", ".agents/archive/")),
    ("generated_context", "within", ("docs/_generated/context/",)),
    ("agent_skill", "within", (".agents/skills/",)),
    ("agent_guidance", "ends", ("AGENTS.md",)),
    ("code", "within", ("src/",)),
    ("docs", "within", ("docs/",)),
)


def source_type(path: Column | str, code_root: str = "src/") -> Column:
    """Type of a source by its path; ``code_root`` is the folder of the project's own code."""
    p, out = plain_path(path), F.lit("default")
    for name, how, parts in reversed(SOURCE_TYPES):
        parts = (code_root,) if name == "code" else parts
        for part in parts:
            hit = F.endswith(p, F.lit(part)) if how == "ends" else F.startswith(p, F.lit(part)) | F.contains(p, F.lit("/" + part))
            out = F.when(hit, name).otherwise(out)
    return out


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression for the whole path or any ending of it that starts after a slash."""
    inner = fnmatch.translate(pattern)
    inner = re.sub(r"^\(\?s:(.*)\)\\[zZ]$", r"\1", inner)
    return f"(?s)^(.*/)?{inner}$"


def authority(path: Column | str, tiers: dict[str, float]) -> Column:
    """The largest factor of the globs that fit a path; 1 if none does."""
    p, out = plain_path(path), F.lit(None).cast("double")
    for pattern, factor in sorted(tiers.items()):
        out = F.greatest(out, F.when(F.regexp_like(p, F.lit(glob_regex(pattern))), float(factor)))
    return F.coalesce(out, F.lit(1.0))


def authority_label(factor: Column) -> Column:
    return F.when(factor >= 1.5, "canonical").when(factor >= 1.2, "active").when(factor < 1.0, "historical").otherwise("default")


def freshness(age_days: Column) -> Column:
    """Halves every 30 days, from 1 to 0.1; 1 where the age isn't known."""
    return F.coalesce(F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.pow(F.lit(0.5), age_days / 30.0))), F.lit(1.0))


def final_score(lexical: Column, authority_: Column, freshness_: Column) -> Column:
    """Product in single precision, by which hits are ordered."""
    return lexical.cast("float") * authority_.cast("float") * freshness_.cast("float")


# What a matching field adds to a document's score.
FIELD_WEIGHTS = {
    "title": 120, "paper_id": 110, "citation_key": 100, "arxiv_id": 100, "doi": 90, "parsed_title": 80, "authors": 70, "abstract": 50,
    "section_title": 40, "citations": 30, "section_content": 20, "figure_caption": 20, "table_caption": 20,
}

# What a matching property adds to a node's score, for the whole query and for each of its terms.
NODE_WEIGHTS = {"title": (240, 60), "id": (180, 35), "path": (140, 30), "description": (120, 25), "search_text": (80, 10)}


def node_score(query: str) -> tuple[Column, Column]:
    """Score and matched field of a node by its columns title, id, path, description and search_text.

    A title equal to the query counts 1000.  The matched field is the last of
    title, id, path and description that has the query.
    """
    q = query.strip().lower()
    if not q:
        return F.lit(1).cast("long"), F.lit("default")
    terms = [t for t in re.split(r"[\s|]+", q) if t]
    score, field = F.lit(0), F.lit("search_text")
    for name, (whole, each) in NODE_WEIGHTS.items():
        text = F.lower(F.coalesce(F.col(name), F.lit("")))
        hit = F.contains(text, F.lit(q))
        worth = F.when(text == q, 1000).when(hit, whole).otherwise(0) if name == "title" else F.when(hit, whole).otherwise(0)
        score = score + worth
        if name != "search_text":
            field = F.when(hit, name).otherwise(field)
        for t in terms:
            score = score + F.when(F.contains(text, F.lit(t)), each).otherwise(0)
    return score.cast("long"), field


# Node labels by modality, first match counts.
MODALITIES = (
    ("code", ("CodeFile", "CodeModule", "CodeSymbol", "CodeReference")),
    ("generated_context", ("GeneratedContext", "DataContract", "Concept")),
    ("memory", ("ProjectMemory",)),
    ("backlog", ("AgentBacklogIssue", "AgentBacklogTodo", "BacklogReference")),
    ("literature", ("Paper", "PaperSection", "Citation", "Author", "FieldOfStudy", "ExternalIdentifier", "PaperSurface")),
    ("external_docs", ("ExternalDoc", "ExternalDocLeaf", "Context7Leaf", "McpResource", "McpTool")),
)


def modality(labels: Column | str, properties: Column | str) -> Column:
    """Modality of a node by labels (array) and properties (map); docs by default."""
    labels, out = col(labels), F.lit("docs")
    has = lambda names: F.arrays_overlap(labels, F.array(*map(F.lit, names)))
    for name, names in reversed(MODALITIES[1:]):
        out = F.when(has(names), name).otherwise(out)
    surface = has(("RepoSurface",)) & (F.coalesce(col(properties)["surface_kind"], F.lit("")) == "code_surface")
    return F.when(has(MODALITIES[0][1]) | surface, "code").otherwise(out)
