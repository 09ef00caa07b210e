"""Ranked search over documents and graph nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranking, text
from .episodes import line_hit_score
from .intervals import aggregated_over_spans

# Line hits of a file, folders that aren't searched, characters of a hit's line.
HITS, UNSEARCHED, LINE_CHARS = 5, (".git/", "target/", ".venv/", ".data/"), 240
# What starts a definition, and what it defines; symbols that are looked at, taken in any case, and returned.
DEFINITIONS = (("pub struct ", "struct"), ("struct ", "struct"), ("pub enum ", "enum"), ("enum ", "enum"), ("pub fn ", "function"), ("fn ", "function"), ("class ", "class"), ("def ", "function"))
LOOKED_AT, IN_ANY_CASE, RETURNED = 24, 3, 12


def search_documents(docs: DataFrame, query: str, scalars: dict[str, str], lists: dict[str, str], limit: int = 20, id_col: str = "doc_id") -> DataFrame:
    """The best ``limit`` documents: ``id, score, matched_fields, snippet, total, has_more``.

    ``scalars`` and ``lists`` map field names (keys of FIELD_WEIGHTS, in the
    order in which a snippet is looked for) to columns.  Each field, and each
    element of a list, that contains the query whatever its case adds the
    field's weight.  All is computed in the scan; only the count and the top
    rows leave it.
    """
    if limit < 1 or not query.strip():
        raise ValueError("a search needs a query and a limit of at least 1")
    q = F.lit(query.strip().lower())
    score, fields, snippets = F.lit(0), [], []
    hit = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), q)
    for name, column in scalars.items():
        one = hit(F.col(column).cast("string"))
        score = score + F.when(one, ranking.FIELD_WEIGHTS[name]).otherwise(0)
        fields.append(F.when(one, name))
        snippets.append(F.when(one, text.snippet(F.col(column).cast("string"), query)))
    for name, column in lists.items():
        found = F.filter(F.coalesce(F.col(column), F.array().cast("array<string>")), hit)
        score = score + F.size(found) * ranking.FIELD_WEIGHTS[name]
        fields.append(F.when(F.size(found) > 0, name))
        snippets.append(F.when(F.size(found) > 0, text.snippet(F.get(found, F.lit(0)), query)))
    hits = docs.select(F.col(id_col), score.cast("long").alias("score"), F.array_join(F.array_sort(F.array_compact(F.array(*fields))), ",").alias("matched_fields"), F.coalesce(*snippets).alias("snippet")).where("score > 0")
    total = hits.agg(F.count(F.lit(1)).alias("total"))
    top = hits.orderBy(F.desc("score"), id_col).limit(limit)
    return top.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > limit)


def search_nodes(nodes: DataFrame, query: str, limit: int = 24) -> DataFrame:
    """The best nodes for a query by weighted score: ``id, title, lexical, matched_field, score``.

    ``nodes`` has id, title, path, description and search_text, and may have
    authority and age_days.  Of several hits of a node the first best counts.
    """
    lexical, field = ranking.node_score(query)
    a = F.col("authority") if "authority" in nodes.columns else F.lit(1.0)
    f = ranking.freshness(F.col("age_days")) if "age_days" in nodes.columns else F.lit(1.0)
    hits = nodes.select("id", "title", lexical.alias("lexical"), field.alias("matched_field"), a.alias("a"), f.alias("f")).where("lexical > 0")
    hits = hits.withColumn("score", ranking.final_score(F.col("lexical"), F.col("a"), F.col("f")))
    best = Window.partitionBy("id").orderBy(F.desc("lexical"), "title")
    return hits.withColumn("r", F.row_number().over(best)).where("r = 1").orderBy(F.desc("score"), "title", "id").limit(max(1, limit)).select("id", "title", "lexical", "matched_field", "score")


def best_nodes_for_lines(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each (path, line) of ``hits`` the node of that path: one whose span has the line, then the shortest span, then by title.

    ``nodes`` has id, title, path, line_start and line_end (null: no span).
    Lines meet the shortest span of each of their cells, not all spans of the
    file.
    """
    best = lambda length: F.min(F.struct(length.alias("span"), "title", "id"))
    length = F.col("line_end") - F.col("line_start")
    points = hits.select("path", F.col("line").cast("long").alias("line")).distinct()
    inside = aggregated_over_spans(points, nodes.where("path is not null"), ["path"], "line", "line_start", "line_end", {"inner": best(length)}, {"inner": F.min})
    any_ = nodes.groupBy("path").agg(best(F.coalesce(length, F.lit(2**62))).alias("outer_"))
    node = F.coalesce("inner", "outer_")
    return points.join(inside, ["path", "line"], "left").join(any_, "path", "left").select("path", "line", node["id"].alias("id"), node["title"].alias("title"))


def text_hits(files: DataFrame, pattern: str, nodes: DataFrame, per_file: int = HITS, most_bytes: int | None = None) -> DataFrame:
    """``path, line, snippet, id, title, score``: the first lines of each file (path, text) that a regular expression matches, with the node each belongs to.

    Files in folders of tools aren't searched, nor are those of over
    ``most_bytes`` where that is given; a line whose path has no node is no hit.  Lines are looked for within the scan; only
    hits leave it.
    """
    f = files.withColumn("path", text.plain_path("path"))
    if most_bytes is not None:
        f = f.where(F.octet_length("text") <= most_bytes)
    for folder in UNSEARCHED:
        f = f.where(~F.startswith("path", F.lit(folder)))
    lines = F.split("text", "\n")
    f = f.select("path", lines.alias("lines"))
    at = F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: F.regexp_like(F.element_at("lines", i), F.lit(pattern)))
    hits = f.select("path", "lines", F.explode(F.slice(at, 1, per_file)).alias("line"))
    hits = hits.select("path", F.col("line").cast("long").alias("line"), text.clip_ellipsis(F.trim(F.element_at("lines", F.col("line"))), LINE_CHARS).alias("snippet"))
    best = best_nodes_for_lines(hits.select("path", "line"), nodes).where("id is not null")
    score = line_hit_score(F.col("title"), F.col("id").cast("string"), pattern).cast("long")
    return hits.join(best, ["path", "line"]).select("path", "line", "snippet", "id", "title", score.alias("score"))


def symbol_lines(files: DataFrame, terms: list[str]) -> DataFrame:
    """``name, kind, path, reason``: definitions in Rust and Python files (path, text) whose path or name has a term, and the first three in any case.

    Files go by path and lines as they stand; of the first 24 so taken, twelve
    by path and name.  Each part is a sorted limit, so no order of all
    definitions is made.
    """
    f = files.where(F.regexp_like("path", F.lit("[.](rs|py)$"))).select("path", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    start, kind, name = F.ltrim("raw"), F.lit(None).cast("string"), F.lit("")
    for prefix, what in reversed(DEFINITIONS):
        here = F.startswith(start, F.lit(prefix))
        kind = F.when(here, what).otherwise(kind)
        name = F.when(here, F.regexp_extract(F.substring(start, F.lit(len(prefix) + 1), F.length(start)), "^[A-Za-z0-9_]*", 0)).otherwise(name)
    s = f.select("path", "line", kind.alias("kind"), name.alias("name")).where("kind is not null and name <> ''")
    hay = text.ascii_lower(F.concat_ws(" ", "path", "name"))
    matched = F.lit(False)
    for t in terms:
        matched = matched | F.contains(hay, F.lit(t))
    s = s.withColumn("matched", matched)
    place = ["path", "line", "name"]
    first = s.orderBy(*place).limit(IN_ANY_CASE)
    taken = first.unionByName(s.where("matched").orderBy(*place).limit(LOOKED_AT)).distinct().orderBy(*place).limit(LOOKED_AT)
    reason = F.when(F.col("matched"), "matched task terms").otherwise("profile entrypoint")
    return taken.select("name", "kind", "path", reason.alias("reason")).orderBy("path", "name").limit(RETURNED)
