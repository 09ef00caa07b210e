"""Texts made for other systems: episode bodies, embedding texts; and repair of what models answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

EPISODE_CHARS, CODE_CHARS, CONTENT_CHARS, EXTRA_CHARS = 6000, 800, 2000, 1000
CUT_NOTE = "\n\n[Truncated]"
# Properties that have a line of their own, or none, in a graph node's text.
OWN_LINES = ("name", "summary", "source_description", "content", "name_embedding", "kg_embedding", "created_at", "valid_at")
# Names under which models put the same field, first one counts.
EDGE_ALIASES = {
    "source_entity_name": ("source_entity_name", "subject", "source", "from"),
    "target_entity_name": ("target_entity_name", "object", "target", "to"),
    "relation_type": ("relation_type", "predicate", "relation", "edge_type"),
    "fact": ("fact", "description", "summary"),
}
ENTITY_ALIASES = {"name": ("name", "entity_value", "entity_name", "entity", "subject"), "entity_type_id": ("entity_type_id", "type_id")}


def _stripped(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def without_chunks(body: Column) -> Column:
    """Text without executable fences (those that open with a brace)."""
    return _stripped(F.regexp_replace(body, r"(?ms)^[ \t]*(```|~~~)\{.*?(^[ \t]*\1[^\n]*$\n?|\z)", ""))


def episodes(files: DataFrame, limit: int = EPISODE_CHARS) -> DataFrame:
    """``path, title, body, reference_time`` of documents (path, text, mtime): a header, then the text without front matter and executable fences, cut at a line's end."""
    front = F.regexp_extract("text", r"(?s)^---\n(.*?)\n---\n", 1)
    rest = F.regexp_replace("text", r"(?s)^---\n.*?\n---\n", "")
    clean = without_chunks(rest)
    head = F.left(clean, F.lit(limit))
    cut = F.concat(F.rtrim(F.when(F.contains(head, F.lit("\n")), F.regexp_replace(head, r"\n[^\n]*$", "")).otherwise(head)), F.lit(CUT_NOTE))
    f = files.withColumn("_front", front).withColumn("_body", F.when(F.length(clean) > limit, cut).otherwise(clean))
    named = F.trim(F.regexp_extract("_front", r"(?im)^title:[ \t]*[\"']?(.*?)[\"']?[ \t]*$", 1))
    heading = F.trim(F.regexp_extract("_body", r"(?m)^#[ \t]+(.+?)[ \t]*$", 1))
    stem = F.replace(F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", ""), F.lit("_"), F.lit(" "))
    title = F.coalesce(F.nullif(named, F.lit("")), F.nullif(heading, F.lit("")), stem)
    kind = F.regexp_extract("path", r"[^/.][^/]*\.([^./]+)$", 1)
    body = F.concat(F.lit("Source Path: "), "path", F.lit("\nDocument Title: "), title, F.lit("\nDocument Kind: "), F.when(kind == "", "markdown").otherwise(kind), F.lit("\n\n"), "_body")
    return f.select("path", title.alias("title"), _stripped(body).alias("body"), F.col("mtime").alias("reference_time"))


def code_text(labels: Column, props: Column) -> Column:
    """Text of a code node (map of strings) for an embedding; empty lines left out."""
    g = lambda *keys: F.coalesce(*[props[k] for k in keys], F.lit(""))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    more = F.map_filter(props, lambda k, v: k.isin("module", "class_name", "parent", "import_path") & (v != ""))
    source = F.left(g("source", "source_code"), F.lit(CODE_CHARS))
    return F.concat_ws(
        "\n", line("kind", F.array_join(labels, ", ")), line("name", g("name")), line("path", g("path")), line("relative_path", g("relative_path")), line("qualified_name", g("qualified_name", "full_name")),
        line("signature", g("signature")), line("line_number", g("line_number")), F.when(F.size(more) > 0, F.to_json(F.map_from_entries(F.array_sort(F.map_entries(more))))), F.when(source != "", line("snippet", source)),
    )


def graph_text(labels: Column, props: Column) -> Column:
    """Text of a graph node for an embedding: name, summary, content and the other properties, all bounded."""
    g = lambda k: F.coalesce(props[k], F.lit(""))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    content = F.left(g("content"), F.lit(CONTENT_CHARS))
    more = F.map_filter(props, lambda k, v: ~k.isin(*OWN_LINES) & (F.coalesce(v, F.lit("")) != ""))
    return F.concat_ws(
        "\n", line("kind", F.array_join(labels, ", ")), line("name", g("name")), line("summary", g("summary")), line("source_description", g("source_description")), F.when(content != "", line("content", content)),
        F.when(F.size(more) > 0, line("attributes", F.left(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(more)))), F.lit(EXTRA_CHARS)))),
    )


def embedding_is_current(vector: Column, model: Column, stored_dim: Column, wanted_model: str, dim: int) -> Column:
    return F.coalesce((F.size(vector) == dim) & (model == wanted_model) & (stored_dim.isNull() | (stored_dim == dim)), F.lit(False))


def _aliased(props: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.nullif(F.trim(props[n]), F.lit("")) for n in names])


def repaired_edges(items: DataFrame) -> DataFrame:
    """``source_entity_name, target_entity_name, relation_type, fact`` of answers (item: a JSON object under any of the known names); a missing fact is made of the other three."""
    p = items.withColumn("p", F.from_json("item", "map<string,string>"))
    v = {k: _aliased(F.col("p"), names) for k, names in EDGE_ALIASES.items()}
    relation = F.upper(F.btrim(F.regexp_replace(v["relation_type"], "[^A-Za-z0-9]+", "_"), F.lit("_")))
    fact = F.coalesce(v["fact"], F.concat(v["source_entity_name"], F.lit(" "), v["relation_type"], F.lit(" "), v["target_entity_name"]))
    return p.select(v["source_entity_name"].alias("source_entity_name"), v["target_entity_name"].alias("target_entity_name"), relation.alias("relation_type"), fact.alias("fact"))


def repaired_entities(items: DataFrame) -> DataFrame:
    """``name, entity_type_id`` of answers; a type that is no number counts as 0."""
    p = items.withColumn("p", F.from_json("item", "map<string,string>"))
    raw = _aliased(F.col("p"), ENTITY_ALIASES["entity_type_id"])
    named = _aliased(F.col("p"), ("entity_type_name", "type"))
    kind = F.when(raw.isNotNull(), F.coalesce(F.try_to_number(raw, F.lit("999999999")).cast("long"), F.lit(0))).when(named.isNotNull(), F.lit(0))
    return p.select(_aliased(F.col("p"), ENTITY_ALIASES["name"]).alias("name"), kind.cast("long").alias("entity_type_id"))


def relevance_tags(title: Column, abstract: Column, sections: Column, tags: list[str]) -> Column:
    """Tags that a paper's title, abstract or sections have, whatever the case."""
    body = F.array_join(F.transform(sections, lambda s: F.concat_ws("\n", s.title, s.content)), "\n")
    hay = F.lower(F.concat_ws("\n", title, F.coalesce(abstract, F.lit("")), body))
    return F.filter(F.array(*map(F.lit, tags)), lambda t: F.contains(hay, F.lower(t)))


def cited_by(papers: DataFrame) -> DataFrame:
    """``paper_id, cited_by``: other papers with a citation equal, whatever the case, to a paper's key."""
    cites = papers.select(F.col("paper_id").alias("source"), F.explode("citations").alias("c")).select("source", text.ascii_lower("c").alias("key")).distinct()
    keyed = papers.where("citation_key is not null").select("paper_id", text.ascii_lower("citation_key").alias("key"))
    hits = keyed.join(cites, "key").where("paper_id <> source").groupBy("paper_id").agg(F.array_sort(F.collect_set("source")).alias("cited_by"))
    return papers.select("paper_id").join(hits, "paper_id", "left").withColumn("cited_by", F.coalesce("cited_by", F.array().cast("array<string>")))


def line_hit_score(title: Column, node_id: Column, query: str) -> Column:
    """Score of a line hit: more if the node's title or id has the query too."""
    q = F.lit(query.lower())
    return F.when(F.contains(F.lower(title), q) | F.contains(F.lower(node_id), q), 1050).otherwise(700)


def label_counts(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def probes(sources: DataFrame, backends: DataFrame) -> DataFrame:
    """Sources and backends (name, state) as one sorted list."""
    return sources.select(F.lit("source").alias("kind"), "name", "state").unionByName(backends.select(F.lit("backend").alias("kind"), "name", "state")).orderBy("kind", "name")
