"""Queries of views, graphs, links, checks and texts over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ranking, text
from ..operators import capabilities, checks, context, episodes, links, memory, render, search, stats, tabular
from ..sources import service
from ..streaming import pipelines
from .hosts import ASCII_LOWER, LINES_SQL, table
from .registry import register


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as parsed papers: lines are sections, citation keys are found in the whole text."""
    body = F.coalesce("text", F.lit(""))
    section = F.transform(F.split(body, "\n"), lambda x: F.struct(F.lit(1).alias("level"), F.left(x, F.lit(20)).alias("title"), x.alias("content")))
    none = F.array().cast("array<string>")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("paper_id"), F.split(body, "\n")[0].alias("title"), body.alias("abstract"), section.alias("sections"), none.alias("figures"), none.alias("tables"),
        F.array_sort(F.array_distinct(text.found_all(body, text.CITATION_KEY))).alias("citations"), F.col("source").alias("citation_key"),
    )


def _notebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as notebooks of the paper of equal number."""
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.struct(n.alias("index"), text.cell_kind(F.lit("markdown")).alias("kind"), F.coalesce("text", F.lit("")).alias("source")).alias("c"))
    one = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("c")).alias("cells"))
    return one.select(F.concat(F.lit("n"), F.col("conv_id").cast("string")).alias("notebook_id"), F.col("conv_id").cast("string").alias("paper_id"), "cells")


_KEYS_SQL = "list_sort(list_distinct(regexp_extract_all(coalesce(text, ''), '@([A-Za-z][A-Za-z0-9:_-]+)', 1)))"
_CITES_SQL = f"(SELECT doc_id, unnest({_KEYS_SQL}) AS citation, unnest(range(len({_KEYS_SQL}))) AS i FROM documents)"


@register(
    "tabular_bundle",
    f"""SELECT 'papers' AS name, CAST(doc_id AS VARCHAR) AS id, string_split(coalesce(text, ''), chr(10))[1] AS a, len(string_split(coalesce(text, ''), chr(10))) || '/' || len({_KEYS_SQL}) AS b FROM documents
UNION ALL SELECT 'sections', doc_id || ':section:' || (line_no - 1), left(line, 20), md5(line) FROM {LINES_SQL}
UNION ALL SELECT 'citations', doc_id || ':citation:' || i, lower(regexp_replace(citation, '[^A-Za-z0-9]', '', 'g')), citation FROM {_CITES_SQL}
UNION ALL SELECT 'edges', doc_id || ':MENTIONS:' || doc_id || ':citation:' || i, 'MENTIONS', doc_id || ':citation:' || i FROM {_CITES_SQL} UNION ALL SELECT 'edges', doc_id || ':SIMILAR:' || (doc_id + 1), 'SIMILAR', CAST(doc_id + 1 AS VARCHAR) FROM documents
UNION ALL SELECT 'notebooks', 'n' || conv_id, CAST(conv_id AS VARCHAR), '' FROM conversations GROUP BY conv_id
UNION ALL SELECT 'cells', 'n' || conv_id || ':cell:' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1), 'markdown', md5(coalesce(text, '')) FROM conversations""",
)
def tabular_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six tables of the bundle, one below the other."""
    inferred = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source"), F.lit("SIMILAR").alias("rel_type"), (F.col("doc_id") + 1).cast("string").alias("target"))
    t = tabular.bundle(_papers(spark, sf_dir), _notebooks(spark, sf_dir), inferred)
    row = lambda name, key, a, b: t[name].select(F.lit(name).alias("name"), F.col(key).alias("id"), a.alias("a"), b.alias("b"))
    return (
        row("papers", "paper_id", F.col("title"), F.concat_ws("/", F.col("section_count").cast("string"), F.col("citation_count").cast("string")))
        .unionByName(row("sections", "section_id", F.col("title"), F.md5("content")))
        .unionByName(row("citations", "citation_row_id", F.col("citation_id"), F.col("citation")))
        .unionByName(row("edges", "edge_id", F.col("rel_type"), F.col("target")))
        .unionByName(row("notebooks", "notebook_id", F.col("paper_id"), F.lit("")))
        .unionByName(row("cells", "cell_id", F.col("kind"), F.md5("source")))
    )


@register(
    "paper_graph",
    f"""SELECT 'paper:' || doc_id AS id, 'Paper' AS kind, coalesce(nullif(string_split(coalesce(text, ''), chr(10))[1], ''), 'paper:' || doc_id) AS title FROM documents
UNION ALL SELECT 'paper:' || doc_id || ':section:' || (line_no - 1), 'PaperSection', coalesce(nullif(left(line, 20), ''), 'paper:' || doc_id || ':section:' || (line_no - 1)) FROM {LINES_SQL} UNION ALL SELECT DISTINCT 'citation:' || citation, 'Citation', citation FROM {_CITES_SQL}
UNION ALL SELECT 'paper:' || doc_id, 'HAS_SECTION', 'paper:' || doc_id || ':section:' || (line_no - 1) FROM {LINES_SQL} UNION ALL SELECT 'paper:' || doc_id, 'CITES', 'citation:' || citation FROM {_CITES_SQL}""",
)
def paper_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with label and title, and edges."""
    nodes, edges = tabular.graph_of(_papers(spark, sf_dir))
    return tabular.node_view(nodes).select("id", "kind", "title").unionByName(edges.select(F.col("source").alias("id"), F.col("rel_type").alias("kind"), F.col("target").alias("title")))


#: Kind, its properties, and the title, subtitle and searched properties they give.
_VIEWS = (
    ("Paper", {"title": "<n>", "year": "<s>", "arxiv_id": "<b>", "abstract": "<t>", "other": "unseen"}, "<n>", "<s> · arXiv:<b>", "<t>", "", "<n>"),
    ("PaperSection", {"title": "<n>", "level": "2", "paper_id": "p<k>", "content": "<t>"}, "<n>", "Level 2 · p<k>", "<t>", "", "<n> p<k> <t>"),
    ("Citation", {"citation_key": "c<k>"}, "c<k>", "c<k>", "", "", "c<k>"),
    ("CodeSymbol", {"qualified_name": "m.<k>", "name": "<n>", "symbol_kind": "function", "repo_path": "src/<b>", "doc_summary": "<t>"}, "m.<k>", "function · src/<b>", "<t>", "src/<b>", "<n> m.<k> <t> src/<b>"),
    ("CodeFile", {"repo_path": "src/<b>", "name": "<n>"}, "src/<b>", "", "", "src/<b>", "<n> src/<b>"),
    ("CodeModule", {"name": "<n>", "module": "<b>"}, "<n>", "", "", "", "<n> <b>"),
    ("Concept", {"label": "<b>", "definition_short": "<t>", "source_path": "docs/<b>"}, "<b>", "docs/<b>", "<t>", "docs/<b>", "<b> <t> docs/<b>"),
    ("GeneratedContext", {"title": "", "label": "<b>"}, "x:<k>", "", "", "", " <b>"),
    ("Other", {"name": "<n>", "summary": "<t>", "text": "<n>", "kg_tags": "<b>"}, "<n>", "", "<t>", "", "<n> <t> <n> <b>"),
)


def _view_sql(template: str) -> str:
    out = "'" + template.replace("'", "''") + "'"
    for mark, c in (("<n>", "p_name"), ("<b>", "p_brand"), ("<t>", "p_type"), ("<k>", "CAST(p_partkey AS VARCHAR)"), ("<s>", "CAST(p_size AS VARCHAR)")):
        out = f"replace({out}, '{mark}', {c})"
    return out


@register(
    "node_view",
    " UNION ALL ".join(
        f"""SELECT 'x:' || p_partkey AS id, '{kind}' AS kind, {_view_sql(title)} AS title, {_view_sql(subtitle)} AS subtitle, {_view_sql(description)} AS description, nullif({_view_sql(path)}, '') AS path,
  lower('x:' || p_partkey || ' {kind} {kind} ' || {_view_sql(description)} || ' ' || {_view_sql(searched)}) AS search_text FROM part WHERE p_partkey % {len(_VIEWS)} = {i}"""
        for i, (kind, _, title, subtitle, description, path, searched) in enumerate(_VIEWS)
    ),
)
def node_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a node of one of the kinds."""
    kinds = F.array(*[F.lit(v[0]) for v in _VIEWS])
    at = (F.col("p_partkey") % len(_VIEWS)).cast("int")

    def filled(t: str) -> F.Column:
        out = F.lit(t)
        for mark, c in (("<n>", "p_name"), ("<b>", "p_brand"), ("<t>", "p_type"), ("<k>", "p_partkey"), ("<s>", "p_size")):
            out = F.replace(out, F.lit(mark), F.col(c).cast("string"))
        return out

    props = F.element_at(F.array(*[F.to_json(F.create_map(*[x for k, v in view[1].items() for x in (F.lit(k), filled(v))])) for view in _VIEWS]), at + 1)
    nodes = table(spark, sf_dir, "part").select(F.concat(F.lit("x:"), F.col("p_partkey").cast("string")).alias("id"), F.array(F.element_at(kinds, at + 1)).alias("labels"), props.alias("properties"))
    return tabular.node_view(nodes).select("id", "kind", "title", "subtitle", "description", "path", "search_text")


@register(
    "memory_graph",
    """WITH r AS (SELECT 'm' || p_partkey AS source, CASE p_partkey % 3 WHEN 0 THEN 'paper:p' || p_size WHEN 1 THEN 'doc_surface:repo:docs/' || p_brand ELSE 'code_surface:symbol:' || p_size END AS target, CASE p_partkey % 3 WHEN 0 THEN 'paper' WHEN 1 THEN 'doc_surface' ELSE 'code_surface' END AS kind FROM part)
SELECT source, 'RELATES_TO' AS what, target FROM r UNION ALL SELECT source, 'ProjectMemory', source FROM r
UNION ALL SELECT DISTINCT target, CASE kind WHEN 'doc_surface' THEN 'DocSurface' ELSE 'RepoSurface' END, regexp_extract(target, '[^:]*$') FROM r WHERE kind <> 'paper'""",
)
def memory_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    kind = F.when(k % 3 == 0, "paper").when(k % 3 == 1, "doc_surface").otherwise("code_surface")
    target = F.when(k % 3 == 0, F.concat(F.lit("paper:p"), F.col("p_size").cast("string"))).when(k % 3 == 1, F.concat(F.lit("doc_surface:repo:docs/"), "p_brand")).otherwise(F.concat(F.lit("code_surface:symbol:"), F.col("p_size").cast("string")))
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("m"), k.cast("string")).alias("node_id"), target.alias("target"), kind.alias("target_kind"))
    nodes, edges = tabular.memory_graph(p.select("node_id", F.lit("note").alias("kind"), F.col("node_id").alias("title"), F.lit("").alias("text")), p.select(F.col("node_id").alias("source"), "target", F.lit("RELATES_TO").alias("relation"), "target_kind", F.lit("").alias("evidence")))
    view = tabular.node_view(nodes).select(F.col("id").alias("source"), F.col("kind").alias("what"), F.col("title").alias("target"))
    return edges.select("source", F.col("rel_type").alias("what"), "target").unionByName(view)


def _episode_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text for each part that names files of suppliers, a symbol and words."""
    k = F.col("p_partkey").cast("string")
    s = (F.col("p_partkey") % 7).cast("string")
    body = F.concat(F.lit("See ./src/pkg"), s, F.lit("/mod.py and `other/x"), k, F.lit(".md`: Compute_all"), s, F.lit(" of "), "p_name", F.lit(", not compute_all."))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("e"), k).alias("id"), body.alias("text"))


def _code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("f"), k).alias("id"), F.concat(F.lit("/repo/src/pkg"), k, F.lit("/mod.py")).alias("path"), F.concat(F.lit("src/pkg"), k, F.lit("/mod.py")).alias("relative_path"),
        F.concat(F.lit("compute_ALL"), F.floor(F.col("s_suppkey") / 2 * 2).cast("string")).alias("name"),
    )


@register("episode_path_links", "SELECT 'e' || p_partkey AS source, 'f' || s_suppkey AS target, 'path' AS strategy, 1.0::DOUBLE AS score, 'src/pkg' || s_suppkey || '/mod.py' AS evidence FROM part JOIN supplier ON p_partkey % 7 = s_suppkey")
def episode_path_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.path_links(_episode_texts(spark, sf_dir), _code_files(spark, sf_dir))


@register("episode_symbol_links", "SELECT 'e' || p_partkey AS source, 'f' || s_suppkey AS target, 'exact_symbol' AS strategy, 0.95::DOUBLE AS score, 'compute_all' || s_suppkey AS evidence FROM part JOIN supplier ON p_partkey % 7 = s_suppkey")
def episode_symbol_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.symbol_links(_episode_texts(spark, sf_dir), _code_files(spark, sf_dir))


@register(
    "entity_name_links",
    """WITH s AS (SELECT p_partkey AS id, lower(p_name) AS key, count(*) OVER (PARTITION BY lower(p_name)) AS n FROM part)
SELECT c_custkey AS source, s.id AS target, 'exact_symbol' AS strategy, 0.98::DOUBLE AS score, upper(p.p_name) AS evidence FROM customer JOIN part p ON p.p_partkey = c_custkey % 150 JOIN s ON s.key = lower(p.p_name) AND n <= 3""",
)
def entity_name_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    e = table(spark, sf_dir, "customer").select(F.col("c_custkey"), (F.col("c_custkey") % 150).alias("id")).join(p, "id").select(F.col("c_custkey").alias("id"), F.upper("name").alias("name"))
    return links.name_links(e, p)


@register("entity_mention_links", "SELECT DISTINCT 'n' || o_custkey AS source, 'f' || s_suppkey AS target, 'path' AS strategy, 0.9::DOUBLE AS score FROM orders JOIN part ON p_partkey = o_orderkey % 100 JOIN supplier ON p_partkey % 7 = s_suppkey")
def entity_mention_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda tag, c: F.concat(F.lit(tag), c.cast("string"))
    o = table(spark, sf_dir, "orders").select(name("e", F.col("o_orderkey") % 100).alias("source"), name("n", F.col("o_custkey")).alias("target"), F.lit("MENTIONS").alias("rel_type"))
    parts = _episode_texts(spark, sf_dir).select("id", F.array(F.lit("Episodic")).alias("labels"))
    people = o.select(F.col("target").alias("id")).distinct().withColumn("labels", F.array(F.lit("Entity")))
    return links.mention_links(links.mentions_of(o, parts.unionByName(people)), links.path_links(_episode_texts(spark, sf_dir), _code_files(spark, sf_dir)))


@register(
    "embedding_links_shared",
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, ['a' || vec_id % 3, 'b' || vec_id % 5] AS t FROM embeddings),
p AS (SELECT a.vec_id AS source, b.vec_id AS target, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id AND b.vec_id <> a.vec_id + 1 AND list_has_any(a.t, b.t))
SELECT source, target, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, target) AS r FROM p WHERE score >= 0.25) WHERE r = 1""",
)
def embedding_links_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors with all others that share a word with them and aren't linked yet."""
    v = F.col("vec_id")
    words = F.array(F.concat(F.lit("a"), (v % 3).cast("string")), F.concat(F.lit("b"), (v % 5).cast("string")))
    e = table(spark, sf_dir, "embeddings").select(v.alias("id"), F.col("embedding").alias("vec"), F.lit(0).alias("key"), words.alias("tokens"))
    known = e.select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"))
    return links.vector_links(e, e, 0.25, known=known).withColumn("score", F.round("score", 4))


@register(
    "merged_links",
    """SELECT s_suppkey AS source, s_suppkey % 10 AS target, 'old' AS strategy, 1.0::DOUBLE AS score FROM supplier WHERE s_suppkey % 10 <> 3
UNION ALL SELECT s_nationkey, 3, 'new', arg_max(CAST(s_suppkey AS DOUBLE), s_suppkey) FROM supplier GROUP BY s_nationkey""",
)
def merged_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    old = s.select(F.col("s_suppkey").alias("source"), (F.col("s_suppkey") % 10).alias("target"), F.lit("old").alias("strategy"), F.lit(1.0).alias("score"))
    new = s.select(F.col("s_nationkey").cast("long").alias("source"), F.lit(3).cast("long").alias("target"), F.lit("new").alias("strategy"), F.col("s_suppkey").cast("double").alias("score"), F.col("s_suppkey").alias("pos"))
    return links.merge_links(old, new)


@register(
    "text_hits",
    f"""WITH h AS (SELECT doc_id, line_no, line, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS r FROM {LINES_SQL} WHERE regexp_matches(line, '[Ll]icen[sc]e|\\d{{3}}'))
SELECT 'docs/' || doc_id || '.md' AS path, line_no AS line, CASE WHEN length(trim(line)) > 240 THEN left(trim(line), 239) || '…' ELSE trim(line) END AS snippet, 'd' || doc_id AS id, 'title ' || doc_id AS title, 700 AS score FROM h WHERE r <= 5""".replace("\\\\d", "\\d"),
)
def text_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as files, searched with a regular expression."""
    k = F.col("doc_id").cast("string")
    path = F.concat(F.lit("docs/"), k, F.lit(".md"))
    d = table(spark, sf_dir, "documents")
    nodes = d.select(F.concat(F.lit("d"), k).alias("id"), F.concat(F.lit("title "), k).alias("title"), path.alias("path"), F.lit(None).cast("long").alias("line_start"), F.lit(None).cast("long").alias("line_end"))
    return search.text_hits(d.select(path.alias("path"), "text"), r"[Ll]icen[sc]e|\d{3}", nodes)


@register(
    "symbol_lines",
    """WITH f AS (SELECT 'src/p' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '.py' ELSE '.rs' END AS path, p_partkey FROM part),
d AS (SELECT path, 0 AS line, CASE WHEN p_partkey % 2 = 0 THEN 'Widget' || p_partkey ELSE 'Gear' || p_partkey END AS name, CASE WHEN p_partkey % 2 = 0 THEN 'class' ELSE 'struct' END AS kind FROM f UNION ALL SELECT path, 1, 'run_' || p_partkey, 'function' FROM f),
m AS (SELECT *, contains(lower(path || ' ' || name), 'gear1') AS matched, row_number() OVER (ORDER BY path, line, name) AS n FROM d),
k AS (SELECT *, row_number() OVER (ORDER BY n) AS taken FROM m WHERE matched OR n <= 3)
SELECT name, kind, path, CASE WHEN matched THEN 'matched task terms' ELSE 'profile entrypoint' END AS reason FROM k WHERE taken <= 24 ORDER BY path, name LIMIT 12""",
)
def symbol_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    n = k.cast("string")
    py = F.concat(F.lit("class Widget"), n, F.lit("(Base):\n    def run_"), n, F.lit("(self): pass\nx = 1"))
    rs = F.concat(F.lit("pub struct Gear"), n, F.lit(" {}\n  pub fn run_"), n, F.lit("() {}"))
    f = table(spark, sf_dir, "part").select(F.concat(F.lit("src/p"), n, F.when(k % 2 == 0, ".py").otherwise(".rs")).alias("path"), F.when(k % 2 == 0, py).otherwise(rs).alias("text"))
    return search.symbol_lines(f, ["gear1"])


@register(
    "rendered_papers",
    """SELECT s_suppkey AS k, CASE WHEN s_suppkey % 5 = 0 THEN 'untitled' ELSE s_name END || ' (' || CASE WHEN s_suppkey % 3 = 0 THEN 'no paperId' ELSE 's' || s_suppkey END || ')' || chr(10) || 'year: ' || coalesce(CAST(nullif(s_suppkey % 7, 0) AS VARCHAR), 'n/a') || ' | citations: ' || s_suppkey || ' | references: n/a' || chr(10) || 'venue: n/a' || chr(10) || 'authors: ' || CASE WHEN s_suppkey % 2 = 0 THEN 'A, B' ELSE 'n/a' END
  || CASE WHEN s_suppkey % 4 = 0 THEN chr(10) || 'tldr: short' ELSE '' END AS body FROM supplier""",
)
def rendered_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, none = F.col("s_suppkey"), F.lit(None).cast("string")
    names = F.when(k % 2 == 0, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array().cast("array<string>"))
    body = render.paper(F.when(k % 5 != 0, F.col("s_name")), F.when(k % 3 != 0, F.concat(F.lit("s"), k.cast("string"))), F.when(k % 7 != 0, k % 7), k, none, none, names, F.when(k % 4 == 0, "short"), none)
    return table(spark, sf_dir, "supplier").select(k.alias("k"), body.alias("body"))


@register(
    "rendered_counts",
    """WITH c AS (SELECT 'source' AS what, source AS key, count(*) AS n FROM documents GROUP BY source UNION ALL SELECT 'lang', lang, count(*) FROM documents GROUP BY lang)
SELECT what, '| Group | Count |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || key || ' | ' || n || ' |', chr(10) ORDER BY key) AS "table" FROM c WHERE key IS NOT NULL GROUP BY what""",
)
def rendered_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by source and by language, in one pass, as tables."""
    d = table(spark, sf_dir, "documents").groupingSets([[F.col("source")], [F.col("lang")]], "source", "lang").agg(F.count(F.lit(1)).alias("n"), F.grouping("source").alias("by_lang"))
    c = d.select(F.when(F.col("by_lang") == 1, "lang").otherwise("source").alias("what"), F.coalesce("source", "lang").alias("key"), "n").where("key is not null")
    return render.counts_table(c, "what", "key", "n", ("Group", "Count"))


@register(
    "rendered_targets",
    """WITH r AS (SELECT n_regionkey, string_agg('- `r' || n_nationkey || '` on `b` [ok]: ' || CASE WHEN n_nationkey % 2 = 0 THEN 'acc=' || n_nationkey || ' %' ELSE 'no scores recorded' END, chr(10) ORDER BY n_nationkey) AS runs FROM nation WHERE n_regionkey <> 2 GROUP BY 1)
SELECT r_name AS title, '# Auto Research Target: ' || r_name || chr(10) || chr(10) || 'why' || chr(10) || chr(10) || '## Selected Benchmarks' || chr(10) || chr(10) || '- `b`: use. Task scale: small' || coalesce(chr(10) || chr(10) || '## Available Results' || chr(10) || chr(10) || runs, '') || chr(10) || chr(10) || '## Concatenated Components' || chr(10) || chr(10) || '### 1. One' || chr(10) || chr(10) || 'do it' || chr(10) AS markdown,
  'Title: Auto Research: ' || r_name || chr(10) || chr(10) || '## Summary' || chr(10) || 'why' || chr(10) || chr(10) || '## Selected Benchmarks' || chr(10) || '- `b`: sum' || coalesce(chr(10) || chr(10) || '## Available Results' || chr(10) || runs, '') || chr(10) || chr(10) || '## Proposed Work' || chr(10) || '1. One' AS issue FROM region LEFT JOIN r ON r_regionkey = n_regionkey""",
)
def rendered_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region as a promoted target, with its nations as runs."""
    k = F.col("n_nationkey")
    score = F.struct(F.lit("acc").alias("metric"), k.alias("value"), F.lit("%").alias("unit"))
    scores = F.when(k % 2 == 0, F.array(score)).otherwise(F.filter(F.array(score), lambda _: F.lit(False)))
    run = F.struct(k.alias("k"), F.concat(F.lit("r"), k.cast("string")).alias("run_id"), F.lit("b").alias("benchmark_id"), F.lit("ok").alias("status"), scores.alias("scores"))
    runs = table(spark, sf_dir, "nation").where("n_regionkey <> 2").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list(run)).alias("runs"))
    r = table(spark, sf_dir, "region").join(runs, "r_regionkey", "left").withColumn("runs", F.coalesce("runs", F.array().cast(runs.schema["runs"].dataType)))
    benchmarks = F.array(F.struct(F.lit("b").alias("id"), F.lit("use").alias("best_use"), F.lit("small").alias("task_scale"), F.lit("sum").alias("summary")))
    components = F.array(F.struct(F.lit("One").alias("title"), F.lit("do it").alias("prompt")))
    args = (F.col("r_name"), F.lit("why"), benchmarks, F.col("runs"), components)
    return r.select(F.col("r_name").alias("title"), render.target_markdown(*args).alias("markdown"), render.target_issue(*args).alias("issue"))


@register(
    "rendered_hits",
    """WITH h AS (SELECT n_regionkey, n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r FROM nation)
SELECT n_regionkey AS q, string_agg(r || '. ' || n_name || ' (' || n_nationkey || ')' || chr(10) || '   score: 10 | fields: title' || chr(10) || '   snip', chr(10) || chr(10) ORDER BY r) AS text FROM h GROUP BY 1""",
)
def rendered_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("q"), F.col("n_name").alias("title"), F.col("n_nationkey").alias("id"), F.lit(10).alias("score"), F.lit("title").alias("matched_fields"), F.lit("snip").alias("snippet"))
    return render.hits(n, "q", ["id"])


@register(
    "part_states",
    """WITH r AS (SELECT count(*) AS records, count(*) FILTER (doc_id % 2 = 0) AS parsed FROM documents), l AS (SELECT count(*) AS enriched FROM labels)
SELECT 'literature_registry: ' || 'ready' || ' (records=' || records || ')' AS line FROM r UNION ALL SELECT 'downloads: configured (records=' || records || ')' FROM r UNION ALL SELECT 'parsing: ' || CASE WHEN parsed > 0 THEN 'generated' ELSE 'missing' END || ' (records=' || records || ')' FROM r
UNION ALL SELECT 'docs: unavailable (records=' || records || ')' FROM r UNION ALL SELECT 'graph: generated (records=' || records || ')' FROM r UNION ALL SELECT 'viewer: ready (records=' || records || ')' FROM r
UNION ALL SELECT 'metadata_service: ' || CASE WHEN enriched > 0 THEN 'generated' ELSE 'configured' END || ' (records=' || records || ')' FROM r, l UNION ALL SELECT 'project_memory: configured (records=' || records || ')' FROM r""",
)
def part_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, enriched = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").agg(F.count(F.lit(1)).alias("enriched"))
    found = d.agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("doc_id") % 3 == 0).alias("local_tex"), F.count_if(F.col("doc_id") % 2 == 0).alias("parsed")).crossJoin(enriched)
    yes = {c: F.lit(c in ("manifest", "bib", "graph_generated", "service_configured", "memory_configured")) for c in ("manifest", "bib", "registry", "download_pdfs", "docs_configured", "docs_generated", "graph_configured", "graph_generated", "service_configured", "service_key", "memory_configured", "memory_present")}
    found = found.withColumns({"local_pdf": F.lit(0), "expected_pdfs": F.lit(0), **yes})
    s = capabilities.part_states(found).crossJoin(found.select("records"))
    return s.select(render.capability_line(F.col("part"), F.col("state"), {"records": F.col("records")}).alias("line"))


@register(
    "missing_leaves",
    """WITH b AS (SELECT n_name AS name, CASE n_nationkey % 4 WHEN 0 THEN 'ready' WHEN 1 THEN 'stale' WHEN 2 THEN 'missing' ELSE 'unavailable' END AS state, n_nationkey % 3 <> 0 AS configured, n_nationkey FROM nation)
SELECT name AS provider, 'Backend is ' || state || '; resolve before treating generated context as current.' AS query, 'pending' AS status, CASE WHEN n_nationkey % 5 = 0 THEN 'inspect capabilities' ELSE 'refresh ' || name END AS resolution_command FROM b WHERE configured AND state IN ('stale', 'missing')
UNION ALL SELECT 'docs', 'current docs', 'pending', 'look them up'""",
)
def missing_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.missing_leaves(_backends(spark, sf_dir), spark.createDataFrame([("docs", "current docs", "look them up")] * 2, "provider string, query string, resolution_command string"))


def _backends(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("n_nationkey"), F.col("n_name")
    configured, present = k % 3 != 0, k % 4 != 2
    s = table(spark, sf_dir, "nation").select(name.alias("name"), F.lit("graph").alias("kind"), (k % 4 != 3).alias("configured"), present.alias("present"), (k % 4 == 0).alias("fresh"), F.when(k % 5 != 0, F.concat(F.lit("refresh "), name)).alias("repair_command"), configured.alias("wanted"))
    return capabilities.source_descriptors(s).join(s.select("name", F.col("wanted").alias("configured")), "name")


@register(
    "backend_flags",
    """WITH b AS (SELECT n_name AS name, n_nationkey % 4 AS s, CASE WHEN n_nationkey % 5 <> 0 THEN 'refresh ' || n_name END AS repair FROM nation)
SELECT name, CASE WHEN s = 1 THEN 'backend_refresh_first:' || name || ': ' || coalesce(repair, 'inspect capabilities') || '|' WHEN s = 2 THEN 'backend_missing_leaf:' || name || ': ' || coalesce(repair, 'resolve missing source') || '|' ELSE '' END || CASE WHEN contains(name, 'I') THEN 'unsupported_overclaim' ELSE '' END AS flags FROM b""",
)
def backend_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    task = F.concat(F.lit("claim-check "), F.when(F.contains("name", F.lit("I")), "Deployed").otherwise(""))
    flag = checks.backend_flag(F.col("recommendation"), F.col("name"), F.col("repair_command"))
    found = F.array_join(checks.risk_flags(task, [(flag.isNotNull(), flag)]), "|")
    return _backends(spark, sf_dir).select("name", F.when(flag.isNotNull() & ~F.contains(found, F.lit("unsupported")), F.concat(found, F.lit("|"))).otherwise(found).alias("flags"))


@register(
    "resumed_steps",
    """SELECT CAST(s_suppkey AS VARCHAR) AS paper_id, CASE s_suppkey % 4 WHEN 0 THEN 'metadata_only' WHEN 1 THEN CASE WHEN s_suppkey % 3 = 0 THEN 'failed' ELSE 'downloaded' END WHEN 2 THEN 'downloaded' ELSE 'failed' END AS parse_status FROM supplier""",
)
def resumed_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Downloads of the rows that wait for one; some fail, what was done before stays."""
    k = F.col("s_suppkey")
    states = F.array(*map(F.lit, ("metadata_only", "pending_download", "downloaded", "failed")))
    r = table(spark, sf_dir, "supplier").select(k.cast("string").alias("paper_id"), F.element_at(states, (k % 4 + 1).cast("int")).alias("parse_status"))
    done = pipelines.to_do(r, "downloaded").select("paper_id", (F.col("paper_id").cast("long") % 3 != 0).alias("ok"))
    return pipelines.advanced(r, done, "downloaded")


def _embed(texts: list[str]) -> list[list[float]]:
    return [[float(len(t)), 1.0] for t in texts]


@register(
    "refreshed_vectors",
    """SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 0.0 ELSE length(p_name) END::DOUBLE AS first, sha256(p_name) AS digest FROM part""",
)
def refreshed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third part has a current vector, another third one of an older text, the rest none; all but the first are embedded."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k.alias("id"), F.col("p_name").alias("text"))
    old = rows.where("id % 3 <> 2").select("id", F.array(F.lit(0.0), F.lit(0.0)).cast("array<float>").alias("vec"), F.lit("m").alias("model"), F.sha2(F.when(F.col("id") % 3 == 0, F.col("text")).otherwise("older"), 256).alias("digest"))
    new = pipelines.refreshed_vectors(rows, old, "m", lambda df: service.embeddings(df, _embed, 2))
    return new.select("id", F.col("vec")[0].cast("double").alias("first"), "digest")


@register("ingested_episodes", "SELECT 'e' || s_suppkey AS path, s_suppkey % 4 <> 0 AS ok, CASE WHEN s_suppkey % 4 = 0 THEN 'ValueError: e' || s_suppkey END AS error FROM supplier")
def ingested_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def send(row: dict) -> None:
        if int(row["path"][1:]) % 4 == 0:
            raise ValueError(row["path"])

    e = table(spark, sf_dir, "supplier").select(F.concat(F.lit("e"), F.col("s_suppkey").cast("string")).alias("path"), F.col("s_name").alias("title"), F.lit("").alias("body"), F.current_timestamp().alias("reference_time"))
    return pipelines.ingest(e, send, 3)


@register("ending_counts", "SELECT CASE n_nationkey % 3 WHEN 0 THEN 'md' WHEN 1 THEN 'py' ELSE '[none]' END AS ending, count(*) AS n FROM nation GROUP BY 1")
def ending_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey") % 3
    return stats.ending_counts(table(spark, sf_dir, "nation").select(F.concat(F.lit("a.b/"), "n_name", F.when(k == 0, ".MD").when(k == 1, ".py").otherwise("")).alias("path")))


@register(
    "cited_by",
    f"""WITH c AS (SELECT DISTINCT doc_id, lower(citation) AS key FROM {_CITES_SQL}), p AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'EXAMPLE' WHEN doc_id % 3 = 1 THEN source END AS citation_key FROM documents)
SELECT CAST(p.doc_id AS VARCHAR) AS paper_id, coalesce(string_agg(CAST(c.doc_id AS VARCHAR), ',' ORDER BY CAST(c.doc_id AS VARCHAR)) FILTER (c.doc_id <> p.doc_id), '') AS cited_by FROM p LEFT JOIN c ON lower(citation_key) = key GROUP BY p.doc_id""",
)
def cited_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("paper_id").cast("long") % 3
    p = _papers(spark, sf_dir).withColumn("citation_key", F.when(k == 0, "EXAMPLE").when(k == 1, F.col("citation_key")))
    return episodes.cited_by(p).select("paper_id", F.array_join("cited_by", ",").alias("cited_by"))


@register(
    "relevance_tags",
    f"""SELECT doc_id, concat_ws(',', CASE WHEN contains({ASCII_LOWER.format("coalesce(text, '')")}, 'license') THEN 'License' END, CASE WHEN contains({ASCII_LOWER.format("coalesce(text, '')")}, 'der') THEN 'der' END) AS tags FROM documents""",
)
def relevance_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = episodes.relevance_tags(F.col("title"), F.col("abstract"), F.col("sections"), ["License", "der"])
    return _papers(spark, sf_dir).select(F.col("paper_id").cast("long").alias("doc_id"), F.array_join(tags, ",").alias("tags"))


@register(
    "ranked_spans",
    """WITH s AS (SELECT p_partkey, 'docs/' || p_brand AS path, p_size AS line, p_name AS text, CASE WHEN p_brand LIKE 'Brand#1%' THEN 1.5 ELSE 1.0 END * (1 + p_partkey % 4) AS score, len(list_filter(regexp_split_to_array(p_name, '\\s+'), lambda w: w <> '')) + 8 AS cost FROM part),
b AS (SELECT *, sum(cost) OVER (ORDER BY score DESC, path, line, p_partkey) AS so_far, row_number() OVER (ORDER BY score DESC, path, line, p_partkey) AS n FROM s)
SELECT path, line, text, cost, (SELECT sum(cost) FROM s) > 120 AS truncated FROM b WHERE so_far <= 120 OR n = 1""".replace("\\\\s", "\\s"),
)
def ranked_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ranking of all parts' names as evidence, by authority, path and line, cut to a budget."""
    s = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("docs/"), "p_brand").alias("path"), F.col("p_size").alias("line"), F.col("p_name").alias("text"), (ranking.authority("p_brand", {"Brand#1*": 1.5}) * (1 + F.col("p_partkey") % 4)).alias("score"))
    return context.within_budget(s, 120, [F.desc("score"), "path", "line", "p_partkey"]).select("path", "line", "text", "cost", "truncated")


@register(
    "consolidation",
    """SELECT * FROM (SELECT 'history' AS kind, p_name || p_partkey AS name FROM part WHERE contains(p_type, 'ECONOMY') ORDER BY name DESC LIMIT 8) UNION ALL SELECT * FROM (SELECT 'backlog', s_name FROM supplier ORDER BY s_name LIMIT 8)""",
)
def consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "part").select(F.concat("p_name", F.col("p_partkey").cast("string")).alias("name"), F.col("p_type").alias("text"))
    return memory.consolidation(h, table(spark, sf_dir, "supplier").select(F.col("s_name").alias("title")), "ECONOMY")
