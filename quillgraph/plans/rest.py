"""Queries of nodes, facts, questions, texts for embeddings and answers of models, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import episodes, graph, memory, qa
from ..sources import files, notebooks
from .hosts import ASCII_LOWER, table
from .registry import register


@register("probe_states", "SELECT 'source' AS kind, s_name AS name, CASE WHEN s_nationkey % 2 = 0 THEN 'ready' ELSE 'stale' END AS state FROM supplier UNION ALL SELECT 'backend', p_name || ' ' || p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'missing' ELSE 'ready' END FROM part")
def probe_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as sources and parts as backends, in one list of probes."""
    sources = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.when(F.col("s_nationkey") % 2 == 0, "ready").otherwise("stale").alias("state"))
    backends = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"), F.when(F.col("p_partkey") % 3 == 0, "missing").otherwise("ready").alias("state"))
    return episodes.probes(sources, backends)


@register("label_totals", "SELECT label, count(*) AS n FROM (SELECT unnest([source, lang, CASE WHEN n_chars > 1000 THEN 'long' ELSE 'short' END]) AS label FROM documents) GROUP BY label")
def label_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by label: source, language and length."""
    return episodes.label_counts(table(spark, sf_dir, "documents").select(F.array("source", "lang", F.when(F.col("n_chars") > 1000, "long").otherwise("short")).alias("labels")))


@register(
    "merged_nodes",
    "SELECT coalesce(p.id, d.id) AS id, CASE WHEN p.id IS NULL THEN 'document' ELSE 'page' END AS label, CASE WHEN p.id IS NULL THEN d.title ELSE p.title END AS title FROM (SELECT doc_id // 2 AS id, min(source) AS title FROM documents GROUP BY 1) d FULL JOIN (SELECT page_id AS id, url AS title FROM pages) p ON p.id = d.id",
)
def merged_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of documents and of pages; of one id that of the page counts."""
    docs = table(spark, sf_dir, "documents").groupBy(F.expr("doc_id div 2").alias("id")).agg(F.min("source").alias("title")).select("id", F.lit("document").alias("label"), "title")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit("page").alias("label"), F.col("url").alias("title"))
    return graph.union_nodes([docs, pages])


@register(
    "context_answers",
    f"""WITH q AS (SELECT item_id AS question_id, unnest(list_distinct(string_split_regex({ASCII_LOWER.format("text")}, '[^a-z0-9]+'))) AS t FROM benchmark),
p AS (SELECT conv_id || ':' || turn AS name, unnest(list_distinct(string_split_regex({ASCII_LOWER.format("text")}, '[^a-z0-9]+'))) AS t FROM conversations),
n AS (SELECT question_id, name, count(*) AS overlap FROM q JOIN p USING (t) WHERE length(t) >= 3 GROUP BY ALL)
SELECT question_id, name, overlap FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY overlap DESC, name) AS r FROM n) WHERE r <= 10""",
)
def context_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each benchmark item the ten turns that share most words with it."""
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    pool = table(spark, sf_dir, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("name"), text.task_terms("text").alias("tokens"))
    return qa.direct_answers(questions, pool)


@register("first_events", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def first_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user."""
    return memory.first_of_each(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_type", "event_id")


_FILES_SQL = "(SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'docs/a' WHEN 1 THEN 'x/docs/b' WHEN 2 THEN 'src/c' ELSE 'docs/_generated/d' END || page_id || CASE WHEN page_id % 3 = 0 THEN '.md' ELSE '.py' END AS path FROM pages)"


@register("matched_files", f"SELECT page_id, path FROM {_FILES_SQL} WHERE (regexp_matches(path, '^(.*/)?docs/.*\\.md$') OR regexp_matches(path, '^(.*/)?src/.*$')) AND NOT regexp_matches(path, '^(.*/)?docs/_generated/.*$')")
def matched_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths made of all pages that fit globs and none of those left out."""
    page = F.col("page_id")
    folder = F.when(page % 4 == 0, "docs/a").when(page % 4 == 1, "x/docs/b").when(page % 4 == 2, "src/c").otherwise("docs/_generated/d")
    path = F.concat(folder, page.cast("string"), F.when(page % 3 == 0, ".md").otherwise(".py"))
    return files.matching(table(spark, sf_dir, "pages").select("page_id", path.alias("path")), ["docs/*.md", "src/*"], ["docs/_generated/*"])


_SYMBOLS_SQL = "(SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'class' ELSE 'function' END AS kind, CASE WHEN p_partkey % 5 = 0 THEN '_' ELSE '' END || 'part' || p_partkey % 700 AS name, 'm' || p_partkey AS module, CASE WHEN p_partkey % 7 = 0 THEN 'Other' ELSE 'm' || p_partkey END AS parent, 'src/m' || p_partkey || '.py' AS path FROM part)"


@register(
    "symbol_questions",
    f"""WITH s AS (SELECT *, count(*) OVER (PARTITION BY kind, name) AS n FROM {_SYMBOLS_SQL} WHERE parent = module AND NOT starts_with(name, '_') AND length(name) >= 4)
SELECT name, kind AS symbol_kind, path, 'Which file defines the ' || kind || ' `' || name || '`? Reply with only the repo-relative path.' AS question FROM s WHERE n = 1""",
)
def symbol_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public symbols of their own name made of all parts, with the question that asks for their file."""
    key = F.col("p_partkey")
    module = F.concat(F.lit("m"), key.cast("string"))
    name = F.concat(F.when(key % 5 == 0, "_").otherwise(""), F.lit("part"), (key % 700).cast("string"))
    symbols = table(spark, sf_dir, "part").select(F.when(key % 3 == 0, "class").otherwise("function").alias("kind"), name.alias("name"), module.alias("module"), F.when(key % 7 == 0, "Other").otherwise(module).alias("parent"), F.concat(F.lit("src/"), module, F.lit(".py")).alias("path"))
    return qa.symbol_facts(symbols).withColumn("question", qa.question(F.lit("symbol_definition"), F.col("name"), F.lit(None).cast("string"), F.col("symbol_kind")))


@register("chosen_questions")
def chosen_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 facts of three types, by quota in a seeded order, from all suppliers."""
    k = F.col("s_suppkey")
    kind = F.when(k % 3 == 0, "symbol_definition").when(k % 3 == 1, "make_target").otherwise("readme_command")
    return qa.choose(table(spark, sf_dir, "supplier").select(kind.alias("question_type"), F.col("s_name").alias("expected_answer"), F.col("s_nationkey").alias("nation")))


@register(
    "embedding_texts",
    """SELECT p_partkey, 'kind: Code, Function' || chr(10) || 'name: ' || p_name || chr(10) || 'path: src/' || p_partkey || '.py' || chr(10) || 'relative_path: ' || chr(10) || 'qualified_name: ' || p_brand || '.' || p_name || chr(10) || 'signature: ' || chr(10) || 'line_number: ' || p_partkey
  || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || '{"class_name":"' || p_brand || '","module":"m"}' ELSE chr(10) || '{"module":"m"}' END || chr(10) || 'snippet: ' || left(repeat(p_name || ' ', 60), 800) AS code,
  'kind: Entity' || chr(10) || 'name: ' || p_name || chr(10) || 'summary: ' || p_brand || chr(10) || 'source_description: ' || chr(10) || 'content: ' || left(repeat(p_name || ' ', 200), 2000) || chr(10) || 'attributes: {"a":"' || p_partkey || '","b":"' || p_brand || '"}' AS graph FROM part""",
)
def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts as code nodes and as graph nodes, as the text that is embedded."""
    key, name, brand = F.col("p_partkey").cast("string"), F.col("p_name"), F.col("p_brand")
    props = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v)])
    code = props(name=name, path=F.concat(F.lit("src/"), key, F.lit(".py")), full_name=F.concat_ws(".", brand, name), line_number=key, class_name=F.when(F.col("p_partkey") % 2 == 0, brand).otherwise(""), module=F.lit("m"), source=F.repeat(F.concat(name, F.lit(" ")), 60))
    node = props(name=name, summary=brand, content=F.repeat(F.concat(name, F.lit(" ")), 200), b=brand, a=key, created_at=F.lit("now"), empty=F.lit(""))
    return table(spark, sf_dir, "part").select("p_partkey", episodes.code_text(F.array(F.lit("Code"), F.lit("Function")), code).alias("code"), episodes.graph_text(F.array(F.lit("Entity")), node).alias("graph"))


@register(
    "repaired_payloads",
    """SELECT 'u' || user_id AS source_entity_name, event_type AS target_entity_name, CASE event_id % 3 WHEN 0 THEN 'DID' WHEN 1 THEN 'HAS_DONE' ELSE 'IS_A_FAN_OF' END AS relation_type,
  CASE event_id % 3 WHEN 0 THEN 'u' || user_id || ' did ' || event_type WHEN 1 THEN 'fact ' || event_id ELSE 'summary ' || event_id END AS fact FROM events""",
)
def repaired_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as a model's answers under three sets of names, brought to one."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    user, what, number = F.concat(F.lit("u"), F.col("user_id").cast("string")), F.col("event_type"), k.cast("string")
    json = lambda **kv: F.to_json(F.struct(*[v.alias(name) for name, v in kv.items()]))
    one = json(subject=user, object=what, predicate=F.lit("did"))
    two = json(source=user, target=what, relation=F.lit("has done"), description=F.concat(F.lit("fact "), number))
    three = json(**{"from": user, "to": what, "edge_type": F.lit("--is a fan-of "), "summary": F.concat(F.lit(" summary "), number)})
    return episodes.repaired_edges(e.select(F.when(k % 3 == 0, one).when(k % 3 == 1, two).otherwise(three).alias("item")))


@register(
    "attached_notebooks",
    """WITH n AS (SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN CAST(conv_id AS VARCHAR) WHEN 1 THEN conv_id || '_' || turn ELSE 'nb' || turn END || CASE WHEN conv_id % 3 = 0 AND turn > 0 THEN '-' || turn ELSE '' END AS notebook_id FROM conversations)
SELECT notebook_id, CAST(doc_id AS VARCHAR) AS paper_id FROM (SELECT notebook_id, min(CASE WHEN conv_id % 3 < 2 THEN conv_id END) AS conv_id FROM n GROUP BY notebook_id) LEFT JOIN documents ON doc_id = conv_id""",
)
def attached_notebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notebooks named after turns, attached to the document whose id theirs is or begins with."""
    c, conv, turn = table(spark, sf_dir, "conversations"), F.col("conv_id"), F.col("turn").cast("string")
    id_ = F.when(conv % 3 == 0, F.concat(conv.cast("string"), F.when(F.col("turn") > 0, F.concat(F.lit("-"), turn)).otherwise(""))).when(conv % 3 == 1, F.concat_ws("_", conv.cast("string"), turn)).otherwise(F.concat(F.lit("nb"), turn))
    papers = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("paper_id"))
    rows = c.select(id_.alias("notebook_id")).distinct().withColumn("path", F.concat(F.lit("work/"), "notebook_id", F.lit(".ipynb")))
    return notebooks.attach(rows, papers)
