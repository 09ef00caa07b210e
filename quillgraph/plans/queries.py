"""Registered queries of the engine's operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ranking, text
from ..operators import bench, capabilities, context, enrich, graph, identity, layout, links, memory, qa, registry, search, stats, tabular
from ..operators.matching import running_sum
from ..operators.storage import spread
from ..sources import markdown
from ..streaming import pipelines
from .hosts import ASCII_LOWER, EDGES_SQL, LINES_SQL, NODES_SQL, graph_edges, graph_nodes, papers, table
from .registry import register

QUERY = "license"
TERMS = ("license", "idiot", "secret")
_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
_TOKENS_SQL = f"""(SELECT doc_id AS id, t AS token FROM (SELECT doc_id, unnest(list_distinct(regexp_split_to_array({ASCII_LOWER.format("coalesce(text, '')")}, '[^A-Za-z0-9]+'))) AS t FROM documents)
  WHERE length(t) >= 4 AND NOT regexp_matches(t, '^[0-9]+$') AND t NOT IN ({_STOP}))"""


def _snippet_sql(c: str) -> str:
    return f"CASE WHEN length({c}) > 160 THEN left({c}, 160) || '...' ELSE {c} END"


_SQUEEZE = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


@register(
    "doc_search",
    rf"""
WITH d AS (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS l, left(coalesce(text, ''), 400) AS abstract FROM documents),
f AS (
  SELECT doc_id, 1 AS ord, 'title' AS field, 120 AS w, l[1] AS v FROM d UNION ALL SELECT doc_id, 2, 'paper_id', 110, coalesce(source, '') FROM d
  UNION ALL SELECT doc_id, 3, 'abstract', 50, abstract FROM d
  UNION ALL SELECT doc_id, 4 + i, 'section_content', 20, v FROM (SELECT doc_id, unnest(l) AS v, unnest(range(len(l))) AS i FROM d)),
h AS (SELECT *, list_filter(list_transform(string_split(v, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND contains(lower(x), '{QUERY}'))[1] AS hit FROM f WHERE contains(lower(v), '{QUERY}')),
s AS (
  SELECT doc_id, CAST(sum(w) AS BIGINT) AS score, string_agg(DISTINCT field, ',' ORDER BY field) AS matched_fields, arg_min(coalesce(hit, v), ord) AS sn FROM h GROUP BY doc_id)
SELECT doc_id, score, matched_fields, {_snippet_sql(_SQUEEZE.format("sn"))} AS snippet, (SELECT count(*) FROM s) AS total, (SELECT count(*) FROM s) > 20 AS has_more
FROM s ORDER BY score DESC, doc_id LIMIT 20""",
)
def doc_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_documents(papers(spark, sf_dir), QUERY, {"title": "title", "paper_id": "source", "abstract": "abstract"}, {"section_content": "lines"})


_NODE_TEXT = "lower(coalesce({0}, ''))"


_TIERS = {"Brand#1*": 1.5, "*3": 1.2, "Brand#2*": 0.5}


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("path"), F.col("p_type").alias("description"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("search_text"), (F.col("p_partkey") % 90).alias("age_days"), ranking.authority("p_brand", _TIERS).alias("authority"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("title"), F.lit(None).cast("string").alias("path"), F.lit("").alias("description"), F.col("s_name").alias("search_text"), (F.col("s_suppkey") % 90).alias("age_days"), F.lit(1.0).alias("authority"))
    return p.unionByName(s)


_NODE_QUERY = "brand steel"
_NODES_SEARCH_SQL = """(SELECT 'part:' || p_partkey AS id, p_name AS title, p_brand AS path, p_type AS description, concat_ws(' ', p_name, p_brand, p_type) AS search_text, p_partkey % 90 AS age_days, CASE WHEN p_brand LIKE 'Brand#1%' THEN 1.5 WHEN p_brand LIKE '%3' THEN 1.2 WHEN p_brand LIKE 'Brand#2%' THEN 0.5 ELSE 1.0 END AS authority FROM part
  UNION ALL SELECT 'supplier:' || s_suppkey, s_name, NULL, '', s_name, s_suppkey % 90, 1.0 FROM supplier)"""


def _node_score_sql(q: str) -> tuple[str, str]:
    score, field = [], "'search_text'"
    for name, (whole, each) in ranking.NODE_WEIGHTS.items():
        t = _NODE_TEXT.format(name)
        exact = f"WHEN {t} = '{q}' THEN 1000 " if name == "title" else ""
        score.append(f"CASE {exact}WHEN contains({t}, '{q}') THEN {whole} ELSE 0 END")
        score += [f"CASE WHEN contains({t}, '{x}') THEN {each} ELSE 0 END" for x in q.split()]
        if name != "search_text":
            field = f"CASE WHEN contains({t}, '{q}') THEN '{name}' ELSE {field} END"
    return " + ".join(score), field


_SCORE_SQL, _FIELD_SQL = _node_score_sql(_NODE_QUERY)


@register(
    "graph_search",
    f"""WITH h AS (SELECT id, title, CAST({_SCORE_SQL} AS BIGINT) AS lexical, {_FIELD_SQL} AS matched_field FROM {_NODES_SEARCH_SQL})
SELECT id, title, lexical, matched_field, CAST(lexical AS DOUBLE) AS score FROM h WHERE lexical > 0 ORDER BY lexical DESC, title, id LIMIT 24""",
)
def graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_nodes(_nodes(spark, sf_dir).drop("authority", "age_days"), _NODE_QUERY).withColumn("score", F.col("score").cast("double"))


@register(
    "graph_search_weighted",
    f"""WITH h AS (SELECT id, title, CAST({_SCORE_SQL} AS BIGINT) AS lexical, {_FIELD_SQL} AS matched_field, authority, greatest(0.1, least(1.0, power(0.5, age_days / 30.0))) AS fresh FROM {_NODES_SEARCH_SQL}),
r AS (SELECT id, title, lexical, matched_field, CAST(lexical AS FLOAT) * CAST(authority AS FLOAT) * CAST(fresh AS FLOAT) AS s FROM h WHERE lexical > 0)
SELECT id, title, lexical, matched_field, round(CAST(s AS DOUBLE), 3) AS score FROM r ORDER BY s DESC, title, id LIMIT 24""",
)
def graph_search_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_nodes(_nodes(spark, sf_dir), _NODE_QUERY).withColumn("score", F.round(F.col("score").cast("double"), 3))


@register(
    "corpus_stats",
    """SELECT count(*) AS papers, count(l.doc_id) AS labelled, count(*) FILTER (text IS NOT NULL AND text <> '') AS parsed, count(*) FILTER (quality = 1) AS good,
  CAST(sum(len(string_split(coalesce(text, ''), chr(10)))) AS BIGINT) AS sections, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars, count(DISTINCT source) AS sources
FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = papers(spark, sf_dir).join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l_id"), "quality"), F.col("doc_id") == F.col("l_id"), "left")
    return p.agg(
        F.count(F.lit(1)).alias("papers"), F.count("l_id").alias("labelled"), F.count_if(F.col("text") != "").alias("parsed"), F.count_if(F.col("quality") == 1).alias("good"),
        F.sum(F.size("lines")).cast("long").alias("sections"), F.sum(F.length(F.coalesce("text", F.lit("")))).cast("long").alias("chars"), F.count_distinct("source").alias("sources"),
    )


@register("group_counts", "SELECT source, lang, count(*) AS n, CAST(grouping(source) AS BIGINT) AS by_lang FROM documents GROUP BY GROUPING SETS ((source), (lang))")
def group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.groupingSets([[F.col("source")], [F.col("lang")]], "source", "lang").agg(F.count(F.lit(1)).alias("n"), F.grouping("source").cast("long").alias("by_lang"))


@register("doc_frequency", f"SELECT token, count(*) AS df FROM {_TOKENS_SQL} GROUP BY token")
def doc_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.document_frequency(_tokens(spark, sf_dir))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.document_tokens(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "text")


def _token_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.document_token_lists(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "text")


_PAIRS_SQL = f"""
t AS (SELECT * FROM {_TOKENS_SQL}), df AS (SELECT token, count(*) AS df FROM t GROUP BY token), n AS (SELECT count(DISTINCT id) AS n FROM t),
k AS (SELECT t.id, t.token, df FROM t JOIN df USING (token), n WHERE n < 4 OR 2 * df <= n), w AS (SELECT id, sum(1.0::DOUBLE / df) AS w FROM k GROUP BY id),
p AS (SELECT a.id AS source, b.id AS target, sum(1.0::DOUBLE / a.df) AS sh, count(*) AS shared, array_to_string(list_slice(list(a.token ORDER BY a.df, a.token), 1, 5), ',') AS evidence
  FROM k a JOIN k b ON a.token = b.token AND a.id < b.id GROUP BY ALL HAVING count(*) >= 2),
pairs AS (SELECT source, target, round(sh / (x.w + y.w - sh), 6) AS score, shared, evidence FROM p JOIN w x ON x.id = source JOIN w y ON y.id = target WHERE round(sh / (x.w + y.w - sh), 6) >= 0.18)"""


@register("topic_pairs", f"WITH {_PAIRS_SQL} SELECT * FROM pairs")
def topic_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.topic_pairs(_token_lists(spark, sf_dir))


_GREEDY_SQL = f"""WITH RECURSIVE {_PAIRS_SQL}, o AS (SELECT *, row_number() OVER (ORDER BY score DESC, CAST(source AS VARCHAR), CAST(target AS VARCHAR)) AS n FROM pairs),
g(n, ends, fits) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), FALSE
  UNION ALL SELECT n, CASE WHEN fits THEN list_concat(ends, [source, target]) ELSE ends END, fits FROM (
    SELECT o.n, source, target, ends, len(list_filter(ends, lambda x: x = source)) < {enrich.MAX_LINKS} AND len(list_filter(ends, lambda x: x = target)) < {enrich.MAX_LINKS} AS fits FROM g JOIN o ON o.n = g.n + 1))
SELECT source, target, score, shared, evidence FROM o JOIN g USING (n) WHERE fits"""


@register("topic_links", _GREEDY_SQL)
def topic_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.topic_links(_token_lists(spark, sf_dir))


_KEY_SQL = "lower(regexp_replace({0}, '[^A-Za-z0-9]', '', 'g'))"
_TARGETS_SQL = f"""
tg AS (SELECT doc_id AS id, unnest(['key', 'doi', 'arxiv', 'title']) AS level_, unnest([nullif({_KEY_SQL.format("text")}, ''), nullif(md5(text), ''), CAST(n_chars AS VARCHAR), nullif({_KEY_SQL.format("string_split(text, chr(10))[1]")}, '')]) AS value FROM documents),
u AS (SELECT level_, value, min(id) AS target FROM tg WHERE value IS NOT NULL AND value <> '' GROUP BY 1, 2 HAVING min(id) = max(id)),
ci AS (SELECT doc_id + 1 AS source, doc_id AS pos, unnest([1, 2, 3, 4]) AS rank_, unnest(['key', 'doi', 'arxiv', 'title']) AS level_, unnest([nullif({_KEY_SQL.format("text")}, ''), md5(text), CAST(n_chars AS VARCHAR), nullif({_KEY_SQL.format("string_split(text, chr(10))[1]")}, '')]) AS value FROM documents)"""


@register(
    "citation_resolve",
    f"""WITH {_TARGETS_SQL}, f AS (SELECT source, pos, arg_min(target, rank_) AS target, arg_min(level_, rank_) AS strategy FROM ci JOIN u USING (level_, value) GROUP BY source, pos)
SELECT source, target, arg_min(strategy, pos) AS strategy, min(pos) AS pos FROM f WHERE source <> target GROUP BY source, target""",
)
def citation_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    first = F.split("text", "\n")[0]
    keys = {"key": F.nullif(text.letters_key("text"), F.lit("")), "doi": F.md5("text"), "arxiv": F.col("n_chars").cast("string"), "title": F.nullif(text.letters_key(first), F.lit(""))}
    cites = d.select((F.col("doc_id") + 1).alias("source"), F.col("doc_id").alias("pos"), *[v.alias(k) for k, v in keys.items()])
    targets = d.select(F.col("doc_id").alias("id"), F.explode(F.array(*[F.struct(F.lit(k).alias("level"), v.alias("value")) for k, v in keys.items()])).alias("x")).select("id", "x.*")
    return enrich.resolve_citations(cites, targets)


@register(
    "identity_components",
    f"""WITH RECURSIVE c AS (SELECT doc_id AS idx, md5(text) AS doi, {_KEY_SQL.format("text")} AS arxiv FROM documents),
k AS (SELECT idx, unnest(['d' || doi, 'a' || nullif(arxiv, '')]) AS key FROM c), m AS (SELECT key, min(idx) AS b FROM k WHERE key IS NOT NULL GROUP BY key HAVING count(*) > 1),
e AS (SELECT DISTINCT k.idx AS a, m.b FROM k JOIN m USING (key) WHERE k.idx <> m.b), both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT idx AS a, idx AS b FROM c UNION SELECT r.a, both_.b FROM r JOIN both_ ON r.b = both_.a),
l AS (SELECT a AS idx, min(b) AS component FROM r GROUP BY a), n AS (SELECT component, min(doi) AS d, count(*) AS size_ FROM l JOIN c USING (idx) GROUP BY component)
SELECT idx, component, 'paper:doi:' || d AS canonical_id, CASE WHEN size_ = 1 THEN 'single' ELSE 'shared_doi' END AS reason FROM l JOIN n USING (component)""",
)
def identity_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.resolve_identities(_candidates(spark, sf_dir))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("idx"), F.md5("text").alias("doi"), F.nullif(F.md5(text.letters_of_text("text")), F.md5(F.lit(""))).alias("arxiv"), F.lit(None).cast("string").alias("s2"))


@register(
    "identity_conflicts",
    f"""WITH RECURSIVE c AS (SELECT doc_id AS idx, md5(text) AS doi, {_KEY_SQL.format("text")} AS arxiv, {_KEY_SQL.format("string_split(text, chr(10))[-1]")} AS title_key FROM documents),
k AS (SELECT idx, unnest(['d' || doi, 'a' || nullif(arxiv, '')]) AS key FROM c), m AS (SELECT key, min(idx) AS b FROM k WHERE key IS NOT NULL GROUP BY key HAVING count(*) > 1),
e AS (SELECT DISTINCT k.idx AS a, m.b FROM k JOIN m USING (key) WHERE k.idx <> m.b), both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT idx AS a, idx AS b FROM c UNION SELECT r.a, both_.b FROM r JOIN both_ ON r.b = both_.a), l AS (SELECT a AS idx, min(b) AS component FROM r GROUP BY a),
t AS (SELECT component, idx, title_key, first(title_key) OVER w AS fk, first(idx) OVER w AS fi FROM l JOIN c USING (idx) WHERE title_key <> '' WINDOW w AS (PARTITION BY component ORDER BY idx))
SELECT component, min(fi) AS left_idx, min(idx) AS right_idx FROM t WHERE title_key <> fk GROUP BY component""",
)
def identity_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), text.letters_key(F.element_at(F.split("text", "\n"), -1)).alias("title_key"))
    return identity.title_conflicts(identity.resolve_identities(_candidates(spark, sf_dir)).join(d, "idx"))


@register(
    "title_conflicts",
    f"""WITH RECURSIVE c AS (SELECT doc_id AS idx, md5(text) AS doi, {_KEY_SQL.format("text")} AS arxiv, {_KEY_SQL.format("string_split(text, chr(10))[-1] || CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE '' END")} AS title_key FROM documents),
k AS (SELECT idx, unnest(['d' || doi, 'a' || nullif(arxiv, '')]) AS key FROM c), m AS (SELECT key, min(idx) AS b FROM k WHERE key IS NOT NULL GROUP BY key HAVING count(*) > 1),
e AS (SELECT DISTINCT k.idx AS a, m.b FROM k JOIN m USING (key) WHERE k.idx <> m.b), both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT idx AS a, idx AS b FROM c UNION SELECT r.a, both_.b FROM r JOIN both_ ON r.b = both_.a), l AS (SELECT a AS idx, min(b) AS component FROM r GROUP BY a),
t AS (SELECT component, idx, title_key, first(title_key) OVER w AS fk, first(idx) OVER w AS fi FROM l JOIN c USING (idx) WHERE title_key <> '' WINDOW w AS (PARTITION BY component ORDER BY idx))
SELECT component, min(fi) AS left_idx, min(idx) AS right_idx FROM t WHERE title_key <> fk GROUP BY component""",
)
def title_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of a text whose titles differ, as every third has a letter more."""
    title = F.concat(F.element_at(F.split("text", "\n"), -1), F.when(F.col("doc_id") % 3 == 0, "x").otherwise(""))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), text.letters_key(title).alias("title_key"))
    return identity.title_conflicts(identity.resolve_identities(_candidates(spark, sf_dir)).join(d, "idx"))


@register("sections_table", f"SELECT doc_id || ':section:' || (line_no - 1) AS section_id, doc_id, line_no - 1 AS section_index, length(line) AS chars FROM {LINES_SQL}")
def sections_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = stats.lines_of(table(spark, sf_dir, "documents")).withColumn("section_index", F.col("line_no") - 1)
    return lines.select(F.concat(F.col("doc_id").cast("string"), F.lit(":section:"), F.col("section_index").cast("string")).alias("section_id"), "doc_id", "section_index", F.length("line").cast("long").alias("chars"))


@register(
    "papers_table",
    """SELECT doc_id, string_split(coalesce(text, ''), chr(10))[1] AS title, CAST(len(string_split(coalesce(text, ''), chr(10))) AS BIGINT) AS section_count,
  CAST(len(regexp_extract_all(coalesce(text, ''), '@([A-Za-z][A-Za-z0-9:_-]+)', 1)) AS BIGINT) AS citation_count, CAST(coalesce(len(regexp_extract_all(text, '\\b\\d{4}\\.\\d{4,5}(?:v\\d+)?\\b')), 0) AS BIGINT) AS arxiv_count FROM documents""".replace("\\\\", "\\"),
)
def papers_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda p: F.size(text.found_all(F.coalesce("text", F.lit("")), p)).cast("long")
    return papers(spark, sf_dir).select("doc_id", "title", F.size("lines").cast("long").alias("section_count"), n(text.CITATION_KEY).alias("citation_count"), n(text.ARXIV_ID).alias("arxiv_count"))


@register("page_outline", r"SELECT page_id, unnest(range(len(h))) AS heading_index, unnest(h) AS heading FROM (SELECT page_id, regexp_extract_all(html, '<h1>([^<]*)</h1>', 1) AS h FROM pages)")
def page_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(text.found_all("html", r"<h1>([^<]*)</h1>")).alias("heading_index", "heading")).withColumn("heading_index", F.col("heading_index").cast("long"))


@register("page_links", """SELECT page_id, link, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages) GROUP BY ALL""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(text.found_all("html", 'href="([^"]*)"')).alias("link")).groupBy("page_id", "link").agg(F.count(F.lit(1)).alias("n"))


@register("transcript_turns", "SELECT conv_id || ':cell:' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS cell_id, conv_id, turn, role, length(text) AS chars FROM conversations")
def transcript_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return table(spark, sf_dir, "conversations").select(F.concat(F.col("conv_id").cast("string"), F.lit(":cell:"), n.cast("string")).alias("cell_id"), "conv_id", "turn", "role", F.length("text").cast("long").alias("chars"))


_TERMS_SQL = " OR ".join(f"contains({ASCII_LOWER.format('line')}, '{t}')" for t in TERMS)
_SPANS_SQL = f"""
ln AS (SELECT * FROM {LINES_SQL}), mx AS (SELECT doc_id, max(line_no) AS n FROM ln GROUP BY doc_id),
hit AS (SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM ln WHERE {_TERMS_SQL}),
sp AS (SELECT doc_id, greatest(1, line_no - 1) AS line_start, least(n, line_no + 1) AS line_end FROM hit JOIN mx USING (doc_id) WHERE k <= 4
  UNION ALL SELECT doc_id, 1, least(n, 6) FROM mx WHERE doc_id NOT IN (SELECT doc_id FROM hit)),
spans AS (SELECT sp.doc_id, line_start, line_end, string_agg(line, chr(10) ORDER BY line_no) AS text FROM sp JOIN ln ON ln.doc_id = sp.doc_id AND line_no BETWEEN line_start AND line_end GROUP BY ALL)"""


@register("evidence_spans", f"WITH {_SPANS_SQL} SELECT * FROM spans")
def evidence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.evidence_spans(table(spark, sf_dir, "documents"), list(TERMS))


@register(
    "budget_pack",
    f"""WITH {_SPANS_SQL}, c AS (SELECT *, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) + 8 AS cost FROM spans),
b AS (SELECT *, sum(cost) OVER w AS s, row_number() OVER w AS n FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY line_start, line_end)), m AS (SELECT *, max(s) OVER (PARTITION BY doc_id) > 200 AS truncated FROM b)
SELECT doc_id, line_start, line_end, text, CAST(cost AS BIGINT) AS cost, truncated FROM m WHERE s <= 200 OR n = 1""".replace("\\\\", "\\"),
)
def budget_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.within_budget(evidence_spans(spark, sf_dir), 200, ["line_start", "line_end"], group=["doc_id"])


@register("contamination_links", "SELECT DISTINCT d.doc_id AS id, b.item_id AS item FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def contamination_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return links.containments(d.select(F.col("doc_id").alias("id"), "text"), b.select(F.col("item_id").alias("item"), "text"))


def _with_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Each document with one item of (item_id, ...): documents are dealt by doc_id over the items in the order of their ids."""
    ranked = running_sum(items, [], ["item_id"], F.lit(1).cast("long"), "_n").withColumn("_place", F.col("_n") - 1).drop("_n")
    n = items.agg(F.count(F.lit(1)).alias("_items")).where("_items > 0")
    return docs.crossJoin(F.broadcast(n)).withColumn("_place", F.pmod("doc_id", "_items")).join(ranked, "_place").drop("_place", "_items")


_ITEMS_SQL = "items AS (SELECT item_id, text, row_number() OVER (ORDER BY item_id) - 1 AS place, count(*) OVER () AS n FROM benchmark)"


@register(
    "qa_scores",
    f"""WITH {_ITEMS_SQL}, a AS (SELECT b.item_id, d.doc_id, contains(trim(string_split(trim(d.text), chr(10))[1]), trim(string_split(trim(b.text), chr(10))[1])) AS ok FROM documents d JOIN items b ON d.doc_id % b.n = b.place)
SELECT item_id, count(*) AS questions, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6) AS exact_match FROM a GROUP BY item_id""",
)
def qa_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("accepted"))
    j = _with_items(d.select("doc_id", "text"), b)
    ok = text.answer_is_right(F.col("text"), F.array("accepted"), F.lit("text"))
    return j.groupBy("item_id").agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg(F.when(ok, 1.0).otherwise(0.0)), 6).alias("exact_match"))


@register(
    "embedding_links",
    """WITH p AS (SELECT a.vec_id AS source, b.vec_id AS target, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id)
SELECT source, target, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, target) AS r FROM p WHERE score >= 0.3) WHERE r = 1""",
)
def embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").alias("key"))
    return links.vector_links(e, e, 0.3).withColumn("score", F.round("score", 4))


_ETOK = "list_filter(list_distinct(regexp_split_to_array(lower({0}), '[^A-Za-z0-9_]+')), lambda t: length(t) >= 3 OR t IN ('kg', 'tex', 'bib'))"


@register(
    "token_hint_links",
    f"""WITH a AS (SELECT item_id AS source, unnest({_ETOK.format("text")}) AS t FROM benchmark), b AS (SELECT p_partkey AS target, unnest({_ETOK.format("concat_ws(' ', p_name, p_type, 'the and')")}) AS t FROM part),
p AS (SELECT source, target, count(*) AS shared FROM a JOIN b USING (t) GROUP BY ALL HAVING count(*) >= 2)
SELECT source, target, shared FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY shared DESC, target) AS r FROM p) WHERE r <= 2""",
)
def token_hint_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), text.embedding_tokens("text").alias("tokens"))
    b = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.embedding_tokens(F.concat_ws(" ", "p_name", "p_type", F.lit("the and"))).alias("tokens"), F.lit(0).alias("rank"))
    return links.word_hints(a, b)


@register(
    "common_tokens",
    f"""WITH a AS (SELECT t AS token, count(*) AS left_hits FROM (SELECT unnest({_ETOK.format("text")}) AS t FROM benchmark) GROUP BY t), b AS (SELECT t AS token, count(*) AS right_hits FROM (SELECT unnest({_ETOK.format("text")}) AS t FROM conversations) GROUP BY t),
c AS (SELECT coalesce(a.token, b.token) AS token, coalesce(left_hits, 0) AS left_hits, coalesce(right_hits, 0) AS right_hits FROM a FULL JOIN b ON a.token = b.token)
SELECT token, left_hits, right_hits, left_hits + right_hits AS total_hits FROM c WHERE left_hits + right_hits >= 3 ORDER BY total_hits DESC, token LIMIT 96""",
)
def common_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = lambda name: table(spark, sf_dir, name).select(text.embedding_tokens("text").alias("tokens"))
    return links.common_tokens(tokens("benchmark"), tokens("conversations"))


@register("graph_nodes", f"SELECT id, label, title FROM {NODES_SQL}")
def graph_nodes_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.union_nodes(graph_nodes(spark, sf_dir))


@register("graph_edges", f"SELECT source, rel_type, target, count(*) AS n FROM {EDGES_SQL} GROUP BY ALL")
def graph_edges_(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = graph.live_edges(graph_edges(spark, sf_dir), graph.union_nodes(graph_nodes(spark, sf_dir)))
    return e.groupBy("source", "rel_type", "target").agg(F.count(F.lit(1)).alias("n"))


@register("degree", f"SELECT n.id, (SELECT count(*) FROM {EDGES_SQL} e WHERE e.target = n.id) AS in_degree, (SELECT count(*) FROM {EDGES_SQL} e WHERE e.source = n.id) AS out_degree FROM {NODES_SQL} n")
def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(graph.union_nodes(graph_nodes(spark, sf_dir)), graph_edges(spark, sf_dir))


@register("modality_counts", f"SELECT CASE label WHEN 'part' THEN 'code' WHEN 'supplier' THEN 'literature' WHEN 'order' THEN 'backlog' WHEN 'customer' THEN 'memory' ELSE 'docs' END AS modality, count(*) AS n FROM {NODES_SQL} GROUP BY 1")
def modality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.create_map(*map(F.lit, ("part", "CodeSymbol", "supplier", "Paper", "order", "AgentBacklogIssue", "customer", "ProjectMemory")))
    n = graph.union_nodes(graph_nodes(spark, sf_dir)).withColumn("labels", F.array(F.coalesce(named[F.col("label")], F.lit("Node")))).withColumn("props", F.create_map(F.lit("name"), "title"))
    return n.groupBy(ranking.modality("labels", "props").alias("modality")).agg(F.count(F.lit(1)).alias("n"))


@register("dangling_edges", "SELECT 'order:' || l_orderkey AS source, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 0) GROUP BY 1")
def dangling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("source"))
    known = table(spark, sf_dir, "orders").where("o_orderkey % 4 = 0").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("source"))
    return e.join(known, "source", "left_anti").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@register(
    "bfs_k",
    f"""WITH RECURSIVE e AS (SELECT source AS a, target AS b FROM {EDGES_SQL} UNION SELECT target, source FROM {EDGES_SQL}),
r AS (SELECT 'nation:3' AS id, 0 AS distance UNION SELECT e.b, r.distance + 1 FROM r JOIN e ON e.a = r.id WHERE r.distance < 2)
SELECT id, CAST(min(distance) AS INTEGER) AS distance FROM r GROUP BY id""",
)
def bfs_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighborhood(graph_edges(spark, sf_dir), spark.range(1).select(F.lit("nation:3").alias("id")), 2)


@register(
    "neighbors",
    f"""WITH e AS (SELECT * FROM {EDGES_SQL}), n AS (SELECT * FROM {NODES_SQL})
SELECT n.id, rel_type, 'out' AS direction, title FROM e JOIN n ON n.id = target WHERE source = 'order:1' UNION ALL SELECT n.id, rel_type, 'in', title FROM e JOIN n ON n.id = source WHERE target = 'order:1'""",
)
def neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbors(graph_edges(spark, sf_dir), graph.union_nodes(graph_nodes(spark, sf_dir)), "order:1").select("id", "rel_type", "direction", "title")


_SPAN = 5


@register(
    "span_lookup",
    f"""WITH h AS (SELECT 'docs/' || doc_id || '.md' AS path, doc_id, line_no AS line FROM {LINES_SQL} WHERE contains(lower(line), '{QUERY}')),
n AS (SELECT DISTINCT doc_id, (line_no - 1) // {_SPAN} AS k FROM {LINES_SQL}),
c AS (SELECT doc_id, max(line_no) AS lines FROM {LINES_SQL} GROUP BY doc_id)
SELECT path, line, CASE WHEN lines <= {_SPAN} THEN 'file:' || doc_id ELSE 'span:' || doc_id || ':' || k END AS id, CASE WHEN lines <= {_SPAN} THEN 'file' ELSE 'part ' || k END AS title
FROM h JOIN n USING (doc_id) JOIN c USING (doc_id) WHERE (line - 1) // {_SPAN} = k""",
)
def span_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line that has the query, and the narrowest node of its file: files have a node, and so have every five lines."""
    d = table(spark, sf_dir, "documents")
    path, n = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")), F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
    hits = stats.lines_of(d).where(F.contains(F.lower("line"), F.lit(QUERY))).select(path.alias("path"), F.col("line_no").alias("line"))
    whole = d.select(F.concat(F.lit("file:"), F.col("doc_id").cast("string")).alias("id"), F.lit("file").alias("title"), path.alias("path"), F.lit(1).cast("long").alias("line_start"), n.cast("long").alias("line_end"))
    k = F.explode(F.sequence(F.lit(0), F.floor((n - 1) / _SPAN).cast("int"))).alias("k")
    spans = d.select("doc_id", path.alias("path"), n.alias("n"), k).select(
        F.concat(F.lit("span:"), F.col("doc_id").cast("string"), F.lit(":"), F.col("k").cast("string")).alias("id"), F.concat(F.lit("part "), F.col("k").cast("string")).alias("title"), "path",
        (F.col("k") * _SPAN + 1).cast("long").alias("line_start"), F.least(F.col("n"), F.col("k") * _SPAN + _SPAN).cast("long").alias("line_end"),
    )
    return search.best_nodes_for_lines(hits, whole.unionByName(spans))


@register(
    "threshold_promotion",
    """WITH s AS (SELECT user_id AS run_id, event_type AS benchmark_id, event_type AS metric, max(value) AS value FROM events GROUP BY ALL),
r AS (SELECT * FROM (VALUES ('purchase', '>=', 200.0), ('click', '<', 50.0), ('view', '>', 400.0)) t(metric, op, lim))
SELECT run_id, benchmark_id, string_agg(DISTINCT s.metric || op || lim, ',' ORDER BY s.metric || op || lim) AS reasons FROM (SELECT run_id, benchmark_id, metric, value FROM s) s JOIN (SELECT metric, op, CAST(lim AS DOUBLE) AS lim FROM r) r USING (metric)
WHERE CASE op WHEN '<' THEN value < lim WHEN '>' THEN value > lim ELSE value >= lim END GROUP BY ALL""",
)
def threshold_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run_id"), F.col("event_type").alias("benchmark_id")).agg(F.max("value").alias("value"))
    rules = spark.createDataFrame([bench.parse_threshold(r) for r in ("purchase>=200", "click<50", "view>400")], "metric string, op string, limit double")
    return bench.promoted_runs(s.withColumn("metric", F.col("benchmark_id")).withColumn("status", F.lit("completed")), rules, statuses=["completed"])


@register(
    "catalog_violations",
    """SELECT 'duplicate_line' AS violation, l_orderkey || ':' || l_linenumber AS key, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'unknown_customer', CAST(o_custkey AS VARCHAR), count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0) GROUP BY o_custkey""",
)
def catalog_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    twice = bench.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], "line")
    lost = bench.missing_references(table(spark, sf_dir, "orders"), "o_custkey", table(spark, sf_dir, "customer").where("c_custkey % 10 <> 0"), "c_custkey", "customer")
    return twice.unionByName(lost)


@register(
    "support_status",
    """WITH r AS (SELECT event_type AS benchmark_id, count(*) AS runs FROM events GROUP BY 1), b AS (SELECT DISTINCT event_type AS benchmark_id FROM events UNION SELECT 'unused')
SELECT b.benchmark_id, CASE WHEN b.benchmark_id IN ('click', 'view') THEN 'ready' WHEN b.benchmark_id = 'purchase' THEN 'blocked' ELSE 'unconfigured' END AS status, CASE WHEN b.benchmark_id = 'purchase' THEN 'docker,uv' ELSE '' END AS missing, coalesce(runs, 0) AS runs FROM b LEFT JOIN r USING (benchmark_id)""",
)
def support_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").select(F.col("event_type").alias("benchmark_id"))
    b = runs.distinct().unionByName(spark.range(1).select(F.lit("unused").alias("benchmark_id")))
    i = spark.createDataFrame([("click", ["git"]), ("view", ["git", "python"]), ("purchase", ["uv", "docker", "git"])], "benchmark_id string, tools array<string>")
    return bench.support_status(b, i, runs, ["git", "python"])


@register("unique_names", "SELECT p_name AS name, CASE WHEN min(p_partkey) = max(p_partkey) THEN min(p_partkey) END AS target FROM part GROUP BY p_name")
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.named_once(table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("id")))


@register(
    "relation_evidence",
    """WITH c AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '@([A-Za-z][A-Za-z0-9:_-]+)', 1))) AS raw, true AS is_key FROM documents
  UNION ALL SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\\b(\\d{4}\\.\\d{4,5}(?:v\\d+)?)\\b', 1))), false FROM documents),
p AS (SELECT min(s_suppkey) AS k, 'example' || (s_suppkey % 7) AS citation_key FROM supplier GROUP BY 2),
r AS (SELECT doc_id, CASE WHEN is_key THEN '@' || raw ELSE raw END AS shown, CASE WHEN k IS NOT NULL THEN 'paper:s' || k ELSE 'paper_surface:ref:' || CASE WHEN is_key THEN '@' || raw ELSE raw END END AS target, k IS NOT NULL AS is_paper FROM c LEFT JOIN p ON is_key AND raw = citation_key)
SELECT 'doc:' || doc_id AS source, target, 'RELATES_TO' AS relation, CASE WHEN is_paper THEN 'paper' ELSE 'paper_surface' END AS target_kind, string_agg(DISTINCT shown, '|' ORDER BY shown) AS evidence FROM r GROUP BY ALL""".replace("\\\\", "\\"),
)
def relation_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of all documents as notes, with what their whole texts refer to (the tables' texts have no links and code spans)."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("node_id"), "text")
    found = markdown.reference_candidates(d.select(F.col("node_id").alias("path"), F.lit("").alias("section"), "text")).select(F.col("path").alias("node_id"), "raw", "kind")
    s = F.col("s_suppkey")
    known = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), s.cast("string")).alias("paper_id"), F.concat(F.lit("example"), (s % 7).cast("string")).alias("citation_key"), s)
    known = known.groupBy("citation_key").agg(F.min_by("paper_id", "s_suppkey").alias("paper_id")).withColumns({c: F.lit(None).cast("string") for c in ("arxiv_id", "stem")})
    return memory.relations(d.select("node_id", F.lit("note").alias("kind")), memory.resolve(found, known))


@register(
    "backlog_rank",
    """WITH r AS (SELECT o_orderkey, CASE substr(o_orderpriority, 3) WHEN 'URGENT' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END AS p FROM orders WHERE o_orderstatus IS DISTINCT FROM 'F')
SELECT o_orderkey, rank FROM (SELECT o_orderkey, row_number() OVER (ORDER BY p, o_orderkey) AS rank FROM r) WHERE rank <= 100""",
)
def backlog_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.substring("o_orderpriority", F.lit(3), F.length("o_orderpriority"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("status"), F.when(word == "URGENT", "critical").otherwise(F.lower(word)).alias("priority"))
    top = memory.open_backlog(rows).limit(100)
    return top.select(F.col("id").alias("o_orderkey"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("rank", "id")).cast("long").alias("rank"))


@register(
    "loc_stats",
    f"""SELECT source, count(DISTINCT doc_id) AS files, count(*) AS total, count(*) FILTER (trim(line) <> '') AS non_empty, count(*) FILTER (regexp_matches(line, '^\\s*(#|//)')) AS comments,
  count(*) FILTER (regexp_matches(line, '(?i)todo')) AS todo, count(*) FILTER (regexp_matches(line, '(?i)fixme')) AS fixme,
  greatest(0, count(*) FILTER (trim(line) <> '') - count(*) FILTER (regexp_matches(line, '^\\s*(#|//)'))) AS code FROM {LINES_SQL} JOIN (SELECT doc_id, source FROM documents) USING (doc_id) GROUP BY source""".replace("\\\\", "\\"),
)
def loc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.line_stats(table(spark, sf_dir, "documents"), "source")


@register("markers", f"SELECT doc_id, line_no, kind FROM {LINES_SQL}, (VALUES ('license'), ('ssn')) k(kind) WHERE contains(lower(line), kind)")
def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.markers(table(spark, sf_dir, "documents"), ("license", "ssn"))


@register(
    "normalizers",
    f"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10))[1] AS t FROM documents)
SELECT doc_id, trim({ASCII_LOWER.format("regexp_replace(t, '[^A-Za-z0-9]+', '-', 'g')")}, '-') AS slug, {_KEY_SQL.format("t")} AS title_key, CASE WHEN length({_KEY_SQL.format("t")}) >= 12 THEN {_KEY_SQL.format("t")} END AS long_key,
  trim(regexp_replace(t, '\\s+', ' ', 'g')) AS squeezed, CASE WHEN length(t) > 20 THEN left(t, 20) || '...' ELSE t END AS dots, CASE WHEN length(t) > 20 THEN left(t, 19) || '…' ELSE t END AS ellipsis,
  CASE WHEN contains(t, ':') THEN string_split(t, ':')[1] ELSE 'raw' END AS kind FROM d""".replace("\\\\", "\\"),
)
def normalizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = papers(spark, sf_dir)
    return p.select("doc_id", text.slugify("title").alias("slug"), text.letters_key("title").alias("title_key"), text.long_key("title", 12).alias("long_key"), text.squeeze("title").alias("squeezed"), text.clip_dots("title", 20).alias("dots"), text.clip_ellipsis("title", 20).alias("ellipsis"), text.reference_kind("title").alias("kind"))


@register(
    "stale_outputs",
    """WITH i AS (SELECT event_type AS name, max(epoch_us(ts)) AS newest FROM events WHERE user_id % 2 = 0 GROUP BY 1), o AS (SELECT event_type AS name, min(epoch_us(ts)) AS oldest FROM events WHERE user_id % 2 = 1 AND event_type <> 'view' GROUP BY 1)
SELECT name, coalesce(newest > oldest, TRUE) AS stale FROM i LEFT JOIN o USING (name)""",
)
def stale_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.col("ts").alias("mtime"), "user_id")
    return stats.stale_outputs(e.where("user_id % 2 = 0"), e.where("user_id % 2 = 1 and name <> 'view'"))


@register(
    "validators",
    """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'doc ' || doc_id ELSE 'doc:' || doc_id END AS id, doc_id % 3 / 1.5 AS confidence, doc_id % 11 = 0 AS no_label, doc_id % 13 = 0 AS no_source FROM documents)
SELECT id, 'id' AS violation FROM d WHERE doc_id % 7 = 0 UNION ALL SELECT id, 'label' FROM d WHERE no_label UNION ALL SELECT id, 'provenance' FROM d WHERE no_source UNION ALL SELECT id, 'confidence' FROM d WHERE confidence > 1""",
)
def validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(
        F.concat(F.when(i % 7 == 0, "doc ").otherwise("doc:"), i.cast("string")).alias("id"), F.when(i % 11 == 0, " ").otherwise("Paper").alias("label"),
        F.when(i % 13 == 0, F.array().cast("array<string>")).otherwise(F.array("source")).alias("provenance"), F.lit("1").alias("schema_version"), (i % 3 / 1.5).alias("confidence"),
    )
    return bench.record_violations(rows)


@register(
    "context_papers",
    """WITH a AS (SELECT source AS id, n_chars AS score, doc_id FROM documents), o AS (SELECT *, lag(id) OVER (ORDER BY score DESC, doc_id) AS b FROM a)
SELECT id, score, doc_id FROM o WHERE id IS DISTINCT FROM b ORDER BY score DESC, doc_id LIMIT 5""",
)
def context_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("id"), F.col("n_chars").alias("score"), "doc_id")
    return context.adjacent_distinct(d, "id", [F.desc("score"), F.col("doc_id")], 5)


_ARXIV_SQL = "'2401.' || lpad(CAST(doc_id AS VARCHAR), 8, '0')"
_MERGE_SQL = f"""WITH RECURSIVE p AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10))[1] AS title FROM documents),
m AS (SELECT {_ARXIV_SQL} AS m_id, title AS m_title, 'tex-' || doc_id AS tex_dir, CASE WHEN quality = 1 THEN doc_id || '.pdf' END AS pdf_file, {_KEY_SQL.format("title")} AS k FROM p JOIN labels USING (doc_id)),
b AS (SELECT doc_id AS pos, 'key' || doc_id AS citation_key, CASE WHEN doc_id % 2 = 0 THEN {_ARXIV_SQL} END AS eprint, title, {_KEY_SQL.format("title")} AS k FROM p WHERE doc_id % 3 <> 0),
direct AS (SELECT pos, m_id FROM b JOIN m ON eprint = m_id), waits AS (SELECT k, pos, row_number() OVER (PARTITION BY k ORDER BY pos) AS place FROM b WHERE k <> '' AND pos NOT IN (SELECT pos FROM direct)),
records AS (SELECT k, m_id, since, row_number() OVER (PARTITION BY k ORDER BY m_id) AS j FROM m LEFT JOIN (SELECT m_id, min(pos) AS since FROM direct GROUP BY m_id) USING (m_id) WHERE k <> ''),
reach AS (SELECT r.k, r.m_id, r.j, count(w.pos) FILTER (r.since IS NULL OR w.pos <= r.since) AS q FROM records r LEFT JOIN waits w ON w.k = r.k GROUP BY r.k, r.m_id, r.j),
walk(k, j, m_id, place, taken) AS (SELECT DISTINCT k, CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(0 AS BIGINT) FROM records
  UNION ALL SELECT w.k, r.j, r.m_id, CASE WHEN taken < q THEN taken + 1 END, taken + CASE WHEN taken < q THEN 1 ELSE 0 END FROM walk w JOIN reach r ON r.k = w.k AND r.j = w.j + 1),
chosen AS (SELECT w.pos, coalesce(t.m_id, f.m_id) AS m_id FROM waits w JOIN records f ON f.k = w.k AND f.j = 1 LEFT JOIN walk t ON t.k = w.k AND t.place = w.place),
match_ AS (SELECT * FROM direct UNION ALL SELECT * FROM chosen)
SELECT citation_key AS paper_id, citation_key, title, coalesce(x.m_id, eprint) AS arxiv_id, CAST(NULL AS VARCHAR) AS doi, 'https://arxiv.org/e-print/' || x.m_id AS url, tex_dir, pdf_file,
  CASE WHEN x.m_id IS NULL THEN 'bib' ELSE 'manifest_and_bib' END AS source_kind, CASE WHEN x.m_id IS NULL THEN 'metadata_only' WHEN pdf_file IS NOT NULL THEN 'manifest_source_plus_pdf' ELSE 'manifest_source' END AS download_mode,
  CASE WHEN x.m_id IS NULL THEN 'metadata_only' ELSE 'pending_download' END AS parse_status
FROM b LEFT JOIN match_ x USING (pos) LEFT JOIN m ON m.m_id = x.m_id
UNION ALL SELECT 'arxiv-' || replace(m_id, '.', '-'), NULL, m_title, m_id, NULL, CASE WHEN pdf_file IS NULL THEN 'https://arxiv.org/e-print/' || m_id ELSE 'https://arxiv.org/pdf/' || m_id || '.pdf' END, tex_dir, pdf_file, 'manifest',
  CASE WHEN pdf_file IS NULL THEN 'manifest_source' ELSE 'manifest_source_plus_pdf' END, 'pending_download' FROM m WHERE m_id NOT IN (SELECT m_id FROM match_)"""


@register("registry_merge", _MERGE_SQL)
def registry_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = papers(spark, sf_dir)
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    manifest = p.join(lab, "doc_id").select(F.col("doc_id").alias("pos"), F.concat(F.lit("2401."), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("arxiv_id"), "title", F.concat(F.lit("tex-"), F.col("doc_id").cast("string")).alias("tex_dir"), F.when(F.col("quality") == 1, F.concat(F.col("doc_id").cast("string"), F.lit(".pdf"))).alias("pdf_file"))
    bib = p.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("pos"), F.concat(F.lit("key"), F.col("doc_id").cast("string")).alias("citation_key"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("2401."), F.lpad(F.col("doc_id").cast("string"), 8, "0"))).alias("eprint"), "title", F.lit(None).cast("string").alias("doi"), F.lit(None).cast("string").alias("url"))
    return registry.merge_sources(manifest, bib)


@register(
    "best_match",
    """WITH p AS (SELECT doc_id AS id, CAST(doc_id % 500 AS VARCHAR) AS citation_key, md5(text) AS arxiv_id, text <> '' AS structured, n_chars AS richness FROM documents), r AS (SELECT doc_id AS id, CAST(doc_id AS VARCHAR) AS citation_key, md5(text) AS arxiv_id FROM documents),
j AS (SELECT r.id AS record_id, p.id AS parsed_id, structured, richness, r.id = p.id AS a, coalesce(r.citation_key = p.citation_key, FALSE) AS b, coalesce(r.arxiv_id = p.arxiv_id, FALSE) AS c FROM r JOIN p ON r.id = p.id OR r.citation_key = p.citation_key OR r.arxiv_id = p.arxiv_id),
k AS (SELECT *, rank() OVER (PARTITION BY record_id ORDER BY structured DESC, richness DESC, a DESC, b DESC, c DESC) AS n FROM j)
SELECT CAST(record_id AS VARCHAR) AS record_id, CAST(min(parsed_id) AS VARCHAR) AS parsed_id FROM k WHERE n = 1 GROUP BY record_id HAVING min(parsed_id) = max(parsed_id)""",
)
def best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    parsed = d.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 500).cast("string").alias("citation_key"), F.md5("text").alias("arxiv_id"), (F.col("text") != "").alias("structured"), F.col("n_chars").alias("richness"))
    records = d.select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("citation_key"), F.md5("text").alias("arxiv_id"))
    return registry.best_matches(records, parsed)


@register(
    "corpus_capability",
    """WITH r AS (SELECT count(*) AS records, count(*) FILTER (doc_id % 2 = 0) AS arxiv_records, count(*) FILTER (doc_id % 6 = 0) AS local_tex, count(*) FILTER (doc_id % 4 = 0) AS expected_pdfs, count(l_id) AS enriched FROM documents LEFT JOIN (SELECT doc_id AS l_id FROM labels) ON doc_id = l_id),
p AS (SELECT count(*) AS parsed FROM documents WHERE doc_id % 5 = 0)
SELECT *, 'stale' AS download_state, 'stale' AS parse_state, 'stale' AS enrich_state, 'download,parse,build,enrich' AS next_steps FROM r, p""",
)
def corpus_capability(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l_id"))
    r = d.join(lab, i == F.col("l_id"), "left").select(F.when(i % 2 == 0, i.cast("string")).alias("arxiv_id"), (i % 6 == 0).alias("has_local_tex"), F.when(i % 4 == 0, "x.pdf").alias("pdf_file"), F.col("l_id").isNotNull().alias("enriched"))
    return capabilities.corpus_capability(r, d.where("doc_id % 5 = 0"))


@register(
    "component_selection",
    """WITH t AS (SELECT r_name AS target_id, r_regionkey AS k FROM region), m AS (SELECT target_id, n_name AS component_id, 1 AS part, n_nationkey AS o FROM t JOIN nation ON n_regionkey = k UNION ALL SELECT target_id, 'BRAZIL', 0, 0 FROM t UNION ALL SELECT target_id, 'extra', 2, 0 FROM t),
f AS (SELECT target_id, component_id, min(part * 1000 + o) AS o FROM m GROUP BY ALL)
SELECT target_id, component_id, row_number() OVER (PARTITION BY target_id ORDER BY o, component_id) - 1 AS pos FROM f""",
)
def component_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "region").select(F.col("r_name").alias("target_id"), F.array(F.lit("BRAZIL")).alias("component_ids"), F.array(F.col("r_regionkey").cast("string")).alias("benchmark_ids"))
    comps = table(spark, sf_dir, "nation").select(F.col("n_name").alias("component_id"), F.array(F.col("n_regionkey").cast("string")).alias("benchmark_ids"), F.col("n_nationkey").cast("int").alias("pos"))
    return bench.select_components(targets, comps, "template_and_matched", ["extra"])


@register(
    "integration_violations",
    """WITH b AS (SELECT 'b' || c_custkey AS id FROM customer), i AS (SELECT id, count(*) AS n FROM (SELECT 'b' || o_custkey AS id FROM orders UNION ALL SELECT 's' || s_suppkey FROM supplier) GROUP BY 1)
SELECT CASE WHEN b.id IS NULL THEN 'unknown_benchmark' WHEN n IS NULL THEN 'no_integration' ELSE 'several_integrations' END AS violation, coalesce(b.id, i.id) AS key, coalesce(n, 0) AS n FROM b FULL JOIN i ON b.id = i.id WHERE b.id IS NULL OR n IS NULL OR n > 1""",
)
def integration_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda t, tag, key: table(spark, sf_dir, t).select(F.concat(F.lit(tag), F.col(key).cast("string")).alias("benchmark_id"))
    return bench.one_integration_each(name("customer", "b", "c_custkey"), name("orders", "b", "o_custkey").unionByName(name("supplier", "s", "s_suppkey")))


@register(
    "qa_summary",
    f"""WITH {_ITEMS_SQL}, a AS (SELECT d.source, 'q' || doc_id AS question_id, trim(string_split(trim(coalesce(d.text, '')), chr(10))[1]) AS answer, trim(string_split(trim(b.text), chr(10))[1]) AS accepted, doc_id % 10 AS latency, doc_id % 17 = 0 AS bad FROM documents d JOIN items b ON d.doc_id % b.n = b.place),
o AS (SELECT *, answer <> '' AND contains(answer, accepted) AS ok FROM a)
SELECT source, count(*) AS questions, round(avg(CAST(ok AS INT)), 6) AS exact_match, round(avg(CAST(answer <> '' AS INT)), 6) AS answered_rate, round(avg(latency), 6) AS average_latency, count(*) FILTER (bad) AS failures, coalesce(string_agg(question_id, ',' ORDER BY question_id) FILTER (NOT ok), '') AS incorrect FROM o GROUP BY source""",
)
def qa_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("b"))
    j = _with_items(d.select("doc_id", "source", "text"), b)
    j = j.select("source", F.concat(F.lit("q"), i.cast("string")).alias("question_id"), F.col("text").alias("answer"), F.array("b").alias("accepted"), F.lit("text").alias("kind"), (i % 10).alias("latency"), F.when(i % 17 == 0, "bad").alias("error"))
    return qa.summary(j, "source")


_MODALITY_SQL = "CASE label WHEN 'part' THEN 'code' WHEN 'supplier' THEN 'literature' WHEN 'order' THEN 'backlog' WHEN 'customer' THEN 'memory' ELSE 'docs' END"


@register(
    "visible_nodes",
    f"""WITH RECURSIVE e AS (SELECT source AS a, target AS b FROM {EDGES_SQL} UNION SELECT target, source FROM {EDGES_SQL}), r AS (SELECT 'supplier:1' AS id, 0 AS d UNION SELECT e.b, r.d + 1 FROM r JOIN e ON e.a = r.id WHERE r.d < 2)
SELECT id, {_MODALITY_SQL} AS modality FROM {NODES_SQL} WHERE id IN (SELECT id FROM r) AND {_MODALITY_SQL} IN ('code', 'literature', 'docs')""",
)
def visible_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.create_map(*map(F.lit, ("part", "CodeSymbol", "supplier", "Paper", "order", "AgentBacklogIssue", "customer", "ProjectMemory")))
    n = graph.union_nodes(graph_nodes(spark, sf_dir)).withColumn("labels", F.array(F.coalesce(named[F.col("label")], F.lit("Node")))).withColumn("props", F.create_map(F.lit("name"), "title"))
    n = n.select("id", ranking.modality("labels", "props").alias("modality"))
    focus = graph.neighborhood(graph_edges(spark, sf_dir), spark.range(1).select(F.lit("supplier:1").alias("id")), 2)
    return capabilities.visible(n, capabilities.wanted_modalities({"code", "literature", "docs", "memory"}, {"memory"}), focus)


@register(
    "memory_relations",
    """WITH c AS (SELECT 'm' || (page_id % 50) AS node_id, page_id % 4 AS k, page_id FROM pages),
r AS (SELECT node_id, CASE k WHEN 0 THEN 'docs/' || (page_id % 9) || '.md' WHEN 1 THEN 'src/' || (page_id % 9) || '.py' WHEN 2 THEN '@key' || (page_id % 9) ELSE 'mod.f' || (page_id % 9) END AS evidence,
  CASE k WHEN 0 THEN 'doc_surface:repo:docs/' || (page_id % 9) || '.md' WHEN 1 THEN 'code_surface:repo:src/' || (page_id % 9) || '.py' WHEN 2 THEN CASE WHEN page_id % 9 < 5 THEN 'paper:p' || (page_id % 9) ELSE 'paper_surface:ref:@key' || (page_id % 9) END ELSE 'code_surface:symbol:mod.f' || (page_id % 9) END AS target,
  CASE k WHEN 0 THEN 'doc_surface' WHEN 2 THEN CASE WHEN page_id % 9 < 5 THEN 'paper' ELSE 'paper_surface' END ELSE 'code_surface' END AS target_kind, CASE CAST(substr(node_id, 2) AS INT) % 3 WHEN 0 THEN 'decision' WHEN 1 THEN 'project_state' ELSE 'note' END AS kind FROM c),
x AS (SELECT *, unnest(list_filter([CASE WHEN target_kind = 'code_surface' AND kind IN ('decision', 'project_state') THEN 'DOCUMENTS_CODE' END, CASE WHEN kind = 'decision' AND target_kind NOT IN ('paper', 'paper_surface') THEN 'CONSTRAINS' END,
  CASE WHEN target_kind IN ('paper', 'paper_surface') OR NOT ((target_kind = 'code_surface' AND kind IN ('decision', 'project_state')) OR kind = 'decision') THEN 'RELATES_TO' END], lambda v: v IS NOT NULL)) AS relation FROM r)
SELECT node_id AS source, target, relation, target_kind, string_agg(DISTINCT evidence, '|' ORDER BY evidence) AS evidence FROM x GROUP BY ALL""",
)
def memory_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select(F.col("page_id"), F.concat(F.lit("m"), (F.col("page_id") % 50).cast("string")).alias("node_id"), (F.col("page_id") % 4).alias("k"), (F.col("page_id") % 9).cast("string").alias("n"))
    raw = F.when(F.col("k") == 0, F.concat(F.lit("docs/"), "n", F.lit(".md"))).when(F.col("k") == 1, F.concat(F.lit("src/"), "n", F.lit(".py"))).when(F.col("k") == 2, F.concat(F.lit("key"), "n")).otherwise(F.concat(F.lit("mod.f"), "n"))
    kind = F.when(F.col("k") <= 1, "path").when(F.col("k") == 2, "citation_key").otherwise("symbol")
    papers_ = spark.createDataFrame([(f"p{i}", f"key{i}", None, None) for i in range(5)], "paper_id string, citation_key string, arxiv_id string, stem string")
    m = F.substring("node_id", F.lit(2), F.lit(9)).cast("int") % 3
    nodes = p.select("node_id", F.when(m == 0, "decision").when(m == 1, "project_state").otherwise("note").alias("kind")).distinct()
    return memory.relations(nodes, memory.resolve(p.select("node_id", raw.alias("raw"), kind.alias("kind")), papers_))


@register("event_windows", "SELECT epoch(date_trunc('hour', ts))::BIGINT AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.event_counts(table(spark, sf_dir, "events")).withColumn("window_start", F.unix_timestamp("window_start"))


@register("graph_layout")
def graph_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = graph.union_nodes(graph_nodes(spark, sf_dir)[1:4])
    kinds = F.create_map(*map(F.lit, ("nation", "Paper", "customer", "Citation", "supplier", "PaperSection")))
    e = graph_edges(spark, sf_dir).where("rel_type = 'IN_NATION'")
    turned = e.select(F.col("target").alias("source"), F.when(F.startswith("source", F.lit("customer")), "CITES").otherwise("HAS_SECTION").alias("rel_type"), F.col("source").alias("target"))
    return layout.semantic_layout(n.select("id", kinds[F.col("label")].alias("kind"), "title"), turned)


from . import cases, indexed, more, rest, roundtrips, snapshots, texts  # noqa: E402, F401 - they register their queries
