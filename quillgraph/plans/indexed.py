"""Queries that answer through an index or a structure built for them, over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals, ngrams, vectors
from .hosts import table
from .registry import register

#: Which text of which table is indexed under which number, and what is looked for.
_SEARCHED = (("documents", "doc_id", "text", "Licensed under"), ("pages", "page_id", "html", 'Lang="fr"'), ("conversations", "conv_id", "text", "tion the"))


@register(
    "indexed_search",
    " UNION ALL ".join(f"SELECT '{t}' AS kind, {i} AS id, count(*) AS rows_ FROM {t} WHERE contains(lower({c}), '{q.lower()}') GROUP BY {i}" for t, i, c, q in _SEARCHED),
)
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of three tables that contain a string whatever its case, found through their trigram indexes."""
    found = []
    for name, id_col, text_col, query in _SEARCHED:
        rows = table(spark, sf_dir, name).select(id_col, text_col)
        index = ngrams.build_index(rows, id_col, text_col, f"ngrams-{name}")
        hits = ngrams.containing(index, rows, query, id_col, text_col).groupBy(id_col).agg(F.count(F.lit(1)).alias("rows_"))
        found.append(hits.select(F.lit(name).alias("kind"), F.col(id_col).alias("id"), "rows_"))
    return reduce(DataFrame.unionByName, found)


#: Expressions with and without alternatives, one that needs no trigram.
_EXPRESSIONS = (r"[Ll]icensed? under|MIT [Ll]icen[sc]e", r"Version \d\.\d", r"[0-9]{4}")


@register("indexed_regex", " UNION ALL ".join(f"SELECT '{p}' AS pattern, doc_id FROM documents WHERE regexp_matches(text, '{p}')" for p in _EXPRESSIONS))
def indexed_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that regular expressions match, one index for all of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = ngrams.build_index(docs)
    return reduce(DataFrame.unionByName, [ngrams.matching(index, docs, p).select(F.lit(p).alias("pattern"), "doc_id") for p in _EXPRESSIONS])


@register("gram_counts", "SELECT gram, count(*) AS documents FROM (SELECT DISTINCT doc_id, unnest(list_distinct(list_transform(range(1, length(text) - 1), lambda i: substr(text, i, 3)))) AS gram FROM (SELECT doc_id, regexp_replace(lower(text), '[^ -~]', ' ', 'g') AS text FROM documents WHERE text IS NOT NULL)) GROUP BY gram")
def gram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents have each trigram, counted from the lists of an index over the printable ASCII of all texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.lower("text"), "[^ -~]", " ").alias("text"))
    lists = ngrams.build_index(docs).groupBy("gram").agg(F.sum("n").alias("documents"))
    gram = F.decode(F.unhex(F.lpad(F.hex(F.col("gram").cast("long")), 6, "0")), "UTF-8")
    return lists.select(gram.alias("gram"), "documents")


_SPANS_SQL = """s AS (SELECT o_custkey AS cust, CAST(o_orderdate AS DATE) AS lo, CAST(l_shipdate AS DATE) AS hi, l_orderkey, l_linenumber, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
p AS (SELECT o_orderkey, o_custkey AS cust, CAST(o_orderdate AS DATE) AS day_ FROM orders)"""


def _order_days(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Days on which customers order, and the days from order to shipping of their items."""
    day = lambda c: F.unix_date(F.col(c).cast("date")).cast("long")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("cust"), day("o_orderdate").alias("day"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", day("l_shipdate").alias("hi"))
    # a narrow file of orders is far larger in memory than its estimate: it isn't to be broadcast
    return orders, items.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "cust", F.col("day").alias("lo")).hint("merge"), "l_orderkey")


@register("open_items", f"WITH {_SPANS_SQL} SELECT cust, date_diff('day', DATE '1970-01-01', day_) AS day, count(*) AS items, sum(l_quantity) AS quantity FROM (SELECT DISTINCT cust, day_ FROM p) JOIN s USING (cust) WHERE day_ BETWEEN lo AND hi GROUP BY ALL")
def open_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each day on which a customer orders, how many of their items are on the way."""
    orders, spans = _order_days(spark, sf_dir)
    parts = {"items": F.count(F.lit(1)), "quantity": F.sum("l_quantity")}
    return intervals.aggregated_over_spans(orders, spans, ["cust"], "day", "lo", "hi", parts, {"items": F.sum, "quantity": F.sum})


@register("orders_while_open", f"WITH {_SPANS_SQL} SELECT o_orderkey, l_orderkey, l_linenumber FROM p JOIN s USING (cust) WHERE day_ BETWEEN lo AND hi AND o_orderkey <> l_orderkey")
def orders_while_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that a customer places while an item of another order is on the way, with that item."""
    orders, spans = _order_days(spark, sf_dir)
    return intervals.spans_of_points(orders, spans, ["cust"], "day", "lo", "hi").where("o_orderkey <> l_orderkey").select("o_orderkey", "l_orderkey", "l_linenumber")


_COSINES_SQL = """a AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
s AS (SELECT q.id AS query_id, a.id, round(list_cosine_similarity(q.v, a.v), 9) AS score FROM a q JOIN a ON q.id <> a.id WHERE q.id % 100 = 0)"""
NEAREST, WITHIN = 10, 0.35


def _vector_index(spark: SparkSession, sf_dir: str) -> tuple[vectors.VectorIndex, DataFrame]:
    """The index of all embeddings, and as queries the rows whose id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vectors.VectorIndex(rows), rows.where("vec_id % 100 = 0")


@register("nearest_vectors", f"WITH {_COSINES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, rank, id, score FROM r WHERE rank <= {NEAREST}")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of each query by cosine, exactly, through pivots and bounds."""
    index, queries = _vector_index(spark, sf_dir)
    return index.nearest(queries, NEAREST)[0]


@register("vectors_within", f"WITH {_COSINES_SQL} SELECT query_id, id, score FROM s WHERE score >= {WITHIN}")
def vectors_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows within a cosine of each query, through the same index."""
    index, queries = _vector_index(spark, sf_dir)
    return index.within(queries, WITHIN)[0]
