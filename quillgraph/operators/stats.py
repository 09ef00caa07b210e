"""Counts over corpora, lines and files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, line_no, line``: lines count from 1."""
    return docs.select(F.col(id_col), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("p", "line")).select(id_col, (F.col("p") + 1).cast("long").alias("line_no"), "line")


def line_stats(docs: DataFrame, group: str, text_col: str = "text", comment: str = r"^\s*(#|//)") -> DataFrame:
    """``group, files, total, non_empty, comments, todo, fixme, code``; computed from each text's lines without exploding them."""
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    n = lambda test: F.sum(F.size(F.filter(lines, test))).cast("long")
    like = lambda p: lambda x: F.regexp_like(x, F.lit(p))
    out = docs.groupBy(group).agg(
        F.count(F.lit(1)).alias("files"), F.sum(F.size(lines)).cast("long").alias("total"), n(lambda x: F.trim(x) != "").alias("non_empty"),
        n(like(comment)).alias("comments"), n(like("(?i)todo")).alias("todo"), n(like("(?i)fixme")).alias("fixme"),
    )
    return out.withColumn("code", F.greatest(F.lit(0), F.col("non_empty") - F.col("comments")).cast("long"))


def markers(docs: DataFrame, kinds: tuple[str, ...] = ("todo", "fixme"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, line_no, kind``: a row for each kind of marker on each line, whatever its case."""
    found = F.array_compact(F.array(*[F.when(F.contains(F.lower("line"), F.lit(k)), k) for k in kinds]))
    return lines_of(docs, id_col, text_col).select(id_col, "line_no", F.explode(found).alias("kind"))


def ending_counts(paths: DataFrame, column: str = "path") -> DataFrame:
    e = F.lower(F.regexp_extract(column, r"[^/.][^/]*\.([^./]+)$", 1))
    return paths.groupBy(F.when(e == "", "[none]").otherwise(e).alias("ending")).agg(F.count(F.lit(1)).alias("n"))


def stale_outputs(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """``name, stale``: outputs (name, mtime) older than some input (name, mtime); a missing output is stale."""
    newest = inputs.groupBy("name").agg(F.max("mtime").alias("newest"))
    j = newest.join(outputs.groupBy("name").agg(F.min("mtime").alias("oldest")), "name", "left")
    return j.select("name", F.coalesce(F.col("newest") > F.col("oldest"), F.lit(True)).alias("stale"))
