"""Notebooks as rows, decoded by JSON functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from .files import relative_to, whole_texts

_META = "struct<id:string,kernelspec:struct<name:string,display_name:string,language:string>,language_info:struct<name:string>>"
_CELL = "struct<cell_type:string,source:string>"


def decode(files: DataFrame) -> DataFrame:
    """``path, notebook_id, kernel, language, cells`` from (path, text); a cell's source is a text or a list of texts."""
    body = F.from_json("text", f"struct<metadata:{_META},cells:array<{_CELL}>>")
    n = files.select("path", body.alias("n"))
    lines = lambda s: F.when(F.startswith(s, F.lit("[")), F.array_join(F.from_json(s, "array<string>"), "")).otherwise(s)
    cells = F.transform("n.cells", lambda c, i: F.struct(i.alias("index"), text.cell_kind(c.cell_type).alias("kind"), F.coalesce(lines(c.source), F.lit("")).alias("source")))
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.ipynb$", "")
    return n.select(
        "path",
        F.coalesce(text.blank_to_null(F.col("n.metadata.id")), text.slugify(stem)).alias("notebook_id"),
        F.coalesce("n.metadata.kernelspec.name", "n.metadata.kernelspec.display_name").alias("kernel"),
        F.coalesce("n.metadata.language_info.name", "n.metadata.kernelspec.language").alias("language"),
        F.coalesce(cells, F.array().cast("array<struct<index:int,kind:string,source:string>>")).alias("cells"),
    )


def read_notebooks(spark: SparkSession, path: str) -> DataFrame:
    files = whole_texts(spark, path, "*.ipynb")
    return decode(files.withColumn("path", relative_to(F.col("path"), path)))


def attach(notebooks: DataFrame, papers: DataFrame) -> DataFrame:
    """``notebook_id, paper_id``: by equal id, else by the id as prefix (the last), else by a folder or file of that name (the first); unmatched ones keep null.

    Ids are looked up by equality: the beginnings, folders and stem of a
    notebook's path are few.
    """
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.ipynb$", "")
    parts = F.split("notebook_id", r"[_/-]")
    beginnings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.length(F.array_join(F.slice(parts, F.lit(1), k), "-")))
    heads = F.transform(beginnings, lambda n: F.struct(F.lit(1).alias("level"), F.left("notebook_id", n).alias("key")))
    folders = F.transform(F.split("path", "/"), lambda f: F.struct(F.lit(2).alias("level"), f.alias("key")))
    keys = F.concat(F.array(F.struct(F.lit(0).alias("level"), F.col("notebook_id").alias("key"))), heads, folders, F.array(F.struct(F.lit(3).alias("level"), stem.alias("key"))))
    found = notebooks.select("notebook_id", F.explode(F.array_distinct(keys)).alias("k")).select("notebook_id", "k.*").join(papers.select(F.col("paper_id").alias("key")), "key")
    order = Window.partitionBy("notebook_id").orderBy("level", F.when(F.col("level") == 1, F.length("key")).desc(), "key")
    best = found.withColumn("r", F.row_number().over(order)).where("r = 1").select("notebook_id", F.col("key").alias("paper_id"))
    return notebooks.select("notebook_id").join(best, "notebook_id", "left")
