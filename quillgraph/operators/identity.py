"""Identity of records: candidates that share an identifier are one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import written


def resolve_identities(candidates: DataFrame) -> DataFrame:
    """``idx, component, canonical_id, reason`` from rows of (idx, doi, arxiv, s2).

    Links go through a star for each identifier, so a shared one costs a link
    for each record.  The canonical id is the least DOI of a component, else
    arXiv id, else service id, else its first index.  Candidates are written
    once, as what they are made of may be whole texts.
    """
    candidates = written(candidates, "candidates")
    ids = candidates.select("idx", F.explode(F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(p), F.col(c))) for c, p in (("doi", "doi:"), ("arxiv", "arxiv:"), ("s2", "s2:"))])).alias("key")).where("key is not null")
    first = ids.groupBy("key").agg(F.min("idx").alias("b"), F.count(F.lit(1)).alias("n"))
    links = ids.join(first.where("n > 1"), "key").select(F.col("idx").alias("a"), "b").where("a <> b").distinct()
    found = candidates.join(components(links).withColumnRenamed("node", "idx"), "idx", "left").withColumn("component", F.coalesce("component", "idx"))
    names = found.groupBy("component").agg(F.min("doi").alias("d"), F.min("arxiv").alias("x"), F.min("s2").alias("s"), F.count(F.lit(1)).alias("size"))
    name = F.coalesce(F.concat(F.lit("paper:doi:"), "d"), F.concat(F.lit("paper:arxiv:"), "x"), F.concat(F.lit("paper:s2:"), "s"), F.concat(F.lit("paper:hash:"), F.col("component").cast("string")))
    reason = F.when(F.col("size") == 1, "single").when(F.col("d").isNotNull(), "shared_doi").when(F.col("x").isNotNull(), "shared_arxiv").otherwise("shared_s2")
    names = names.select("component", name.alias("canonical_id"), reason.alias("reason"))
    return found.join(names, "component").select("idx", "component", "canonical_id", "reason")


def title_conflicts(resolved: DataFrame) -> DataFrame:
    """Components whose records have different titles: ``component, left_idx, right_idx``, the first titled record and the first that differs.

    ``resolved`` has component, idx and title_key.
    """
    titled = resolved.where("title_key <> ''").select("component", "idx", "title_key")
    first = titled.groupBy("component").agg(F.min(F.struct("idx", "title_key")).alias("first"))
    others = titled.join(first, "component").where("title_key <> first.title_key")
    return others.groupBy("component").agg(F.min("first.idx").alias("left_idx"), F.min("idx").alias("right_idx"))
