"""The registry of papers: merge of manifest and bibliography, matches with parsed documents."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .matching import first_free
from .storage import written


def merge_sources(manifest: DataFrame, bib: DataFrame) -> DataFrame:
    """Full outer merge of manifest (pos, arxiv_id, title, tex_dir, pdf_file) and bibliography (pos, citation_key, eprint, title, author, year, doi, url).

    A bibliography row takes the manifest row of its eprint; else, by title
    key, the first one not taken by an earlier row, else the first.  Of
    manifest rows with one arXiv id the last counts; rows that nobody takes
    follow.  Where several manifest rows have a title, the choice depends on
    the order of all its rows; first_free() makes it in parallel.
    """
    last = Window.partitionBy("arxiv_id").orderBy(F.desc("pos"))
    m = manifest.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r", "pos").withColumn("m_key", text.letters_key(F.coalesce("title", F.lit(""))))
    b = bib.withColumn("b_key", text.letters_key(F.coalesce("title", F.lit(""))))
    ids = m.select(F.col("arxiv_id").alias("m_id"), "m_key")
    direct = b.join(ids.select("m_id"), F.col("eprint") == F.col("m_id"), "left")
    taken = direct.where("m_id is not null").select("pos", "m_id")
    free = direct.where("m_id is null and b_key <> ''").select("pos", F.col("b_key").alias("key"))
    counts = ids.where("m_key <> ''").groupBy(F.col("m_key").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("m_id").alias("only"))
    single = free.join(counts.where("n = 1"), "key").select("pos", F.col("only").alias("m_id"))
    several = counts.where("n > 1").select("key")
    since = taken.groupBy("m_id").agg(F.min("pos").alias("since"))
    cands = ids.join(several, ids.m_key == several.key).join(since, "m_id", "left").select("key", F.col("m_id").alias("name"), "since")
    chosen = first_free(free.join(several, "key").select("key", "pos"), cands).select("pos", F.col("name").alias("m_id"))
    match = taken.select(F.col("pos").cast("long"), "m_id").unionByName(single.select(F.col("pos").cast("long"), "m_id")).unionByName(chosen)
    pairs = bib.join(match, "pos", "left")
    full = pairs.join(m.select(F.col("arxiv_id").alias("m_id"), F.col("title").alias("m_title"), "tex_dir", "pdf_file"), "m_id", "left")
    has = F.col("m_id").isNotNull()
    title = F.coalesce("title", "m_title", "citation_key")
    arxiv = F.coalesce("m_id", "eprint")
    source_url = F.concat(F.lit("https://arxiv.org/e-print/"), F.col("m_id"))
    with_bib = full.select(
        text.paper_id(F.col("citation_key"), arxiv, title).alias("paper_id"), "citation_key", title.alias("title"), arxiv.alias("arxiv_id"), "doi", F.coalesce("url", source_url).alias("url"), "tex_dir", "pdf_file",
        F.when(has, "manifest_and_bib").otherwise("bib").alias("source_kind"),
        F.when(~has, "metadata_only").when(F.col("pdf_file").isNotNull(), "manifest_source_plus_pdf").otherwise("manifest_source").alias("download_mode"),
        F.when(has, "pending_download").otherwise("metadata_only").alias("parse_status"),
    )
    rest = m.join(match.select(F.col("m_id").alias("arxiv_id")).distinct(), "arxiv_id", "left_anti")
    title = F.coalesce("title", "tex_dir")
    alone = rest.select(
        text.paper_id(F.lit(None).cast("string"), F.col("arxiv_id"), title).alias("paper_id"), F.lit(None).cast("string").alias("citation_key"), title.alias("title"), "arxiv_id", F.lit(None).cast("string").alias("doi"),
        F.when(F.col("pdf_file").isNotNull(), F.concat(F.lit("https://arxiv.org/pdf/"), "arxiv_id", F.lit(".pdf"))).otherwise(F.concat(F.lit("https://arxiv.org/e-print/"), "arxiv_id")).alias("url"),
        "tex_dir", "pdf_file", F.lit("manifest").alias("source_kind"), F.when(F.col("pdf_file").isNotNull(), "manifest_source_plus_pdf").otherwise("manifest_source").alias("download_mode"), F.lit("pending_download").alias("parse_status"),
    )
    return with_bib.unionByName(alone)


def best_matches(records: DataFrame, parsed: DataFrame) -> DataFrame:
    """``record_id, parsed_id``: for each record the parsed document that shares id, citation key or arXiv id, the best by (structured, richness, id, key, arXiv); none if the best ones are several.

    ``records``: id, citation_key, arxiv_id; ``parsed``: those and structured,
    richness.  Of parsed documents with the same keys only the best rank and
    the first and last id that have it count, for each set of keys that may be
    shared; so copies aren't paired.  A document that shares more keys than a
    set's ranks higher with the larger set, so what a set says of it besides
    changes nothing.
    """
    keys = ("id", "citation_key", "arxiv_id")
    # read seven times, so keys are worked out once
    r = written(records.select(*[F.col(k).cast("string").alias(f"r_{k}") for k in keys]), "match-records")
    p = written(parsed.select(*[F.col(k).cast("string").alias(k) for k in keys], "structured", "richness"), "match-parsed")
    found = None
    for n in range(1, 1 << len(keys)):
        shared = [k for i, k in enumerate(keys) if n >> i & 1]
        known = reduce(and_, [F.col(k).isNotNull() for k in shared])
        by = [F.col(k).alias(f"r_{k}") for k in shared]
        one = p.where(known).groupBy(*by, "structured", "richness").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
        best = one.groupBy(*[f"r_{k}" for k in shared]).agg(F.max(F.struct("structured", "richness", "lo", "hi")).alias("top"))
        rank = F.struct("top.structured", "top.richness", *[F.lit(k in shared).alias(k) for k in keys])
        pairs = r.select("r_id", *[f"r_{k}" for k in shared if k != "id"]).distinct().join(best, [f"r_{k}" for k in shared]).select("r_id", rank.alias("rank"), "top.lo", "top.hi")
        found = pairs if found is None else found.unionByName(pairs)
    # of equal ranks the ends of all
    ends = found.groupBy("r_id", "rank").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    top = ends.groupBy("r_id").agg(F.max(F.struct("rank", "lo", "hi")).alias("top")).select("r_id", "top.*")
    return top.where("lo = hi").select(F.col("r_id").alias("record_id"), F.col("lo").alias("parsed_id"))


def fill_from_service(registry: DataFrame, found: DataFrame) -> DataFrame:
    """Registry rows with what a metadata service knows, by ``pos``: doi, arxiv_id, title and year fill nulls only, ``service`` is replaced."""
    f = found.select("pos", *[F.col(c).alias(f"f_{c}") for c in ("doi", "arxiv_id", "year", "service")])
    j = registry.join(f, "pos", "left")
    return j.withColumns({c: F.coalesce(c, f"f_{c}") for c in ("doi", "arxiv_id", "year")} | {"service": F.coalesce("f_service", "service")}).drop("f_doi", "f_arxiv_id", "f_year", "f_service")


def pick_one(registry: DataFrame, selector: str) -> DataFrame:
    """The row whose id, citation key, arXiv id or title equals ``selector``; an error unless there is exactly one."""
    low = F.lit(selector.lower())
    rows = registry.where((F.lower("paper_id") == low) | (F.lower("citation_key") == low) | (F.lower("arxiv_id") == low) | (F.lower("title") == low))
    n = rows.select("paper_id").distinct().limit(2).count()
    if n != 1:
        raise LookupError(f"{selector!r} names {'no record' if n == 0 else 'several records'}")
    return rows
