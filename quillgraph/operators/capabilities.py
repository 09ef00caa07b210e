"""What a corpus is ready for: states of its parts, what to do next, which modalities to show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Modalities of graph nodes.
MODALITIES = ("code", "docs", "literature", "memory", "backlog", "generated_context", "external_docs")


def recommendation(state: Column) -> Column:
    return F.when(state.isin("ready", "generated", "implemented"), "use_now").when(state.isin("stale", "configured", "not_checked"), "refresh_first").when(state == "missing", "missing_leaf").otherwise("do_not_use")


def wanted_modalities(include: set[str] = frozenset(), exclude: set[str] = frozenset()) -> set[str]:
    """Included modalities, all if none are named or ``all`` is; excluded ones go in any case."""
    unknown = (include | exclude) - {*MODALITIES, "all"}
    if unknown:
        raise ValueError(f"unknown modalities: {sorted(unknown)}")
    every = not include or "all" in include
    return set() if "all" in exclude else (set(MODALITIES) if every else set(include)) - set(exclude)


def visible(nodes: DataFrame, modalities: set[str], focus: DataFrame | None = None) -> DataFrame:
    """Nodes of wanted modality, and in the focus (ids) if there is one."""
    out = nodes.where(F.col("modality").isin(*sorted(modalities))) if modalities else nodes.limit(0)
    return out if focus is None else out.join(focus.select("id"), "id", "left_semi")


def corpus_capability(registry: DataFrame, parsed: DataFrame) -> DataFrame:
    """One row: records, arXiv and local records, enriched and parsed ones, expected PDFs, and the state of each part."""
    r = registry.agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.coalesce(F.col("arxiv_id"), F.lit("")) != "").alias("arxiv_records"), F.count_if(F.coalesce("has_local_tex", F.lit(False))).alias("local_tex"),
        F.count_if(F.col("pdf_file").isNotNull()).alias("expected_pdfs"), F.count_if(F.col("enriched")).alias("enriched"),
    )
    j = r.crossJoin(parsed.agg(F.count(F.lit(1)).alias("parsed")))
    state = lambda have, want: F.when(F.col(want) == 0, "missing").when(F.col(have) >= F.col(want), "ready").when(F.col(have) > 0, "stale").otherwise("missing")
    j = j.withColumn("download_state", state("local_tex", "arxiv_records")).withColumn("parse_state", state("parsed", "records")).withColumn("enrich_state", state("enriched", "records"))
    steps = F.array_compact(F.array(F.when((F.col("local_tex") < F.col("arxiv_records")), "download"), F.when((F.col("parsed") < F.col("records")) & (F.col("local_tex") > 0), "parse"), F.when(F.col("parsed") > 0, "build"), F.when(F.col("enriched") < F.col("records"), "enrich")))
    return j.withColumn("next_steps", F.array_join(steps, ","))


def missing_tools(required: DataFrame, available: list[str]) -> DataFrame:
    """Required tools (id, tools) less those there are."""
    have = F.array(*map(F.lit, available)) if available else F.array().cast("array<string>")
    return required.select("id", F.array_sort(F.array_except("tools", have)).alias("missing")).where(F.size("missing") > 0)


def part_states(found: DataFrame) -> DataFrame:
    """``part, state`` from one row that says what is there.

    It has records, local_tex, local_pdf, expected_pdfs, parsed, enriched
    (counts) and manifest, bib, registry, download_pdfs, docs_configured,
    docs_generated, graph_configured, graph_generated, service_configured,
    service_key, memory_configured, memory_present (truth values).
    """
    c = F.col
    states = {
        "literature_registry": F.when(c("registry"), "generated").when(c("manifest") & c("bib"), "ready").otherwise("missing"),
        "downloads": F.when(c("records") == 0, "missing").when((c("local_tex") == c("records")) & (~c("download_pdfs") | (c("local_pdf") == c("expected_pdfs"))), "ready").otherwise("configured"),
        "parsing": F.when(c("parsed") > 0, "generated").when(c("local_tex") > 0, "configured").otherwise("missing"),
        "docs": F.when(c("docs_generated"), "generated").when(c("docs_configured"), "configured").otherwise("unavailable"),
        "graph": F.when(c("graph_generated"), "generated").when(c("graph_configured"), "configured").otherwise("unavailable"),
        "viewer": F.when(c("graph_generated"), "ready").otherwise("missing"),
        "metadata_service": F.when(~c("service_configured"), "unavailable").when(c("enriched") > 0, "generated").when(c("service_key"), "ready").otherwise("configured"),
        "project_memory": F.when(c("memory_present"), "ready").when(c("memory_configured"), "configured").otherwise("unavailable"),
    }
    return found.select(F.explode(F.array(*[F.struct(F.lit(k).alias("part"), v.alias("state")) for k, v in states.items()])).alias("x")).select("x.*")


def benchmark_readiness(support: DataFrame, catalog_present: bool, integrations_present: bool) -> DataFrame:
    """One row from support entries (missing_binaries, missing_env_vars): ``state, support_entries, ready_entries, missing_binaries, missing_env_vars``, the last two sorted and joined."""
    ready = (F.size("missing_binaries") == 0) & (F.size("missing_env_vars") == 0)
    every = lambda column: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(column)))), ",").alias(column)
    found = support.agg(F.count(F.lit(1)).alias("support_entries"), F.count_if(ready).alias("ready_entries"), every("missing_binaries"), every("missing_env_vars"))
    state = F.lit("missing") if not catalog_present else F.lit("configured") if not integrations_present else F.when(F.col("ready_entries") > 0, "ready").otherwise("generated")
    return found.select(state.alias("state"), *found.columns)


def source_descriptors(sources: DataFrame) -> DataFrame:
    """``name, kind, state, recommendation, repair_command`` of configured sources (name, kind, configured, present, fresh, repair_command)."""
    state = F.when(~F.col("configured"), "unavailable").when(~F.col("present"), "missing").when(F.col("fresh"), "ready").otherwise("stale")
    s = sources.withColumn("state", state)
    return s.select("name", "kind", "state", recommendation(F.col("state")).alias("recommendation"), F.when(F.col("state").isin("missing", "stale"), F.col("repair_command")).alias("repair_command"))
