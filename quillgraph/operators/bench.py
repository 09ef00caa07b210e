"""Benchmark catalogs, results, thresholds and promotion; checks of all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parse_threshold(rule: str) -> tuple[str, str, float]:
    """``metric<=value`` as (metric, operator, value); two-character operators are looked for first."""
    for op in ("<=", ">=", "<", ">"):
        name, found, value = rule.partition(op)
        if found:
            if not name.strip():
                break
            return name.strip(), op, float(value)
    raise ValueError(f"not a threshold: {rule!r}")


def meets(value: Column, op: Column, limit: Column) -> Column:
    return F.when(op == "<", value < limit).when(op == "<=", value <= limit).when(op == ">", value > limit).otherwise(value >= limit)


def promoted_runs(scores: DataFrame, rules: DataFrame, benchmarks: list[str] | None = None, statuses: list[str] | None = None) -> DataFrame:
    """``run_id, benchmark_id, reasons``: runs (run_id, benchmark_id, status, metric, value) of wanted benchmark and status of which a score meets a rule (metric, op, limit), any one; all if there are no rules."""
    s = scores
    if benchmarks:
        s = s.where(F.col("benchmark_id").isin(benchmarks))
    if statuses:
        s = s.where(F.col("status").isin(statuses))
    hit = s.join(F.broadcast(rules.withColumnRenamed("metric", "rule_metric")), F.col("metric") == F.col("rule_metric"), "left")
    reason = F.when(meets(F.col("value"), F.col("op"), F.col("limit")), F.concat(F.col("metric"), F.col("op"), F.col("limit").cast("string")))
    out = hit.groupBy("run_id", "benchmark_id").agg(F.array_join(F.array_sort(F.collect_set(reason)), ",").alias("reasons"), F.max(F.lit(1)).alias("_x")).drop("_x")
    return out.where("reasons <> ''") if not rules.isEmpty() else out


def duplicate_keys(rows: DataFrame, keys: list[str], what: str) -> DataFrame:
    """``violation, key, n`` for keys that stand more than once."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(f"duplicate_{what}").alias("violation"), F.concat_ws(":", *keys).alias("key"), "n")


def missing_references(rows: DataFrame, column: str, known: DataFrame, known_column: str, what: str) -> DataFrame:
    """``violation, key, n`` for values that aren't in another table."""
    k = known.select(F.col(known_column).alias(column)).distinct()
    return rows.where(F.col(column).isNotNull()).join(k, column, "left_anti").groupBy(column).agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"unknown_{what}").alias("violation"), F.col(column).cast("string").alias("key"), "n")


def blank_values(rows: DataFrame, column: str, key: str) -> DataFrame:
    bad = rows.where(F.col(column).isNull() | (F.trim(F.col(column)) == ""))
    return bad.select(F.lit(f"blank_{column}").alias("violation"), F.col(key).cast("string").alias("key"), F.lit(1).cast("long").alias("n"))


def record_violations(rows: DataFrame) -> DataFrame:
    """``id, violation`` for canonical records (id, label, provenance, schema_version, confidence): bad ids, blank labels, no provenance, no version, confidence outside 0 to 1."""
    checks = {
        "id": F.col("id").isNull() | ~F.regexp_like(F.coalesce("id", F.lit("")), F.lit(r"^\S+$")),
        "label": F.trim(F.coalesce("label", F.lit(""))) == "",
        "provenance": F.col("provenance").isNull() | (F.size("provenance") == 0),
        "schema_version": F.trim(F.coalesce("schema_version", F.lit(""))) == "",
        "confidence": F.col("confidence").isNull() | (F.col("confidence") < 0) | (F.col("confidence") > 1),
    }
    return rows.select("id", F.explode(F.array_compact(F.array(*[F.when(c, n) for n, c in checks.items()]))).alias("violation"))


def support_status(benchmarks: DataFrame, integrations: DataFrame, runs: DataFrame, available: list[str]) -> DataFrame:
    """``benchmark_id, status, missing, runs``: benchmarks with their integration's missing tools and number of runs."""
    have = F.array(*map(F.lit, available)) if available else F.array().cast("array<string>")
    n = runs.groupBy("benchmark_id").agg(F.count(F.lit(1)).alias("runs"))
    j = benchmarks.join(integrations.select("benchmark_id", "tools"), "benchmark_id", "left").join(n, "benchmark_id", "left")
    missing = F.array_except("tools", have)
    status = F.when(F.col("tools").isNull(), "unconfigured").when(F.size(missing) > 0, "blocked").otherwise("ready")
    return j.select("benchmark_id", status.alias("status"), F.coalesce(F.array_join(F.array_sort(missing), ","), F.lit("")).alias("missing"), F.coalesce("runs", F.lit(0)).cast("long").alias("runs"))


# Where the components of a promoted target come from.
SELECTIONS = ("template_only", "template_and_matched", "matched_only")


def select_components(targets: DataFrame, components: DataFrame, selection: str, extra: list[str] | None = None) -> DataFrame:
    """``target_id, component_id, pos``: components of targets (target_id, component_ids, benchmark_ids): the template's, those (component_id, benchmark_ids, pos) that share a benchmark, and named ones, each once, in that order."""
    if selection not in SELECTIONS:
        raise ValueError(f"unknown selection {selection!r}")
    template = targets.select("target_id", F.posexplode("component_ids").alias("k", "component_id")).select("target_id", "component_id", F.lit(0).alias("part"), "k")
    t = targets.select("target_id", F.explode("benchmark_ids").alias("b"))
    c = components.select("component_id", F.col("pos").alias("k"), F.explode("benchmark_ids").alias("b"))
    matched = t.join(c, "b").select("target_id", "component_id", F.lit(1).alias("part"), "k")
    rows = {"template_only": template, "matched_only": matched}.get(selection) or template.unionByName(matched)
    if extra:
        named = F.posexplode(F.array(*map(F.lit, extra))).alias("k", "component_id")
        rows = rows.unionByName(targets.select("target_id", named).select("target_id", "component_id", F.lit(2).alias("part"), "k"))
    first = rows.groupBy("target_id", "component_id").agg(F.min(F.struct("part", "k")).alias("at"))
    return first.withColumn("pos", (F.row_number().over(Window.partitionBy("target_id").orderBy("at", "component_id")) - 1).cast("long")).drop("at")


def one_integration_each(benchmarks: DataFrame, integrations: DataFrame) -> DataFrame:
    """``violation, key, n`` for benchmarks without, or with several, integrations, and for integrations of unknown benchmarks."""
    n = integrations.groupBy("benchmark_id").agg(F.count(F.lit(1)).alias("n"))
    j = benchmarks.select("benchmark_id", F.lit(1).alias("known")).join(n, "benchmark_id", "full")
    violation = F.when(F.col("known").isNull(), "unknown_benchmark").when(F.col("n").isNull(), "no_integration").when(F.col("n") > 1, "several_integrations")
    return j.select(violation.alias("violation"), F.col("benchmark_id").alias("key"), F.coalesce("n", F.lit(0)).cast("long").alias("n")).where("violation is not null")


def _blank(rows: DataFrame, column: str, key: Column, may_be_null: bool = False) -> DataFrame:
    empty = F.trim(F.col(column)) == ""
    return rows.where(empty if may_be_null else empty | F.col(column).isNull()).select(F.lit(f"blank_{column}").alias("violation"), key.cast("string").alias("key"), F.lit(1).cast("long").alias("n"))


def result_violations(runs: DataFrame, scores: DataFrame, benchmarks: DataFrame, metrics: DataFrame) -> DataFrame:
    """``violation, key, n`` of runs (run_id, benchmark_id, status, summary) and scores (run_id, benchmark_id, metric, unit).

    Run ids are unique, benchmarks known, status and summary filled; a score's
    metric is one of its benchmark's (benchmark_id, metric), stands once in a
    run and has a unit.
    """
    run, score = F.col("run_id"), F.concat_ws(":", "run_id", "metric")
    known = scores.join(benchmarks.select("benchmark_id").distinct(), "benchmark_id", "left_semi")
    strange = known.join(metrics.select("benchmark_id", "metric").distinct(), ["benchmark_id", "metric"], "left_anti")
    return (
        duplicate_keys(runs, ["run_id"], "run")
        .unionByName(missing_references(runs, "benchmark_id", benchmarks, "benchmark_id", "benchmark"))
        .unionByName(_blank(runs, "status", run))
        .unionByName(_blank(runs, "summary", run))
        .unionByName(strange.select(F.lit("unknown_metric").alias("violation"), score.alias("key")).groupBy("violation", "key").agg(F.count(F.lit(1)).alias("n")))
        .unionByName(duplicate_keys(scores, ["run_id", "metric"], "metric"))
        .unionByName(_blank(scores, "unit", score))
    )


def plan_violations(plan: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """``violation, key, n`` of requested runs (run_id, benchmark_id, command, workdir, env): benchmarks known, run ids filled and unique, commands filled, no blank folder (null: none), no blank name or value in the environment."""
    run = F.col("run_id")
    env = plan.select("run_id", F.explode("env").alias("name", "value")).where((F.trim("name") == "") | F.col("value").isNull() | (F.trim("value") == ""))
    return (
        missing_references(plan, "benchmark_id", benchmarks, "benchmark_id", "benchmark")
        .unionByName(_blank(plan, "run_id", F.col("benchmark_id")))
        .unionByName(duplicate_keys(plan.where("trim(run_id) <> ''"), ["run_id"], "run"))
        .unionByName(_blank(plan, "command", run))
        .unionByName(_blank(plan, "workdir", run, may_be_null=True))
        .unionByName(env.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit("blank_env").alias("violation"), F.col("run_id").cast("string").alias("key"), "n"))
    )
