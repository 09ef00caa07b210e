"""Files as rows: whole texts, JSON lines, TOML; listings with exclusions."""

from __future__ import annotations

import io
import json
import tarfile
import tomllib
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ranking, text
from . import schemas, tomls


def whole_texts(spark: SparkSession, path: str, globs: str = "*", recursive: bool = True) -> DataFrame:
    """``path, text, mtime`` of the files under ``path`` whose names fit one of the globs (``{a,b}`` alternatives)."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", globs).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return df.select(F.col("path"), F.col("content").cast("string").alias("text"), F.col("modificationTime").alias("mtime"))


def relative_to(column: Column, root: str) -> Column:
    """A path below ``root``, whatever scheme it was listed with."""
    bare = F.regexp_replace(column, "^[a-z]+:/*", "/")
    plain = "/" + root.split(":", 1)[-1].strip("/") + "/"
    return F.when(F.startswith(bare, F.lit(plain)), F.substring(bare, F.lit(len(plain) + 1), F.length(bare))).otherwise(bare)


def matching(files: DataFrame, include: list[str], exclude: list[str] = (), column: str = "path") -> DataFrame:
    """Files whose path, or an ending of it, fits a glob of ``include`` and none of ``exclude``."""
    fits = lambda globs: F.array_contains(F.array(*[F.regexp_like(F.col(column), F.lit(ranking.glob_regex(g))) for g in globs]), True) if globs else F.lit(False)
    return files.where(fits(list(include)) & ~fits(list(exclude)))


def parsed(files: DataFrame, parse: Callable[[str, str], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows that ``parse(path, text)`` yields for each file; a file is a task's unit."""
    names = [f.name for f in _struct(schema)]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [row for path, body in zip(part["path"], part["text"]) for row in parse(path, body or "")]
            yield pd.DataFrame(rows, columns=names, dtype=object)

    return files.select("path", "text").mapInPandas(run, schema)


def _struct(schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema) if isinstance(schema, str) else schema


def manifest_urls(m: DataFrame) -> DataFrame:
    """Manifest rows with the addresses that they lack, derived from their arXiv ids."""
    source = F.coalesce("source_url", F.concat(F.lit("https://arxiv.org/e-print/"), "arxiv_id"))
    pdf = F.coalesce("pdf_url", F.when(F.col("pdf_file").isNotNull(), F.concat(F.lit("https://arxiv.org/pdf/"), "arxiv_id", F.lit(".pdf"))))
    return m.withColumn("source_url", source).withColumn("pdf_url", pdf)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest lines with derived addresses; a bad line is an error, blank lines are skipped."""
    return manifest_urls(spark.read.schema(schemas.MANIFEST).option("mode", "FAILFAST").json(path))


def registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.REGISTRY).json(path)


def glossary(spark: SparkSession, path: str) -> DataFrame:
    """Glossary terms that have an id."""
    return spark.read.schema("id string, label string, definition_short string, definition_long string, source_path string").json(path).where("id is not null")


def graph_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(schemas.NODES).json(f"{path}/nodes"), spark.read.schema(schemas.EDGES).json(f"{path}/edges")


def toml(spark: SparkSession, path: str) -> dict[str, Any]:
    """A TOML file read through Spark's file systems."""
    return tomllib.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def backlog(spark: SparkSession, path: str) -> DataFrame:
    """Open issues and todos of a backlog TOML: closed or resolved issues, done or resolved todos go."""
    one = "id string, title string, status string, priority string, summary string, description string, references array<string>, issue_ids array<string>"
    rows = tomls.listed(tomls.items(spark, path), ("issue", "issues", "todo", "todos"), one).withColumn("kind", F.rtrim(F.col("name"), F.lit("s")))
    gone = F.when(F.col("kind") == "issue", F.col("status").isin("closed", "resolved")).otherwise(F.col("status").isin("done", "resolved"))
    text_ = lambda c: F.coalesce(c, F.lit(""))
    listed = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    summary = F.coalesce(F.nullif("summary", F.lit("")), "description")
    return rows.where(~F.coalesce(gone, F.lit(False))).select("kind", text_("id").alias("id"), text_("title").alias("title"), "status", "priority", summary.alias("summary"), listed("references"), listed("issue_ids"))


def run_plan(spark: SparkSession, path: str) -> DataFrame:
    """Requested runs of a run-plan TOML."""
    rows = tomls.listed(tomls.items(spark, path), ("runs",), "run_id string, benchmark_id string, command string, workdir string, env map<string,string>")
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("run_id", "benchmark_id", "command")], "workdir", F.coalesce("env", F.create_map().cast("map<string,string>")).alias("env"))


def integrations(spark: SparkSession, path: str) -> DataFrame:
    """Integrations of a TOML with the tools and environment variables that they need."""
    rows = tomls.listed(tomls.items(spark, path), ("integrations",), "benchmark_id string, required_binaries array<string>, required_env_vars array<string>")
    none = F.array().cast("array<string>")
    return rows.select(F.coalesce("benchmark_id", F.lit("")).alias("benchmark_id"), F.coalesce("required_binaries", none).alias("tools"), F.coalesce("required_env_vars", none).alias("env_vars"))


def catalog(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A benchmark catalog: benchmarks, metrics, components and targets as tables of (id, title, body)."""
    found = tomls.items(spark, path)
    table = lambda k: tomls.listed(found, (k,), "id string, title string, name string").toDF("file", "n", "kind", "body", "id", "title", "name")
    return {k: table(k).select(F.coalesce("id", F.lit("")).alias("id"), F.coalesce(F.nullif("title", F.lit("")), "name").alias("title"), "body") for k in ("benchmarks", "metrics", "components", "targets")}


def results(spark: SparkSession, path: str) -> DataFrame:
    """Runs of a results TOML, a row for each score."""
    rows = tomls.listed(tomls.items(spark, path), ("runs",), "run_id string, benchmark_id string, status string, scores array<struct<metric_id: string, metric: string, value: double, unit: string>>")
    text_ = lambda *c: F.coalesce(*c, F.lit(""))
    one = rows.select("run_id", "benchmark_id", "status", F.explode("scores").alias("s"))
    return one.select(text_("run_id").alias("run_id"), text_("benchmark_id").alias("benchmark_id"), text_("status").alias("status"), text_("s.metric_id", "s.metric").alias("metric"), F.coalesce("s.value", F.lit(0.0)).alias("value"), F.col("s.unit").alias("unit"))


def safe_member(path: Column | str) -> Column:
    """Whether an archive member stays inside the folder that it is unpacked to."""
    p = F.replace(text.col(path), F.lit("\\"), F.lit("/"))
    return (p != "") & ~F.startswith(p, F.lit("/")) & ~F.array_contains(F.split(p, "/"), "..")


def unpacked(archive: bytes, folder: str, overwrite: bool = False) -> list[str]:
    """Unpack a tar archive, plain or compressed, into ``folder``: the members that were written; one that would leave the folder is an error, files that are there stay unless ``overwrite``."""
    out = []
    with tarfile.open(fileobj=io.BytesIO(archive), mode="r:*") as tar:
        for m in tar.getmembers():
            parts = m.name.replace("\\", "/").split("/")
            if m.name.startswith("/") or ".." in parts or m.issym() or m.islnk():
                raise ValueError(f"unsafe member {m.name!r}")
            place = Path(folder, *[p for p in parts if p not in ("", ".")])
            if m.isfile() and (overwrite or not place.exists()):
                place.parent.mkdir(parents=True, exist_ok=True)
                place.write_bytes(tar.extractfile(m).read())
                out.append(str(place))
    return out


def graph_records(nodes: DataFrame, labels: list[str], group: str | None = None, prefixes: list[str] | None = None) -> DataFrame:
    """Nodes (id, labels, properties JSON) of some label, of a group and below path prefixes, by id; adds ``kind``, the first of the wanted labels, and ``props``."""
    n = nodes.withColumn("props", text.string_map("properties")).where(F.arrays_overlap("labels", F.array(*map(F.lit, labels))))
    if group is not None:
        n = n.where(F.col("props")["group_id"] == group)
    if prefixes:
        below = F.lit(False)
        for p in prefixes:
            for c in ("path", "relative_path"):
                below = below | F.coalesce(F.startswith(F.col("props")[c], F.lit(p)), F.lit(False))
        n = n.where(below)
    return n.withColumn("kind", F.get(F.filter("labels", lambda x: x.isin(labels)), F.lit(0))).orderBy("id")


def request_key(method: Column, url: Column, body: Column) -> Column:
    """Key of a request in a table of cached answers."""
    return F.sha2(F.concat_ws("\n", method, url, F.coalesce(body, F.lit(""))), 256)


def uncached(requests: DataFrame, cache: DataFrame) -> DataFrame:
    return requests.join(cache.select("request_key"), "request_key", "left_anti")
