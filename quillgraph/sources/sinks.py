"""Tables as files: JSON lines, CSV, Parquet, Markdown and graph bundles."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """JSON lines, sorted if ``order`` is given."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").json(path)


def flat(df: DataFrame) -> DataFrame:
    """Lists joined with ``|`` and nulls empty, as text formats need them."""
    one = lambda f: F.array_join(F.transform(f.name, lambda x: x.cast("string")), "|") if isinstance(f.dataType, ArrayType) else F.col(f.name).cast("string")
    return df.select(*[F.coalesce(one(f), F.lit("")).alias(f.name) for f in df.schema.fields])


def write_csv(df: DataFrame, path: str) -> None:
    flat(df).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)


def export_all(tables: dict[str, DataFrame], root: str) -> dict[str, str]:
    """All tables in all formats; gives each file's place."""
    out = {}
    for name, df in tables.items():
        for kind, write in (("jsonl", write_jsonl), ("csv", write_csv), ("parquet", write_parquet)):
            out[f"{name}.{kind}"] = f"{root}/{kind}/{name}"
            write(df, out[f"{name}.{kind}"])
    return out


def markdown(title: Column, authors: Column, abstract: Column, sections: Column, citations: Column) -> Column:
    """A document as Markdown: title, authors, abstract, sections by level, citations."""
    part = lambda head, body: F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(head), body))
    body = F.array_join(F.transform(sections, lambda s: F.concat(F.repeat(F.lit("#"), F.greatest(s.level, F.lit(1)) + 1), F.lit(" "), s.title, F.lit("\n\n"), s.content)), "\n\n")
    cites = F.array_join(F.transform(citations, lambda c: F.concat(F.lit("- @"), c)), "\n")
    return F.concat_ws("\n\n", F.concat(F.lit("# "), title), part("Authors: ", F.array_join(authors, ", ")), part("## Abstract\n\n", abstract), body, part("## Citations\n\n", cites))


def corpus_index(docs: DataFrame, id_col: str = "paper_id", title_col: str = "title") -> DataFrame:
    """One row: an index of all documents, by id."""
    line = F.concat(F.lit("- ["), F.col(title_col), F.lit("]("), F.col(id_col), F.lit(".md)"))
    return docs.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(id_col).alias("id"), line.alias("line")))), lambda x: x.line), "\n").alias("index"))


def deterministic_json(df: DataFrame) -> list[str]:
    """A small table as sorted JSON texts, for comparison."""
    return sorted(df.toJSON().collect())


def toml_value(value: object) -> str:
    """A text, number, truth value or list of them as TOML."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(toml_value, value)) + "]"
    return json.dumps(value, ensure_ascii=False) if isinstance(value, str) else repr(value)


def results_toml(runs: list[dict]) -> str:
    """Benchmark runs (run_id, benchmark_id, status, summary, scores of metric_id, value, unit) as a results file."""
    parts = []
    for run in runs:
        parts.append("[[runs]]\n" + "".join(f"{k} = {toml_value(v)}\n" for k, v in run.items() if k != "scores" and v is not None))
        parts += ["[[runs.scores]]\n" + "".join(f"{k} = {toml_value(v)}\n" for k, v in s.items() if v is not None) for s in run.get("scores", [])]
    return "\n".join(parts)


def write_results(runs: list[dict], df: DataFrame, path: str) -> None:
    """A results file through Spark's file systems; ``df`` gives the session."""
    df.sparkSession.createDataFrame([(results_toml(runs),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_graph(mode: str, docs: Callable[[], None], graph: Callable[[], None]) -> list[str]:
    """Write what a sink mode asks for: ``docs``, ``graph`` or ``both``; gives what was written."""
    wanted = {"docs": ["docs"], "graph": ["graph"], "both": ["docs", "graph"]}
    if mode not in wanted:
        raise ValueError(f"unknown sink {mode!r}; expected one of: {', '.join(wanted)}")
    for name in wanted[mode]:
        {"docs": docs, "graph": graph}[name]()
    return wanted[mode]


def structured(df: DataFrame, form: str, rows: int = 1000) -> str:
    """The first rows of a result as ``json`` (a list of objects) or ``text`` (a table)."""
    if form == "json":
        return "[" + ",".join(df.limit(rows).toJSON().collect()) + "]"
    if form == "text":
        shown = df.limit(rows).collect()
        return "\n".join([" | ".join(df.columns), *(" | ".join("" if v is None else str(v) for v in r) for r in shown)])
    raise ValueError(f"unknown form {form!r}; expected json or text")
