"""Results as text and Markdown for people to read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def _or_na(c: Column | str) -> Column:
    return F.coalesce(text.col(c).cast("string"), F.lit("n/a"))


def _lines(*parts: Column) -> Column:
    return F.concat_ws("\n", *parts)


def _joined(df: DataFrame, group: list[str], order: list[str], line: Column, glue: str, name: str) -> DataFrame:
    """Lines of a group in order, in one text; as large as what is shown."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order)).alias("_n")
    rows = df.select(*group, place, line.alias("_line"))
    return rows.groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_line"))), lambda x: x["_line"]), glue).alias(name))


def authors(names: Column | str) -> Column:
    names = text.col(names)
    return F.when(F.coalesce(F.size(names), F.lit(0)) > 0, F.array_join(names, ", ")).otherwise("n/a")


def paper(title: Column, paper_id: Column, year: Column, citations: Column, references: Column, venue: Column, names: Column, tldr: Column, abstract: Column) -> Column:
    """A paper of the metadata service."""
    head = F.concat(F.coalesce(title, F.lit("untitled")), F.lit(" ("), F.coalesce(paper_id, F.lit("no paperId")), F.lit(")"))
    counts = F.concat(F.lit("year: "), _or_na(year), F.lit(" | citations: "), _or_na(citations), F.lit(" | references: "), _or_na(references))
    more = [F.when(c.isNotNull(), F.concat(F.lit(f"{name}: "), c)) for name, c in (("tldr", tldr), ("abstract", abstract))]
    return _lines(head, counts, F.concat(F.lit("venue: "), _or_na(venue)), F.concat(F.lit("authors: "), authors(names)), *more)


def counts_table(rows: DataFrame, group: str, key: str, n: str, head: tuple[str, str]) -> DataFrame:
    """``group, table``: each group's counts as a Markdown table, by key."""
    line = F.concat(F.lit("| "), F.col(key).cast("string"), F.lit(" | "), F.col(n).cast("string"), F.lit(" |"))
    body = _joined(rows, [group], [key], line, "\n", "body")
    return body.select(group, F.concat(F.lit(f"| {head[0]} | {head[1]} |\n| --- | --- |\n"), "body").alias("table"))


def hits(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``group, text``: search hits (title, id, score, matched_fields, snippet), numbered."""
    numbered = rows.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    line = F.concat(F.col("_k").cast("string"), F.lit(". "), F.col("title"), F.lit(" ("), F.col("id").cast("string"), F.lit(")\n   score: "), F.col("score").cast("string"), F.lit(" | fields: "), F.col("matched_fields"), F.lit("\n   "), F.col("snippet"))
    return _joined(numbered, [group], ["_k"], line, "\n\n", "text")


def score_summary(scores: Column | str) -> Column:
    """``metric=value unit`` of each score (metric, value, unit)."""
    scores = text.col(scores)
    listed = F.array_join(F.transform(scores, lambda s: F.concat(s.metric, F.lit("="), s.value.cast("string"), F.lit(" "), s.unit)), ", ")
    return F.when(F.coalesce(F.size(scores), F.lit(0)) > 0, listed).otherwise("no scores recorded")


def _run_line(r: Column) -> Column:
    return F.concat(F.lit("- `"), r.run_id, F.lit("` on `"), r.benchmark_id, F.lit("` ["), r.status, F.lit("]: "), score_summary(r.scores))


def target_markdown(title: Column, summary: Column, benchmarks: Column, runs: Column, components: Column) -> Column:
    """A promoted target: benchmarks (id, best_use, task_scale), runs (run_id, benchmark_id, status, scores), components (title, prompt)."""
    b = F.transform(benchmarks, lambda x: F.concat(F.lit("- `"), x.id, F.lit("`: "), x.best_use, F.lit(". Task scale: "), x.task_scale))
    results = F.when(F.size(runs) > 0, F.concat(F.lit("\n## Available Results\n\n"), F.array_join(F.transform(runs, _run_line), "\n")))
    c = F.transform(components, lambda x, i: F.concat(F.lit("### "), (i + 1).cast("string"), F.lit(". "), x.title, F.lit("\n\n"), x.prompt, F.lit("\n")))
    return _lines(F.concat(F.lit("# Auto Research Target: "), title), F.lit(""), summary, F.lit("\n## Selected Benchmarks\n"), F.array_join(b, "\n"), results, F.lit("\n## Concatenated Components\n"), F.array_join(c, "\n"))


def target_issue(title: Column, summary: Column, benchmarks: Column, runs: Column, components: Column) -> Column:
    """The same target as an issue: benchmarks (id, summary), components by title."""
    b = F.transform(benchmarks, lambda x: F.concat(F.lit("- `"), x.id, F.lit("`: "), x.summary))
    results = F.when(F.size(runs) > 0, F.concat(F.lit("\n## Available Results\n"), F.array_join(F.transform(runs, _run_line), "\n")))
    c = F.transform(components, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x.title))
    return _lines(F.concat(F.lit("Title: Auto Research: "), title), F.lit("\n## Summary"), summary, F.lit("\n## Selected Benchmarks"), F.array_join(b, "\n"), results, F.lit("\n## Proposed Work"), F.array_join(c, "\n"))


def capability_line(name: Column | str, state: Column, details: dict[str, Column]) -> Column:
    """``name: state (key=value, ...)``; yes or no for truth values must be texts already."""
    listed = F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in details.items()])
    return F.concat(F.lit(name) if isinstance(name, str) else name, F.lit(": "), state, F.lit(" ("), listed, F.lit(")"))


def yes_no(c: Column) -> Column:
    return F.when(c, "yes").otherwise("no")
