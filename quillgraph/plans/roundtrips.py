"""Sources and sinks on files made of whole tables: what is read back must be what the tables hold."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bench, capabilities, episodes, graph, memory, registry as papers_registry, tabular
from ..operators.storage import shared_dir
from ..sources import bibtex, files, markdown, notebooks, pycode, service, sinks, tex, tomls
from .hosts import table
from .registry import register


def _filled(template: str, **columns: F.Column) -> F.Column:
    """A text with ``<name>`` replaced by columns."""
    out = F.lit(template)
    for name, c in columns.items():
        out = F.replace(out, F.lit(f"<{name}>"), c.cast("string"))
    return out


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _parts(spark: SparkSession, sf_dir: str, path: str, template: str) -> DataFrame:
    """A file for each part."""
    fill = {"k": F.col("p_partkey"), "name": F.col("p_name"), "brand": F.col("p_brand"), "type": F.col("p_type")}
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), _filled(path, **fill).alias("path"), _filled(template, **fill).alias("text"))


def _key(c: str = "path") -> F.Column:
    return F.regexp_extract(c, r"(\d+)", 1).cast("long")


_BIB = """% a remark
@Article{key<k>,
  title = {<name> {nested} words},
  author = "<brand> and Jane Doe",
  year = 1999,
}
@comment{nothing}
@misc(m<k>, note = {<type>})
"""


@register(
    "bibtex_entries",
    """SELECT p_partkey AS k, 0 AS pos, 'article' AS entry_type, 'key' || p_partkey AS citation_key, p_name || ' {nested} words' AS title, p_brand || ' and Jane Doe' AS author, '1999' AS year, NULL AS note FROM part
UNION ALL SELECT p_partkey, 1, 'misc', 'm' || p_partkey, NULL, NULL, NULL, p_type FROM part""",
)
def bibtex_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = bibtex.entries_of(_parts(spark, sf_dir, "b<k>.bib", _BIB))
    f = F.col("fields")
    return e.select(_key().alias("k"), "pos", "entry_type", "citation_key", *[f[c].alias(c) for c in ("title", "author", "year", "note")])


_MARKDOWN = """---
title: "T <name>"
authors: [Ann <k>, 'Bob']
date: 2024-05-06
kind: note
---
intro <type>

# One

first <brand>
second @cite<k>

```
# no heading
```
## Two
<think>why</think>
end
"""


@register(
    "markdown_sections",
    """SELECT p_partkey AS k, 'T ' || p_name AS title, 'Ann ' || p_partkey || '|Bob' AS authors, '2024' AS year, 'note' AS kind, 'cite' || p_partkey AS citations, s.i AS section_index, s.level, s.title AS section_title,
  CASE s.i WHEN 0 THEN 'intro ' || p_type WHEN 1 THEN 'first ' || p_brand || chr(10) || 'second @cite' || p_partkey || chr(10) || '# no heading' ELSE '[Reasoning: why]' || chr(10) || 'end' END AS content
FROM part, (VALUES (0, 0, ''), (1, 1, 'One'), (2, 2, 'Two')) s(i, level, title)""",
)
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = files.parsed(_parts(spark, sf_dir, "n<k>.md", _MARKDOWN), markdown.document, markdown.schemas.DOCUMENT)
    d = d.select(_key().alias("k"), "title", F.array_join("authors", "|").alias("authors"), "year", "kind", F.array_join("citations", "|").alias("citations"), F.posexplode("sections").alias("section_index", "s"))
    return d.select("k", "title", "authors", "year", "kind", "citations", "section_index", F.col("s.level").alias("level"), F.col("s.title").alias("section_title"), F.col("s.content").alias("content"))


_MEMORY = """---
title: State <k>
---
# H

## Facts

- first <brand>, see [it](docs/<k>.md) and `pkg.mod<k>`
- second <!-- supersedes: old-<k>, older -->

## Notes

plain <type> of @key<k>
"""


@register(
    "memory_files",
    """SELECT p_partkey AS k, 'State ' || p_partkey AS title, s.section, s.kind, s.ordinal, s.a AS line_start, s.b AS line_end, s.supersedes || CASE WHEN s.supersedes <> '' THEN p_partkey || '|older' ELSE '' END AS supersedes,
  CASE s.n WHEN 0 THEN 'first ' || p_brand || ', see [it](docs/' || p_partkey || '.md) and `pkg.mod' || p_partkey || '`' WHEN 1 THEN 'second' ELSE 'plain ' || p_type || ' of @key' || p_partkey END AS text
FROM part, (VALUES (0, 'Facts', 'bullet', 1, 8, 8, ''), (1, 'Facts', 'bullet', 2, 9, 9, 'old-'), (2, 'Notes', 'section', NULL, 12, 13, '')) s(n, section, kind, ordinal, a, b, supersedes)""",
)
def memory_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = files.parsed(_parts(spark, sf_dir, "m<k>.md", _MEMORY), markdown.memory_nodes, markdown.schemas.MEMORY)
    return m.select(_key().alias("k"), "title", "section", "kind", "ordinal", "line_start", "line_end", F.array_join("supersedes", "|").alias("supersedes"), "text")


@register(
    "memory_references",
    """SELECT p_partkey AS k, s.section, s.raw || p_partkey || s.tail AS raw, s.kind FROM part,
  (VALUES ('Facts', 'docs/', '.md', 'path'), ('Facts', 'pkg.mod', '', 'symbol'), ('Notes', 'key', '', 'citation_key')) s(section, raw, tail, kind)""",
)
def memory_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = files.parsed(_parts(spark, sf_dir, "m<k>.md", _MEMORY), markdown.memory_nodes, markdown.schemas.MEMORY)
    return markdown.reference_candidates(m).select(_key().alias("k"), "section", "raw", "kind")


_NOTES = """# Contracts

## Frames

- a bullet
Frames of <name>.

## Units <k>
:directive
Units of <type>.

```bash
# build all
make build-<k>
$ make test
```
"""


@register(
    "contract_sections",
    """SELECT p_partkey AS k, 'Frames' AS title, 'Frames of ' || p_name || '.' AS summary, 3 AS line_start, 7 AS line_end FROM part
UNION ALL SELECT p_partkey, 'Units ' || p_partkey, 'Units of ' || p_type || '.', 8, 16 FROM part""",
)
def contract_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = files.parsed(_parts(spark, sf_dir, "c<k>.md", _NOTES), markdown.contract_sections, "path string, title string, summary string, line_start long, line_end long")
    return c.select(_key().alias("k"), "title", "summary", "line_start", "line_end")


@register("make_and_commands", "SELECT p_partkey AS k, 'target' AS kind, 'build-' || p_partkey AS name, 'Build ' || p_name AS description FROM part UNION ALL SELECT p_partkey, 'command', 'make build-' || p_partkey, 'build all' FROM part")
def make_and_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    makefile = "# notes\nbuild-<k>: deps ## Build <name>\n\trun\n_inner: ## hidden\nplain:\n\trun\n"
    t = files.parsed(_parts(spark, sf_dir, "<k>.mk", makefile), markdown.targets_of, "path string, name string, description string")
    c = files.parsed(_parts(spark, sf_dir, "c<k>.md", _NOTES), markdown.commands_of, "path string, description string, command string")
    return t.select(_key().alias("k"), F.lit("target").alias("kind"), "name", "description").unionByName(c.select(_key().alias("k"), F.lit("command").alias("kind"), F.col("command").alias("name"), "description"))


_TEX = r"""\documentclass{article} % main
\title[Short]{On \emph{<name>}}
\begin{document}
\begin{abstract}About <type>. % hidden
\end{abstract}
\section{First <brand>}
Text \cite{b<k>, a}. \input{part}
\begin{figure}\includegraphics{x}\caption{A <brand> figure}\end{figure}
\begin{table}\caption[s]{Numbers <k>}\end{table}
\end{document}
"""
_TEX_PART = r"""\subsection*{Deep}
more \citep[see][p. 2]{c<k>} \input{missing}
"""


@register(
    "tex_papers",
    """SELECT p_partkey AS k, 'On ' || p_name AS title, 'About ' || p_type || '.' AS abstract, '1:First ' || p_brand || '|2:Deep' AS headings, 'A ' || p_brand || ' figure' AS figures, 'Numbers ' || p_partkey AS tables, 'a|b' || p_partkey || '|c' || p_partkey AS citations FROM part""",
)
def tex_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    main, part = (_parts(spark, sf_dir, f"p<k>/{name}.tex", body).withColumn("folder", F.concat(F.lit("p"), F.col("k").cast("string"))) for name, body in (("main", _TEX), ("part", _TEX_PART)))
    p = tex.papers_of(main.unionByName(part).select("folder", "path", "text"))
    headings = F.array_join(F.transform("sections", lambda s: F.concat_ws(":", s.level.cast("string"), s.title)), "|")
    return p.select(_key().alias("k"), "title", "abstract", headings.alias("headings"), *[F.array_join(c, "|").alias(c) for c in ("figures", "tables", "citations")])


@register(
    "cited_references",
    "SELECT p_partkey AS k, 'b' || p_partkey AS citation_key, 'T ' || p_name AS title, '10.1234/x' || p_partkey AS doi, NULL AS arxiv_id FROM part UNION ALL SELECT p_partkey, 'c' || p_partkey, NULL, NULL, '2401.00001' FROM part",
)
def cited_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    main = _parts(spark, sf_dir, "p<k>/main.tex", _TEX.replace(r"\input{part}", r"\citet{c<k>}")).withColumn("folder", F.concat(F.lit("p"), F.col("k").cast("string")))
    bib = bibtex.entries_of(_parts(spark, sf_dir, "p<k>", "@misc{b<k>, title={T <name>}, url={https://doi.org/10.1234/X<k>.}}\n@misc{c<k>, journal={arXiv:2401.00001}}\n@misc{uncited, title={no}}"))
    return tex.cited_references(tex.papers_of(main.select("folder", "path", "text")), bib).select(_key().alias("k"), "citation_key", "title", "doi", "arxiv_id")


_CODE = '''import os.path as p
from .util import helper


class A<k>(Base):
    """Doc <k>.

    More.
    """

    def run(self, x: int) -> int:
        return self.step(x) + helper(x)

    def step(self, x):
        return x


def helper<k>(y=1):
    return A<k>().run(y) + p.join(y)
'''


def _code(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    rows = table(spark, sf_dir, "supplier").select(_filled("pkg<k>/mod.py", k=F.col("s_suppkey")).alias("path"), _filled(_CODE, k=F.col("s_suppkey")).alias("text"))
    t = pycode.code_tables(rows)
    return t | {"imports": pycode.resolve_imports(t["imports"], t["symbols"]), "calls": pycode.resolve_calls(t["calls"], t["imports"], t["symbols"])}


_MOD = "'pkg' || s_suppkey || '.mod'"


@register(
    "code_symbols",
    f"""SELECT s_suppkey AS k, {_MOD} AS module, CASE s.n WHEN 0 THEN 'A' || s_suppkey WHEN 1 THEN 'run' WHEN 2 THEN 'step' ELSE 'helper' || s_suppkey END AS name, s.kind, s.a AS line_start, s.b AS line_end, CASE WHEN s.n = 0 THEN 'Doc ' || s_suppkey || '.' END AS doc_summary,
  CASE s.n WHEN 0 THEN 'class A' || s_suppkey || '(Base)' WHEN 1 THEN 'def run(self, x: int) -> int' WHEN 2 THEN 'def step(self, x)' ELSE 'def helper' || s_suppkey || '(y=1)' END AS signature,
  {_MOD} || CASE WHEN s.n IN (1, 2) THEN '.A' || s_suppkey ELSE '' END AS parent, 19 AS lines
FROM supplier, (VALUES (0, 'class', 5, 15), (1, 'method', 11, 12), (2, 'method', 14, 15), (3, 'function', 18, 19)) s(n, kind, a, b)""",
)
def code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _code(spark, sf_dir)
    return t["symbols"].join(t["files"], "path").select(_key().alias("k"), "module", "name", "kind", "line_start", "line_end", "doc_summary", "signature", "parent", "lines")


@register(
    "code_edges",
    f"""SELECT s_suppkey AS k, s.kind, CASE s.n WHEN 0 THEN 'os.path' WHEN 1 THEN 'pkg' || s_suppkey || '.util.helper' WHEN 2 THEN 'self.step' WHEN 3 THEN 'helper' WHEN 4 THEN 'A' || s_suppkey ELSE 'p.join' END AS target, s.line,
  CASE s.n WHEN 2 THEN {_MOD} || '.A' || s_suppkey || '.step' WHEN 4 THEN {_MOD} || '.A' || s_suppkey END AS resolved
FROM supplier, (VALUES (0, 'import', 1), (1, 'import', 2), (2, 'call', 12), (3, 'call', 12), (4, 'call', 19), (5, 'call', 19)) s(n, kind, line)""",
)
def code_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _code(spark, sf_dir)
    return t["imports"].select(_key().alias("k"), F.lit("import").alias("kind"), "target", "line", "resolved").unionByName(t["calls"].select(_key().alias("k"), F.lit("call").alias("kind"), "target", "line", "resolved"))


@register(
    "code_graph",
    f"""WITH n AS (SELECT 'code_file:pkg' || s_suppkey || '/mod.py' AS id, 'CodeFile' AS label FROM supplier UNION ALL SELECT 'code_module:' || {_MOD}, 'CodeModule' FROM supplier
  UNION ALL SELECT 'code_symbol:' || {_MOD} || s.x, 'CodeSymbol' FROM supplier, LATERAL (SELECT unnest(['.A' || s_suppkey, '.A' || s_suppkey || '.run', '.A' || s_suppkey || '.step', '.helper' || s_suppkey]) AS x) s
  UNION SELECT 'code_reference:os.path', 'CodeReference' UNION ALL SELECT 'code_reference:pkg' || s_suppkey || '.util.helper', 'CodeReference' FROM supplier)
SELECT 'node' AS what, label AS kind, count(*) AS n FROM n GROUP BY label
UNION ALL SELECT 'edge', 'CONTAINS', 5 * count(*) FROM supplier UNION ALL SELECT 'edge', 'IMPORTS', 2 * count(*) FROM supplier UNION ALL SELECT 'edge', 'CALLS', 2 * count(*) FROM supplier""",
)
def code_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = tabular.code_graph(_code(spark, sf_dir))
    n = nodes.select("id", F.get("labels", F.lit(0)).alias("kind")).distinct().groupBy(F.lit("node").alias("what"), "kind").agg(F.count(F.lit(1)).alias("n"))
    return n.unionByName(edges.groupBy(F.lit("edge").alias("what"), F.col("rel_type").alias("kind")).agg(F.count(F.lit(1)).alias("n")))


@register(
    "notebook_cells",
    """SELECT 'nb-' || conv_id AS notebook_id, 'py' AS kernel, 'python' AS language, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS index, CASE role WHEN 'user' THEN 'markdown' WHEN 'assistant' THEN 'code' ELSE 'raw' END AS kind, coalesce(text, '') AS source FROM conversations""",
)
def notebook_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as notebooks: even turns' texts stand as one text, others as a list of one."""
    one = F.to_json(F.array(F.coalesce("text", F.lit(""))))
    source = F.when(F.col("turn") % 2 == 0, F.substring(one, F.lit(2), F.length(one) - 2)).otherwise(one)
    kind = F.when(F.col("role") == "user", "markdown").when(F.col("role") == "assistant", "code").otherwise("other")
    cell = F.concat(F.lit('{"cell_type": "'), kind, F.lit('", "source": '), source, F.lit("}"))
    n = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", cell.alias("cell")))).alias("cells"))
    head = F.lit('{"metadata": {"kernelspec": {"name": "py"}, "language_info": {"name": "python"}}, "cells": [')
    n = n.select(F.concat(F.lit("a/nb_"), F.col("conv_id").cast("string"), F.lit(".ipynb")).alias("path"), F.concat(head, F.array_join(F.transform("cells", lambda c: c.cell), ","), F.lit("]}")).alias("text"))
    return notebooks.decode(n).select("notebook_id", "kernel", "language", F.explode("cells").alias("c")).select("notebook_id", "kernel", "language", "c.*")


def _toml(df: DataFrame, spark: SparkSession, template: str, **columns: F.Column) -> str:
    """A TOML file with a block for each row, in the shared folder."""
    path = _folder(spark, "toml")
    df.select(_filled(template, **columns).alias("value")).write.text(path)
    return path


def _backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    state = F.when(F.col("n_nationkey") % 4 == 0, "closed").otherwise("open")
    level = F.element_at(F.array(*map(F.lit, ("low", "high", "P0"))), (F.col("n_nationkey") % 3 + 1).cast("int"))
    issues = _toml(n, spark, '[[issue]]\nid = "I<k>"\ntitle = "<name>"\nstatus = "<state>"\npriority = "<level>"\nreferences = ["docs/A <region>.md"]\n', k=F.col("n_nationkey"), name=F.col("n_name"), state=state, level=level, region=F.col("n_regionkey"))
    todos = _toml(s, spark, '[[todos]]\nid = "T<k>"\ntitle = "<name>"\nstatus = "<state>"\npriority = "medium"\nissue_ids = ["I<nation>"]\n', k=F.col("s_suppkey"), name=F.col("s_name"), state=F.when(F.col("s_suppkey") % 5 == 0, "done").otherwise("open"), nation=F.col("s_nationkey"))
    return files.backlog(spark, issues).unionByName(files.backlog(spark, todos))


@register(
    "backlog_rows",
    """SELECT 'issue' AS kind, 'I' || n_nationkey AS id, n_name AS title, CASE n_nationkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 0 END AS rank FROM nation WHERE n_nationkey % 4 <> 0
UNION ALL SELECT 'todo', 'T' || s_suppkey, s_name, 2 FROM supplier WHERE s_suppkey % 5 <> 0""",
)
def backlog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.open_backlog(_backlog(spark, sf_dir)).select("kind", "id", "title", "rank")


@register(
    "backlog_graph",
    """WITH i AS (SELECT * FROM nation WHERE n_nationkey % 4 <> 0), t AS (SELECT * FROM supplier WHERE s_suppkey % 5 <> 0)
SELECT 'backlog:issue:I' || n_nationkey AS source, 'REFERENCES' AS rel_type, 'backlog_ref:docs-a-' || n_regionkey || '-md' AS target FROM i
UNION ALL SELECT 'backlog:todo:T' || s_suppkey, 'ADDRESSES', 'backlog:issue:I' || s_nationkey FROM t JOIN i ON n_nationkey = s_nationkey
UNION ALL SELECT 'backlog:issue:I' || n_nationkey, 'AgentBacklogIssue', n_name FROM i UNION ALL SELECT 'backlog:todo:T' || s_suppkey, 'AgentBacklogTodo', s_name FROM t
UNION ALL SELECT DISTINCT 'backlog_ref:docs-a-' || n_regionkey || '-md', 'BacklogReference', 'docs-a-' || n_regionkey || '-md' FROM i""",
)
def backlog_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges, and nodes with their label and title."""
    rows = _backlog(spark, sf_dir)
    nodes, edges = tabular.backlog_graph(rows, memory.backlog_edges(rows))
    view = tabular.node_view(nodes).select(F.col("id").alias("source"), F.col("kind").alias("rel_type"), F.col("title").alias("target"))
    return edges.unionByName(view)


@register(
    "benchmark_files",
    """SELECT 'result' AS what, 'r' || n_nationkey AS a, 'b' || n_regionkey AS b, 'acc=' || (n_nationkey + 0.5)::DOUBLE AS c FROM nation UNION ALL SELECT 'plan', 'p' || n_nationkey, 'b' || n_regionkey, 'run ' || n_name || ' SEED=' || n_nationkey FROM nation
UNION ALL SELECT 'integration', 'b' || r_regionkey, 'git|uv', 'TOKEN' FROM region UNION ALL SELECT 'benchmarks', 'b' || r_regionkey, r_name, '' FROM region""",
)
def benchmark_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results, run plan, integrations and catalog as TOML."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    k, region = F.col("n_nationkey"), F.col("n_regionkey")
    results = files.results(spark, _toml(n, spark, '[[runs]]\nrun_id = "r<k>"\nbenchmark_id = "b<r>"\nstatus = "completed"\n[[runs.scores]]\nmetric_id = "acc"\nvalue = <k>.5\nunit = "share"\n', k=k, r=region))
    plan = files.run_plan(spark, _toml(n, spark, '[[runs]]\nrun_id = "p<k>"\nbenchmark_id = "b<r>"\ncommand = "run <name>"\nenv = { SEED = "<k>" }\n', k=k, r=region, name=F.col("n_name")))
    needs = files.integrations(spark, _toml(r, spark, '[[integrations]]\nbenchmark_id = "b<k>"\nrequired_binaries = ["git", "uv"]\nrequired_env_vars = ["TOKEN"]\n', k=F.col("r_regionkey")))
    catalog = files.catalog(spark, _toml(r, spark, '[[benchmarks]]\nid = "b<k>"\nname = "<name>"\n', k=F.col("r_regionkey"), name=F.col("r_name")))["benchmarks"]
    row = lambda df, what, a, b, c: df.select(F.lit(what).alias("what"), F.col(a).alias("a"), b.alias("b"), c.alias("c"))
    return (
        row(results, "result", "run_id", F.col("benchmark_id"), F.concat(F.col("metric"), F.lit("="), F.col("value").cast("string")))
        .unionByName(row(plan, "plan", "run_id", F.col("benchmark_id"), F.concat(F.col("command"), F.lit(" SEED="), F.col("env")["SEED"])))
        .unionByName(row(needs, "integration", "benchmark_id", F.array_join("tools", "|"), F.array_join("env_vars", "|")))
        .unionByName(row(catalog, "benchmarks", "id", F.col("title"), F.lit("")))
    )


@register(
    "results_sink",
    "SELECT 'r' || n_nationkey AS run_id, 'b' || n_regionkey AS benchmark_id, 'completed' AS status, 'acc' AS metric, n_nationkey / 4.0::DOUBLE AS value, 'a \"b\"' AS unit FROM nation",
)
def results_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written as TOML and read again."""
    k = F.col("n_nationkey")
    score = F.struct(F.lit("acc").alias("metric_id"), (k / 4).alias("value"), F.lit('a "b"').alias("unit"))
    name = lambda start, c: F.concat(F.lit(start), F.col(c).cast("string"))
    runs = table(spark, sf_dir, "nation").select(name("r", "n_nationkey").alias("run_id"), name("b", "n_regionkey").alias("benchmark_id"), F.lit("completed").alias("status"), F.array(score).alias("scores"))
    path = _folder(spark, "results")
    tomls.write_runs(runs, path)
    return files.results(spark, path)


@register(
    "manifest_rows",
    """SELECT '24' || s_suppkey AS arxiv_id, CASE WHEN s_suppkey % 3 = 0 THEN 'https://example.org/' || s_suppkey ELSE 'https://arxiv.org/e-print/24' || s_suppkey END AS source_url,
  CASE WHEN s_suppkey % 2 = 0 THEN 'https://arxiv.org/pdf/24' || s_suppkey || '.pdf' END AS pdf_url, s_name AS title FROM supplier""",
)
def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest written as JSON lines and read again."""
    k, path = F.col("s_suppkey"), _folder(spark, "manifest")
    m = table(spark, sf_dir, "supplier").select(F.concat(F.lit("24"), k.cast("string")).alias("arxiv_id"), F.col("s_name").alias("title"), F.when(k % 2 == 0, "x.pdf").alias("pdf_file"), F.when(k % 3 == 0, F.concat(F.lit("https://example.org/"), k.cast("string"))).alias("source_url"))
    sinks.write_jsonl(m, path, ["arxiv_id"])
    return files.manifest(spark, path).select("arxiv_id", "source_url", "pdf_url", "title")


@register(
    "registry_rows",
    "SELECT 'p' || s_suppkey AS paper_id, s_name AS title, 'A|B' || s_suppkey AS authors, s_suppkey % 2 = 0 AS has_local_tex, CASE WHEN s_suppkey % 3 = 0 THEN 'S' || s_suppkey END AS service_title FROM supplier",
)
def registry_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry written as JSON lines and read again, nested rows and all."""
    k, path = F.col("s_suppkey"), _folder(spark, "registry")
    known = F.when(k % 3 == 0, F.struct(F.concat(F.lit("S"), k.cast("string")).alias("title"), F.create_map(F.lit("DOI"), F.lit("1")).alias("externalIds")))
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("p"), k.cast("string")).alias("paper_id"), F.col("s_name").alias("title"), F.array(F.lit("A"), F.concat(F.lit("B"), k.cast("string"))).alias("authors"), (k % 2 == 0).alias("has_local_tex"), known.alias("semantic_scholar"))
    sinks.write_jsonl(rows, path, ["paper_id"])
    return files.registry(spark, path).select("paper_id", "title", F.array_join("authors", "|").alias("authors"), "has_local_tex", F.col("semantic_scholar.title").alias("service_title"))


@register(
    "glossary_rows",
    "SELECT 'g' || s_suppkey AS id, s_name AS label FROM supplier WHERE s_suppkey % 3 <> 0",
)
def glossary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, path = F.col("s_suppkey"), _folder(spark, "glossary")
    sinks.write_jsonl(table(spark, sf_dir, "supplier").select(F.when(k % 3 != 0, F.concat(F.lit("g"), k.cast("string"))).alias("id"), F.col("s_name").alias("label")), path)
    return files.glossary(spark, path).select("id", "label")


@register(
    "graph_bundle",
    """SELECT 'supplier:' || s_suppkey AS id, 'Paper|Other' AS labels, s_name AS title, '' AS target FROM supplier UNION ALL SELECT 'supplier:' || s_suppkey, 'IN_NATION', CAST(s_suppkey AS VARCHAR), 'nation:' || s_nationkey FROM supplier""",
)
def graph_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges written as a bundle and read again."""
    s, path = table(spark, sf_dir, "supplier"), _folder(spark, "bundle")
    node = F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string"))
    nodes = s.select(node.alias("id"), F.array(F.lit("Paper"), F.lit("Other")).alias("labels"), F.to_json(F.struct(F.col("s_name").alias("title"))).alias("properties"))
    edges = s.select(node.alias("source"), F.concat(F.lit("nation:"), F.col("s_nationkey").cast("string")).alias("target"), F.lit("IN_NATION").alias("rel_type"), F.to_json(F.struct(F.col("s_suppkey").alias("k"))).alias("properties"))
    sinks.write_graph("graph", lambda: None, lambda: graph.write_bundle(nodes, edges, path))
    n, e = files.graph_bundle(spark, path)
    n = files.graph_records(n, ["Paper"]).select("id", F.array_join("labels", "|").alias("labels"), F.col("props")["title"].alias("title"), F.lit("").alias("target"))
    return n.unionByName(e.select(F.col("source").alias("id"), F.col("rel_type").alias("labels"), F.get_json_object("properties", "$.k").alias("title"), "target"))


@register(
    "exported_tables",
    """SELECT f.form, CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 4 = 0 AND f.form <> 'csv' THEN NULL WHEN p_partkey % 4 = 0 THEN '' ELSE p_name END AS title, p_brand || '|' || p_type AS tags FROM part, (VALUES ('jsonl'), ('csv'), ('parquet')) f(form)""",
)
def exported_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table exported in all formats and read again."""
    k = F.col("p_partkey")
    t = table(spark, sf_dir, "part").select(k.alias("id"), F.when(k % 4 != 0, F.col("p_name")).alias("title"), F.array("p_brand", "p_type").alias("tags"))
    places = sinks.export_all({"papers": t}, _folder(spark, "export"))
    read = {"jsonl": spark.read.schema(t.schema).json(places["papers.jsonl"]), "parquet": spark.read.parquet(places["papers.parquet"])}
    out = spark.read.option("header", True).option("emptyValue", "").option("nullValue", "\0").csv(places["papers.csv"]).select(F.lit("csv").alias("form"), "id", F.coalesce("title", F.lit("")).alias("title"), "tags")
    for form, df in read.items():
        out = out.unionByName(df.select(F.lit(form).alias("form"), F.col("id").cast("string").alias("id"), "title", F.array_join("tags", "|").alias("tags")))
    return out


@register(
    "rendered_documents",
    """SELECT p_partkey AS k, '# ' || p_name || chr(10) || chr(10) || 'Authors: A, B' || chr(10) || chr(10) || CASE WHEN p_partkey % 2 = 0 THEN '## Abstract' || chr(10) || chr(10) || p_type || chr(10) || chr(10) ELSE '' END
  || '## One' || chr(10) || chr(10) || p_brand || chr(10) || chr(10) || '### Two' || chr(10) || chr(10) || 'x' || chr(10) || chr(10) || '## Citations' || chr(10) || chr(10) || '- @a' || chr(10) || '- @b' AS body FROM part""",
)
def rendered_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    section = lambda level, title, content: F.struct(F.lit(level).alias("level"), F.lit(title).alias("title"), content.alias("content"))
    texts = lambda *xs: F.array(*map(F.lit, xs))
    body = sinks.markdown(F.col("p_name"), texts("A", "B"), F.when(k % 2 == 0, F.col("p_type")), F.array(section(1, "One", F.col("p_brand")), section(2, "Two", F.lit("x"))), texts("a", "b"))
    return table(spark, sf_dir, "part").select(k.alias("k"), body.alias("body"))


@register("corpus_index", "SELECT string_agg('- [' || s_name || '](' || 'p' || s_suppkey || '.md)', chr(10) ORDER BY 'p' || s_suppkey) AS index FROM supplier")
def corpus_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.corpus_index(table(spark, sf_dir, "supplier").select(F.concat(F.lit("p"), F.col("s_suppkey").cast("string")).alias("paper_id"), F.col("s_name").alias("title")))


def _answers(ids: list[str]) -> tuple[int, dict[str, str], str]:
    """A metadata service that knows odd papers."""
    one = lambda i: {"paperId": f"s{i}", "title": f"Paper {i}", "year": 2000 + i % 20, "citationCount": i, "externalIds": {"DOI": f"10.1/{i}", "CorpusId": i, "Odd": None}, "authors": None}
    keys = [int(i.rsplit("/", 1)[1]) for i in ids]
    return 200, {}, json.dumps([one(k) if k % 2 else None for k in keys])


@register(
    "service_papers",
    """SELECT 'p' || s_suppkey AS paper_id, CASE WHEN s_suppkey % 2 = 1 AND s_suppkey % 3 = 0 THEN '10.1/' || s_suppkey WHEN s_suppkey % 3 <> 0 THEN '10.9/' || s_suppkey END AS doi, CASE WHEN s_suppkey % 2 = 1 THEN CAST(2000 + s_suppkey % 20 AS VARCHAR) END AS year,
  CASE WHEN s_suppkey % 2 = 1 THEN 'Paper ' || s_suppkey END AS service_title, CASE WHEN s_suppkey % 2 = 1 THEN s_suppkey END AS citations FROM supplier""",
)
def service_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry filled from a metadata service; a DOI that it has stays."""
    k = F.col("s_suppkey")
    r = table(spark, sf_dir, "supplier").select(k.alias("pos"), F.concat(F.lit("p"), k.cast("string")).alias("paper_id"), F.when(k % 3 != 0, F.concat(F.lit("10.9/"), k.cast("string"))).alias("doi"), F.lit(None).cast("string").alias("arxiv_id"), F.lit(None).cast("string").alias("year"))
    found = service.fetch(r.select("pos", F.concat(F.lit("DOI:10.1/"), F.col("pos").cast("string")).alias("external_id")), _answers, pause=0.0).where("service is not null")
    found = found.select("pos", F.col("service.externalIds")["DOI"].alias("doi"), F.lit(None).cast("string").alias("arxiv_id"), F.col("service.year").cast("string").alias("year"), "service")
    filled = papers_registry.fill_from_service(r.withColumn("service", F.lit(None).cast(found.schema["service"].dataType)), found)
    return filled.select("paper_id", "doi", "year", F.col("service.title").alias("service_title"), F.col("service.citationCount").alias("citations"))


def _pages(query: str, token: str | None) -> tuple[int, dict[str, str], str]:
    """A search service that gives three papers a page, and seven in all."""
    at = int(token or 0)
    rows = [{"paperId": f"{query}-{k}", "title": f"{query} {k}"} for k in range(at, min(at + 3, 7))]
    return 200, {}, json.dumps({"data": rows, "token": str(at + 3) if at + 3 < 7 else None})


@register("service_search", "SELECT r_name AS query, k AS pos, r_name || ' ' || k AS title FROM region, (SELECT unnest(range(5)) AS k)")
def service_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five papers of a search for each region's name."""
    names = [r["r_name"] for r in table(spark, sf_dir, "region").collect()]
    return service.bulk_search(spark, _pages, names, 5, pause=0.0).select("query", "pos", F.col("service.title").alias("title"))


@register("uncached_requests", "SELECT s_suppkey AS k, sha256('GET' || chr(10) || 'https://example.org/' || s_suppkey || chr(10)) AS request_key FROM supplier WHERE s_suppkey % 4 <> 0")
def uncached_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    r = table(spark, sf_dir, "supplier").select(k.alias("k"), files.request_key(F.lit("GET"), F.concat(F.lit("https://example.org/"), k.cast("string")), F.lit(None).cast("string")).alias("request_key"))
    return files.uncached(r, r.where("k % 4 = 0")).select("k", "request_key")


@register(
    "episode_bodies",
    """SELECT p_partkey AS k, p_name AS title, 'Source Path: docs/e' || p_partkey || '.qmd' || chr(10) || 'Document Title: ' || p_name || chr(10) || 'Document Kind: qmd' || chr(10) || chr(10) || 'About ' || p_type || '.' AS body FROM part""",
)
def episode_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _parts(spark, sf_dir, "docs/e<k>.qmd", '---\ntitle: "<name>"\n---\nAbout <type>.\n\n```{python}\nhidden()\n```\n').withColumn("mtime", F.current_timestamp())
    return episodes.episodes(f).select(_key().alias("k"), "title", "body")


@register(
    "benchmark_readiness",
    """SELECT 'ready' AS state, count(*) AS support_entries, count(*) FILTER (n_nationkey % 3 = 0) AS ready_entries, 'docker' AS missing_binaries, string_agg(DISTINCT 'VAR' || n_regionkey, ',' ORDER BY 'VAR' || n_regionkey) FILTER (n_nationkey % 3 = 2) AS missing_env_vars FROM nation""",
)
def benchmark_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey") % 3
    none = F.array().cast("array<string>")
    s = table(spark, sf_dir, "nation").select(F.when(k == 1, F.array(F.lit("docker"))).otherwise(none).alias("missing_binaries"), F.when(k == 2, F.array(F.concat(F.lit("VAR"), F.col("n_regionkey").cast("string")))).otherwise(none).alias("missing_env_vars"))
    return capabilities.benchmark_readiness(s, True, True)


@register(
    "result_violations",
    """WITH r AS (SELECT 'r' || (n_nationkey - n_nationkey % 11 // 10) AS run_id, CASE WHEN n_nationkey % 6 = 5 THEN 'lost' ELSE 'b' || n_regionkey END AS benchmark_id, CASE WHEN n_nationkey % 7 = 0 THEN ' ' ELSE 'ok' END AS status, n_nationkey AS k FROM nation)
SELECT 'duplicate_run' AS violation, run_id AS key, count(*) AS n FROM r GROUP BY run_id HAVING count(*) > 1 UNION ALL SELECT 'unknown_benchmark', 'lost', count(*) FROM r WHERE benchmark_id = 'lost' HAVING count(*) > 0
UNION ALL SELECT 'blank_status', run_id, 1 FROM r WHERE status = ' ' UNION ALL SELECT 'unknown_metric', run_id || ':odd', count(*) FROM r WHERE k % 5 = 1 AND benchmark_id <> 'lost' GROUP BY run_id
UNION ALL SELECT 'duplicate_metric', run_id || ':' || m, count(*) FROM (SELECT run_id, CASE WHEN k % 5 = 1 THEN 'odd' ELSE 'acc' END AS m FROM r) GROUP BY run_id, m HAVING count(*) > 1 UNION ALL SELECT 'blank_unit', run_id || ':' || CASE WHEN k % 5 = 1 THEN 'odd' ELSE 'acc' END, 1 FROM r WHERE k % 8 = 3""",
)
def result_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    run = F.concat(F.lit("r"), (k - F.floor(k % 11 / 10)).cast("string"))
    runs = table(spark, sf_dir, "nation").select(run.alias("run_id"), F.when(k % 6 == 5, "lost").otherwise(F.concat(F.lit("b"), F.col("n_regionkey").cast("string"))).alias("benchmark_id"), F.when(k % 7 == 0, " ").otherwise("ok").alias("status"), F.lit("fine").alias("summary"), k.alias("k"))
    scores = runs.select("run_id", "benchmark_id", F.when(F.col("k") % 5 == 1, "odd").otherwise("acc").alias("metric"), F.when(F.col("k") % 8 == 3, "").otherwise("share").alias("unit"))
    known = table(spark, sf_dir, "region").select(F.concat(F.lit("b"), F.col("r_regionkey").cast("string")).alias("benchmark_id"))
    return bench.result_violations(runs, scores, known, known.withColumn("metric", F.lit("acc")))


@register(
    "plan_violations",
    """WITH r AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 9 = 4 THEN ' ' ELSE 'p' || n_nationkey // 2 END AS run_id, CASE WHEN n_nationkey % 6 = 5 THEN 'lost' ELSE 'b' || n_regionkey END AS benchmark_id FROM nation)
SELECT 'unknown_benchmark' AS violation, 'lost' AS key, count(*) AS n FROM r WHERE benchmark_id = 'lost' HAVING count(*) > 0 UNION ALL SELECT 'blank_run_id', benchmark_id, 1 FROM r WHERE run_id = ' '
UNION ALL SELECT 'duplicate_run', run_id, count(*) FROM r WHERE run_id <> ' ' GROUP BY run_id HAVING count(*) > 1 UNION ALL SELECT 'blank_command', run_id, 1 FROM r WHERE k % 7 = 3
UNION ALL SELECT 'blank_workdir', run_id, 1 FROM r WHERE k % 5 = 2 UNION ALL SELECT 'blank_env', run_id, count(*) FROM r WHERE k % 4 = 0 GROUP BY run_id""",
)
def plan_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    plan = table(spark, sf_dir, "nation").select(
        F.when(k % 9 == 4, " ").otherwise(F.concat(F.lit("p"), F.floor(k / 2).cast("string"))).alias("run_id"), F.when(k % 6 == 5, "lost").otherwise(F.concat(F.lit("b"), F.col("n_regionkey").cast("string"))).alias("benchmark_id"),
        F.when(k % 7 == 3, "").otherwise("run").alias("command"), F.when(k % 5 == 2, " ").when(k % 5 == 3, "x").alias("workdir"), F.create_map(F.lit("SEED"), F.when(k % 4 == 0, "").otherwise("1")).alias("env"),
    )
    return bench.plan_violations(plan, table(spark, sf_dir, "region").select(F.concat(F.lit("b"), F.col("r_regionkey").cast("string")).alias("benchmark_id")))
