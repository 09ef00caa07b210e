"""TeX papers: sections, captions, citations and references."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from . import schemas
from .files import whole_texts

_HEADING = re.compile(r"\\(section|subsection|subsubsection)\*?\s*\{")
_CITE = re.compile(r"\\(cite[a-zA-Z]*|parencite|textcite|autocite|footcite|fullcite|nocite|Cite[a-zA-Z]*|supercite|smartcite)\*?")
_INCLUDE = re.compile(r"\\(?:input|include)\s*\{([^}]*)\}")
_LEVEL = {"section": 1, "subsection": 2, "subsubsection": 3}
_SECTIONS = pa.list_(pa.struct([("level", pa.int32()), ("title", pa.string()), ("content", pa.string())]))
#: Columns of schemas.PAPER.
_PAPER = pa.schema([("path", pa.string()), ("title", pa.string()), ("abstract", pa.string()), ("sections", _SECTIONS), *[(c, pa.list_(pa.string())) for c in ("figures", "tables", "citations")]])


def without_comments(body: str) -> str:
    return re.sub(r"(?m)(?<!\\)%.*$", "", body)


def plain(body: str) -> str:
    """Text without commands and braces, white space squeezed."""
    return " ".join(re.sub(r"[{}]", "", re.sub(r"\\[A-Za-z]+\*?", " ", body)).split())


def braced(body: str, at: int) -> tuple[str, int]:
    """What the brace at ``at`` encloses and where it ends."""
    depth = 0
    for j in range(at, len(body)):
        if body[j] == "\\":
            continue
        if body[j] == "{" and (j == 0 or body[j - 1] != "\\"):
            depth += 1
        elif body[j] == "}" and body[j - 1] != "\\":
            depth -= 1
            if not depth:
                return body[at + 1 : j], j + 1
    return body[at + 1 :], len(body)


def sections(body: str) -> list[tuple[int, str, str]]:
    """(level, title, content) of each heading; content ends at the next one."""
    found = []
    for m in _HEADING.finditer(body):
        title, end = braced(body, m.end() - 1)
        found.append((m.start(), end, _LEVEL[m[1]], plain(title)))
    stops = [f[0] for f in found[1:]] + [len(body)]
    return [(level, title, plain(body[end:stop])) for (_, end, level, title), stop in zip(found, stops)]


def captions(body: str, environment: str) -> list[str]:
    out = []
    for m in re.finditer(rf"\\begin\{{{environment}\}}(.*?)\\end\{{{environment}\}}", body, re.S):
        if c := re.search(r"\\caption(?:\[[^\]]*\])?\s*\{", m[1]):
            out.append(plain(braced(m[1], c.end() - 1)[0]))
    return [c for c in out if c]


def citations(body: str) -> list[str]:
    """Sorted distinct keys of all citing commands."""
    keys: set[str] = set()
    for m in _CITE.finditer(body):
        at = m.end()
        while (o := re.compile(r"\s*\[").match(body, at)) is not None:
            depth, at = 1, o.end()
            while at < len(body) and depth:
                depth += {"[": 1, "]": -1}.get(body[at], 0)
                at += 1
        if b := re.compile(r"\s*\{").match(body, at):
            keys |= {k.strip() for k in braced(body, b.end() - 1)[0].split(",")}
    return sorted(keys - {"", "*"})


def root_of(files: dict[str, str]) -> str | None:
    """The main file: ``main.tex``, else the first with a document class and a document."""
    mains = sorted(p for p in files if posixpath.basename(p) == "main.tex")
    return mains[0] if mains else next((p for p in sorted(files) if "\\documentclass" in files[p] and "\\begin{document}" in files[p]), None)


def inlined(root: str, files: dict[str, str], seen: set[str] | None = None) -> str:
    """A file with what it includes in place, each file once; files that aren't there count as empty."""
    seen = set() if seen is None else seen
    if root in seen or root not in files:
        return ""
    seen.add(root)

    def put(m: re.Match) -> str:
        name = posixpath.normpath(posixpath.join(posixpath.dirname(root), m[1].strip()))
        return inlined(name if name.endswith(".tex") else name + ".tex", files, seen)

    return _INCLUDE.sub(put, without_comments(files[root]))


def paper(body: str) -> tuple:
    title = re.search(r"\\title(?:\[[^\]]*\])?\s*\{", body)
    abstract = re.search(r"\\begin\{abstract\}(.*?)\\end\{abstract\}", body, re.S)
    return (
        plain(braced(body, title.end() - 1)[0]) if title else None,
        plain(abstract[1]) if abstract else None,
        [dict(zip(("level", "title", "content"), s)) for s in sections(body)],
        captions(body, "figure"),
        captions(body, "table"),
        citations(body),
    )


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """One row for each folder under ``path`` that has a main TeX file."""
    files = whole_texts(spark, path, "*.tex")
    root = F.lit("/" + path.split(":", 1)[-1].strip("/") + "/")
    bare = F.regexp_replace("path", "^[a-z]+:/*", "/")
    below = F.substring(bare, F.length(root) + 1, F.length(bare))
    return papers_of(files.select(F.substring_index(below, "/", 1).alias("folder"), below.alias("path"), "text"))


def papers_of(files: DataFrame) -> DataFrame:
    """One row for each folder of files (folder, path, text) that has a main TeX file; a paper's files are one row, a batch has many papers."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for folder, texts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                texts = {f["path"]: f["text"] for f in texts}
                if main := root_of(texts):
                    found.append((folder, *paper(inlined(main, texts))))
            yield pa.RecordBatch.from_pylist([dict(zip(_PAPER.names, row)) for row in found], _PAPER)

    return files.groupBy("folder").agg(F.collect_list(F.struct("path", "text")).alias("texts")).mapInArrow(parse, schemas.PAPER)


def cited_references(papers: DataFrame, bib: DataFrame) -> DataFrame:
    """``path, citation_key, title, doi, arxiv_id`` of the bibliography entries (with folder as path) that a paper cites."""
    cites = papers.select("path", F.explode("citations").alias("citation_key"))
    f = lambda name: F.col("fields")[name]
    refs = bib.select("path", "citation_key", f("title").alias("title"), F.coalesce(text.doi_in_text(f("doi")), text.doi_in_text(f("url"))).alias("doi"), F.coalesce(*[text.arxiv_in_text(f(n)) for n in ("eprint", "arxiv", "journal", "volume", "url")]).alias("arxiv_id"))
    return refs.join(cites, ["path", "citation_key"], "left_semi")
