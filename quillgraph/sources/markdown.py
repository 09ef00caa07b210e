"""Markdown documents, transcripts and memory files as rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from . import schemas
from .files import parsed, whole_texts

_HEADING = re.compile(r"(#{1,6})\s+(.*?)\s*#*\s*$")
_KEY = re.compile(r"(?<![A-Za-z0-9_])@([A-Za-z_:-][A-Za-z0-9_:-]*)")
_SUPERSEDES = re.compile(text.SUPERSEDES)


def front_matter(body: str) -> tuple[dict[str, str], str]:
    """Key-value lines between ``---`` lines at the top, and the rest."""
    m = re.match(r"---\s*\n(.*?)\n---\s*(?:\n|$)", body, re.S)
    if not m:
        return {}, body
    pairs = (line.partition(":") for line in m[1].splitlines() if ":" in line and not line.startswith((" ", "\t")))
    return {k.strip().lower(): v.strip().strip("\"'") for k, _, v in pairs}, body[m.end() :]


def authors_of(meta: dict[str, str]) -> list[str]:
    raw = meta.get("authors") or meta.get("author") or ""
    return [a.strip().strip("\"'") for a in raw.strip("[]").split(",") if a.strip().strip("\"'")]


def sections(body: str, glue: str = "\n") -> list[tuple[int, str, str]]:
    """(level, title, content); what stands before the first heading has level 0.

    Code fences keep their lines; reasoning blocks are marked; ``glue`` joins
    the lines of a paragraph ("" as the plain event order of a parser gives
    them, a line break for reading).
    """
    out: list[tuple[int, str, list[str]]] = [(0, "", [])]
    fenced = False
    for line in body.split("\n"):
        if re.match(r"\s*(```|~~~)", line):
            fenced = not fenced
            continue
        m = None if fenced else _HEADING.match(line)
        if m:
            out.append((len(m[1]), m[2], []))
        elif re.match(r"\s*<(think|thinking|reasoning)>", line):
            out[-1][2].append("[Reasoning: " + re.sub(r"</?(think|thinking|reasoning)>", "", line).strip())
            if re.search(r"</(think|thinking|reasoning)>", line):
                out[-1][2][-1] += "]"
        elif re.match(r"\s*</(think|thinking|reasoning)>", line):
            out[-1][2].append("]")
        else:
            out[-1][2].append(line)
    rows = [(level, title, glue.join(x for x in lines if x.strip()).strip()) for level, title, lines in out]
    return [r for r in rows if r[0] or r[2]]


def citation_keys(body: str) -> list[str]:
    return sorted({k.rstrip(":-") for k in _KEY.findall(body)} - {""})


def document(path: str, body: str) -> Iterator[tuple]:
    meta, rest = front_matter(body)
    found = sections(rest)
    title = meta.get("title") or next((t for level, t, _ in found if level == 1), None) or path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    year = re.search(r"\d{4}", meta.get("date", "") or meta.get("year", ""))
    yield path, title, authors_of(meta), year[0] if year else None, meta.get("kind", "document"), [dict(zip(("level", "title", "content"), s)) for s in found], citation_keys(rest)


def read_documents(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Markdown and Quarto files as documents with sections and citation keys."""
    return parsed(whole_texts(spark, path, "*.{md,qmd}", recursive), document, schemas.DOCUMENT)


def memory_nodes(path: str, body: str) -> Iterator[tuple]:
    """Nodes of a memory file: its sections by ``##`` headings, or the whole of it, and their bullets, numbered from 1."""
    meta, rest = front_matter(body)
    offset = body[: len(body) - len(rest)].count("\n")
    lines = rest.split("\n")
    title = meta.get("title") or next((x[2:].strip() for x in lines if x.startswith("# ")), path.rsplit("/", 1)[-1])
    starts = [k for k, x in enumerate(lines) if x.startswith("## ")]
    spans = [(lines[a][3:].strip(), a + 1, b) for a, b in zip(starts, starts[1:] + [len(lines)])] or [(title, 0, len(lines))]
    for name, a, b in spans:
        bullets = [k for k in range(a, b) if lines[k].startswith("- ")]
        parts = [("bullet", n + 1, lo, hi) for n, (lo, hi) in enumerate(zip(bullets, bullets[1:] + [b]))] or [("section", None, a, b)]
        for kind, ordinal, lo, hi in parts:
            while hi > lo and not lines[hi - 1].strip():
                hi -= 1
            raw = "\n".join(lines[lo:hi])
            old = [x.strip() for m in _SUPERSEDES.findall(raw) for x in re.split("[,;]", m) if x.strip()]
            clean = _SUPERSEDES.sub("", raw).strip()
            if clean:
                yield path, kind, title, name, ordinal, offset + lo + 1, offset + hi, clean.removeprefix("- "), old


def read_memory(spark: SparkSession, path: str, globs: str = "*.md") -> DataFrame:
    return parsed(whole_texts(spark, path, globs), memory_nodes, schemas.MEMORY)


def reference_candidates(nodes: DataFrame) -> DataFrame:
    """``path, section, raw, kind``: what links, code spans, citation keys and arXiv ids in a text may refer to."""
    c = F.col("text")
    spans = text.found_all(c, text.CODE_SPAN)
    kind = lambda x: F.when(text.looks_like_path(x), "path").when(text.looks_like_symbol(x), "symbol")
    tagged = lambda xs, k: F.transform(xs, lambda x: F.struct(x.alias("raw"), (k if k is not None else kind(x)).alias("kind")))
    found = F.array_union(F.array_union(tagged(text.found_all(c, text.LINK), F.lit("path")), tagged(spans, None)), F.array_union(tagged(text.found_all(c, text.CITATION_KEY), F.lit("citation_key")), tagged(text.found_all(c, text.ARXIV_ID), F.lit("arxiv"))))
    return nodes.select("path", "section", F.explode(F.array_distinct(found)).alias("x")).select("path", "section", "x.raw", "x.kind").where("kind is not null")


def contract_sections(path: str, body: str) -> Iterator[tuple]:
    """(path, title, summary, first line, last line) of ``##`` sections; the summary is the first line that is no bullet and no directive."""
    lines = body.removesuffix("\n").split("\n")
    starts = [k for k, x in enumerate(lines) if x.startswith("## ")]
    for a, b in zip(starts, starts[1:] + [len(lines)]):
        summary = next((x.strip() for x in lines[a + 1 : b] if x.strip() and not x.strip().startswith(("-", "*", ":"))), "")
        yield path, lines[a][3:].strip(), summary, a + 1, b


def read_contracts(spark: SparkSession, path: str) -> DataFrame:
    return parsed(whole_texts(spark, path, "*.md"), contract_sections, "path string, title string, summary string, line_start long, line_end long")


def targets_of(path: str, body: str) -> Iterator[tuple]:
    """(path, name, description) of documented make targets; names that start with an underscore are internal."""
    for m in re.finditer(r"(?m)^([A-Za-z0-9][A-Za-z0-9_.-]*):[^=\n]*?##\s*(.+)$", body):
        yield path, m[1], m[2].strip()


def commands_of(path: str, body: str) -> Iterator[tuple]:
    """(path, description, command): commands in shell fences that follow comment lines."""
    for fence in re.finditer(r"```(?:bash|sh|shell|console|)\s*\n(.*?)```", body, re.S):
        note: list[str] = []
        for line in (x.strip() for x in fence[1].split("\n")):
            if line.startswith("#"):
                note.append(line.lstrip("# "))
            elif line:
                if note:
                    yield path, " ".join(note), line.removeprefix("$ ")
                note = []


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    return parsed(whole_texts(spark, path, "{Makefile,*.mk}"), targets_of, "path string, name string, description string")


def read_commands(spark: SparkSession, path: str) -> DataFrame:
    return parsed(whole_texts(spark, path, "*.md"), commands_of, "path string, description string, command string")
