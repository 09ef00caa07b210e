"""BibTeX entries as rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from . import schemas
from .files import parsed, whole_texts

_CLOSE = {"{": "}", "(": ")"}


def _value(s: str, i: int, close: str) -> tuple[str, int]:
    """The value that starts at ``i``, and where it ends."""
    if s[i] == "{":
        depth, j = 1, i + 1
        while j < len(s) and depth:
            depth += {"{": 1, "}": -1}.get(s[j], 0)
            j += 1
        return s[i + 1 : j - 1], j
    if s[i] == '"':
        depth, j = 0, i + 1
        while j < len(s) and (s[j] != '"' or depth):
            depth += {"{": 1, "}": -1}.get(s[j], 0)
            j += 1
        return s[i + 1 : j], j + 1
    j = i
    while j < len(s) and s[j] not in "," + close:
        j += 1
    return s[i:j], j


def entries(body: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(type, key, fields) of each entry; names in lower case, white space squeezed, of a repeated field the last; an entry cut off at the end is an error."""
    at = 0
    while m := re.compile(r"@\s*(\w+)\s*([{(])").search(body, at):
        close = _CLOSE[m[2]]
        kind, i = m[1].lower(), m.end()
        if kind in ("comment", "preamble", "string"):
            at = m.end()
            continue
        j = i
        while j < len(body) and body[j] not in "," + close:
            j += 1
        key, fields = body[i:j].strip(), {}
        while j < len(body) and body[j] != close:
            f = re.compile(r"[\s,]*([^\s=,{}()\"]+)\s*=\s*").match(body, j)
            if not f:
                rest = re.compile(r"[\s,]*").match(body, j)
                if rest.end() < len(body) and body[rest.end()] == close:
                    j = rest.end()
                    break
                raise ValueError(f"bad field in entry {key!r}")
            if f.end() >= len(body):
                break
            value, j = _value(body, f.end(), close)
            fields[f[1].lower()] = " ".join(value.split())
            while j < len(body) and body[j] in " \t\r\n":
                j += 1
        if j >= len(body):
            raise ValueError(f"entry {key!r} isn't closed")
        yield kind, key, fields
        at = j + 1


def entries_of(files: DataFrame, lenient: bool = False) -> DataFrame:
    """Entries of files (path, text), numbered; with ``lenient`` a file that can't be read gives none."""

    def parse(name: str, body: str) -> Iterator[tuple]:
        try:
            found = list(entries(body))
        except ValueError:
            if not lenient:
                raise
            found = []
        yield from ((name, k, *e) for k, e in enumerate(found))

    return parsed(files, parse, schemas.BIB)


def read_bibtex(spark: SparkSession, path: str, lenient: bool = False) -> DataFrame:
    """Entries of all ``.bib`` files under ``path``."""
    return entries_of(whole_texts(spark, path, "*.bib"), lenient)
