"""TOML files of any number of tables, cut into records where they are read.

Spark reads a file by blocks of lines.  Whether a line stands within a string of
several lines depends on all lines before it, so each block tells, for every
state it may be entered in, the state before each of its lines and after its
last one; from block to block these are chained.  A header of a table at the
top, outside of such strings, begins a record, which takes the tables below it
along; each record is parsed by itself.
"""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matching import running_sum
from ..operators.storage import written

#: States: outside of strings of several lines, in a basic one, in a literal one.
STATES = 3
_MARK = ('"""', "'''")
_TOKEN = re.compile(r"""'''|\"\"\"|"(?:[^"\\]|\\.)*"|'[^']*'|#""")
_CLOSE = (None, re.compile(r'(?:[^"\\]|\\.|"(?!""))*"""'), re.compile(r"(?:[^']|'(?!''))*'''"))
#: A header of a top table or of an element of a top array of tables.
_HEADER = r'^\s*\[{1,2}\s*([A-Za-z0-9_-]+|"[^"]*"|\'[^\']*\')\s*\]{1,2}\s*(#.*)?$'


def after(line: str, state: int) -> int:
    """The state after a line."""
    at = 0
    while True:
        if state:
            closed = _CLOSE[state].match(line, at)
            if closed is None:
                return state
            state, at = 0, closed.end()
            while at < len(line) and line[at] == line[closed.end() - 1] and at < closed.end() + 2:
                at += 1  # up to two quotes may stand before the closing three
        found = _TOKEN.search(line, at)
        if found is None or found.group() == "#":
            return 0
        at = found.end()
        if found.group() in _MARK:
            state = 1 + _MARK.index(found.group())


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block, now = None, list(range(STATES))
    for batch in batches:
        before, later = [], []
        for file, start, line in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3))):
            if (file, start) != block:
                block, now = (file, start), list(range(STATES))
            before.append(now)
            plain = '"' not in line and "'" not in line
            now = now if plain else [after(line, s) for s in now]
            later.append(now)
        kind = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, kind), pa.array(later, kind)], ["file", "start", "i", "line", "before", "later"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    file, state = None, 0
    for batch in batches:
        out = []
        for name, later in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if name != file:
                file, state = name, 0
            out.append(state)
            state = later[state]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int32())], ["file", "start", "entry"])


def records(spark: SparkSession, path: str) -> DataFrame:
    """``file, n, text``: the records of TOML files, 0 for what stands before the first table."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("i"), F.col("value").alias("line"))
    lines = written(lines.mapInArrow(_states, "file string, start long, i long, line string, before array<int>, later array<int>"), "toml-lines")
    # a row for each block of a file; only its three states are chained
    ends = lines.groupBy("file", "start").agg(F.max_by("later", "i").alias("later"))
    entries = ends.repartition("file").sortWithinPartitions("file", "start").mapInArrow(_entries, "file string, start long, entry int")
    placed = lines.join(entries, ["file", "start"])
    begins = (F.get("before", F.col("entry")) == 0) & F.regexp_like("line", F.lit(_HEADER))
    numbered = running_sum(placed.select("file", "start", "i", "line", begins.alias("begins")), ["file"], ["start", "i"], F.col("begins").cast("long"), "n")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "i", "line"))), lambda x: x.line), "\n")
    return numbered.groupBy("file", "n").agg(text.alias("text"))


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for file, n, text in zip(*(c.to_pylist() for c in batch.columns)):
            found = tomllib.loads(text)
            plain = {k: v for k, v in found.items() if not (n and isinstance(v, (dict, list)))}
            for name, value in [("", plain)] if not n else found.items():
                for item in value if isinstance(value, list) else [value]:
                    rows.append((file, n, name, json.dumps(item, sort_keys=True, default=str, ensure_ascii=False)))
        columns = list(zip(*rows)) if rows else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string()))], ["file", "n", "name", "item"])


def items(spark: SparkSession, path: str) -> DataFrame:
    """``file, n, name, item``: each table of an array, and each table, of the top as a JSON object with all below it; of name '' the keys before the first.

    A record that isn't TOML is an error.
    """
    return records(spark, path).mapInArrow(_items, "file string, n long, name string, item string")


def listed(found: DataFrame, names: tuple[str, ...], schema: str) -> DataFrame:
    """Items of some names as columns, in the order of the files; ``name`` and ``item`` stay."""
    return found.where(F.col("name").isin(*names)).select("file", "n", "name", "item", F.from_json("item", schema).alias("x")).select("file", "n", "name", "item", "x.*")


def quoted(c: Column) -> Column:
    """A text as a TOML string."""
    return F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")


def write_runs(runs: DataFrame, path: str) -> None:
    """Runs (run_id, benchmark_id, status, scores: array of metric_id, value, unit) as a results file for each task; no row leaves its task."""
    head = F.concat(F.lit("[[runs]]\n"), *[F.concat(F.lit(f"{c} = "), quoted(F.col(c)), F.lit("\n")) for c in ("run_id", "benchmark_id", "status")])
    unit = lambda s: F.when(s.unit.isNotNull(), F.concat(F.lit("unit = "), quoted(s.unit), F.lit("\n"))).otherwise("")
    score = lambda s: F.concat(F.lit("[[runs.scores]]\nmetric_id = "), quoted(s.metric_id), F.lit("\nvalue = "), s.value.cast("string"), F.lit("\n"), unit(s))
    runs.select(F.concat(head, F.array_join(F.transform("scores", score), "")).alias("value")).write.mode("overwrite").text(path)
