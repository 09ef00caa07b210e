"""Tables that change part by part, behind commits that readers follow.

A table is a folder of data files, each job's in a folder of its own and split
by part, and a folder of commits.  A commit lists for each part the digest that
it was made from and the folder that holds it.  Writers write what changed and
then one commit; a reader takes the parts of one commit, so it sees the table
before a change or after it, never between, and a job that dies leaves nothing
that anyone reads.  Two writers of one version can't both commit.

Parts are few (sources, buckets), so their list may be held in the driver; rows
never are.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PART = "part_"
MANIFEST = "part string, digest string, folder string, version long, schema string, buckets int"


class Part(NamedTuple):
    part: str
    digest: str
    folder: str | None  # none: the part was made and has no rows
    version: int
    schema: str
    buckets: int


def part_name(c: Column) -> Column:
    """A part's name by its value; null is a part of its own."""
    return F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("null"))


def digests(rows: DataFrame, part: Column) -> dict[str, str]:
    """A digest of the rows of each part, whatever their order; counted where the rows lie, one line a part."""
    columns = sorted(rows.columns)
    sums = [F.sum(F.xxhash64(F.lit(k), *columns).cast("decimal(38,0)")) for k in (1, 2)]
    found = rows.groupBy(part.alias(PART)).agg(F.concat_ws(":", F.count(F.lit(1)), *sums).alias("digest")).collect()
    return {r[PART]: r["digest"] for r in found}


class SnapshotTable:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, *names: str):
        """A folder and its file system, whatever store the path names."""
        context = self.spark.sparkContext
        where = context._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))
        return where, where.getFileSystem(context._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Committed versions, in order."""
        where, fs = self._folder("commits")
        names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
        done = [n for n in names if n.isdigit() and fs.exists(self._folder("commits", n, "_SUCCESS")[0])]
        return sorted(map(int, done))

    def parts(self, version: int | None = None) -> list[Part]:
        """The parts of a version, the last one by default; none of a table without commits."""
        if version is None and not (known := self.versions()):
            return []
        rows = self.spark.read.schema(MANIFEST).json(f"{self.path}/commits/{known[-1] if version is None else version}").collect()
        return [Part(*r) for r in rows if r["part"] is not None]

    def _read(self, parts: list[Part]) -> DataFrame | None:
        by_folder: dict[str, list[Part]] = {}
        for p in parts:
            if p.folder is not None:
                by_folder.setdefault(p.folder, []).append(p)
        found = []
        for folder, some in sorted(by_folder.items()):
            schema = StructType.fromJson(json.loads(some[0].schema)).add(PART, "string")
            found.append(self.spark.read.schema(schema).parquet(f"{self.path}/data/{folder}").where(F.col(PART).isin([p.part for p in some])))
        if found:
            return reduce(DataFrame.unionByName, found)
        return self.spark.createDataFrame([], StructType.fromJson(json.loads(parts[0].schema)).add(PART, "string")) if parts else None

    def read(self, version: int | None = None) -> DataFrame | None:
        """Rows of a version; None before the first one.  Later commits don't change what it reads."""
        rows = self._read(self.parts(version))
        return None if rows is None else rows.drop(PART)

    def _write(self, rows: DataFrame, name: Column) -> tuple[str, str, set[str]]:
        """Write rows by part: folder, schema and the parts that have rows."""
        folder, schema = uuid.uuid4().hex, rows.schema.json()
        rows.withColumn(PART, name).write.partitionBy(PART).parquet(f"{self.path}/data/{folder}")
        there = self.spark.read.schema(StructType().add(PART, "string")).parquet(f"{self.path}/data/{folder}")
        return folder, schema, {r[PART] for r in there.select(PART).distinct().collect()}

    def _commit(self, parts: list[Part]) -> int:
        version = max(self.versions(), default=0) + 1
        rows = parts or [Part(None, "", None, version, "", 0)]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("errorifexists").json(f"{self.path}/commits/{version}")
        return version

    def rebuild(self, source: DataFrame, part_col: str, build: Callable[[DataFrame], DataFrame]) -> dict[str, list[str]]:
        """Bring the table up to date with ``source``: ``built``, ``kept`` and ``dropped`` parts.

        ``build`` makes the rows of some parts from the source's rows of these
        parts and keeps ``part_col``.  Parts whose rows are the same as when
        they were built stay, those that are gone from the source go.
        """
        name = part_name(F.col(part_col))
        now, old = digests(source, name), {p.part: p for p in self.parts()}
        built = sorted(p for p, d in now.items() if p not in old or old[p].digest != d)
        kept, dropped = sorted(set(now) - set(built)), sorted(set(old) - set(now))
        if not built and not dropped and old:
            return {"built": [], "kept": kept, "dropped": []}
        version = max(self.versions(), default=0) + 1
        parts = [old[p] for p in kept]
        if built or not old:
            folder, schema, there = self._write(build(source.where(name.isin(built))), name)
            parts += [Part(p, now[p], folder if p in there else None, version, schema, 0) for p in built]
        self._commit(parts)
        return {"built": built, "kept": kept, "dropped": dropped}

    def update(self, batch: DataFrame, bucket_keys: list[str], combine: Callable[[DataFrame | None, DataFrame], DataFrame], buckets: int = 64) -> list[str]:
        """Change the buckets that ``batch`` has rows for and leave all others as they are: the buckets that were written.

        Rows lie in buckets by a hash of ``bucket_keys``; their number is that
        of the table once it has one.  ``combine`` gives the new rows of some
        buckets from the old ones (None: the table has none yet) and the batch.
        An empty batch changes nothing.
        """
        old = {p.part: p for p in self.parts()}
        buckets = next((p.buckets for p in old.values()), buckets)
        name = part_name(F.pmod(F.xxhash64(*bucket_keys), F.lit(buckets)))
        touched = sorted(r[0] for r in batch.select(name).distinct().collect())
        if not touched:
            return []
        some = self._read([old[p] for p in touched if p in old] or list(old.values())[:1]) if old else None
        current = None if some is None else some.where(F.col(PART).isin(touched)).drop(PART)
        version = max(self.versions(), default=0) + 1
        folder, schema, there = self._write(combine(current, batch), name)
        if not there <= set(touched):
            raise ValueError("rows of other buckets than the batch's")
        self._commit([p for k, p in old.items() if k not in touched] + [Part(p, "", folder if p in there else None, version, schema, buckets) for p in touched])
        return touched

    def vacuum(self, keep: int = 2) -> int:
        """Delete data that none of the last ``keep`` versions has, and older commits; the number of folders deleted.  Not while others write or read older versions."""
        known = self.versions()
        live = {p.folder for v in known[-keep:] for p in self.parts(v)}
        where, fs = self._folder("data")
        gone = [s.getPath() for s in fs.listStatus(where) if s.getPath().getName() not in live] if fs.exists(where) else []
        for path in gone + [self._folder("commits", str(v))[0] for v in known[:-keep]]:
            fs.delete(path, True)
        return len(gone)
