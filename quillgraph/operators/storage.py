"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

#: Narrow rows of a file, where their number is known.
FILE_ROWS = 1_000_000

_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder as the session names it; where it names none, a local one, if all runs on this machine."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        return f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"
    raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows over all cores where the files make fewer splits than that, for work that costs far more than a shuffle; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again, which cuts the lineage and survives lost executors.

    ``rows`` says how many narrow rows (some ten bytes a row; wider ones count
    as several) it has at most: they go to no more files than they need,
    however many partitions there are.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(rows // FILE_ROWS + 1)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more."""
    for table in tables:
        if path := _paths.pop(table, None):
            context = table.sparkSession.sparkContext
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
