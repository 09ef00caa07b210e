"""Streaming forms of refresh work: staleness, upserts and deduplication of requests.

The batch engine has no streams of its own; these are extensions on
Structured Streaming that keep its tables fresh.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def rebuild_on_change(spark: SparkSession, source: str, schema: str, rebuild: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Call ``rebuild`` with the rows of files that are new since the last run, then stop."""
    stream = spark.readStream.schema(schema).json(source)
    return stream.writeStream.foreachBatch(lambda df, _: rebuild(df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert(current: DataFrame | None, batch: DataFrame, key: str, order: str) -> DataFrame:
    """Current rows with those of a batch in place of equal keys; of a key's rows in the batch the last counts."""
    last = Window.partitionBy(key).orderBy(F.desc(order))
    new = batch.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")
    return new if current is None else current.join(new.select(key), key, "left_anti").select(*new.columns).unionByName(new)


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by type and window of event time; state of windows older than ``late`` goes."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def fresh_requests(requests: DataFrame, late: str = "1 hour") -> DataFrame:
    """Requests whose key hasn't been seen within ``late``."""
    return requests.withWatermark("ts", late).dropDuplicatesWithinWatermark(["request_key"])


def refreshed_vectors(rows: DataFrame, current: DataFrame, model: str, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``id, vec, model, digest`` of rows (id, text): those of ``current`` whose text and model are the same stay, the others alone are embedded anew, rows that are gone go."""
    wanted = rows.select("id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    kept = current.where(F.col("model") == model).join(wanted.select("id", "digest"), ["id", "digest"], "left_semi").select("id", "vec", "model", "digest")
    stale = wanted.join(kept.select("id"), "id", "left_anti")
    new = embed(stale.select("id", "text")).join(stale.select("id", "digest"), "id").select("id", "vec", F.lit(model).alias("model"), "digest")
    return kept.unionByName(new)


#: States in which a registry row is left by a step, in order; a step takes up the rows that haven't reached it.
STATES = ("metadata_only", "pending_download", "downloaded", "parsed", "failed")


def to_do(registry: DataFrame, step: str) -> DataFrame:
    """Rows that a step (``downloaded`` or ``parsed``) has yet to do: not failed and in an earlier state, records of metadata alone left out."""
    earlier = [s for s in STATES[1 : STATES.index(step)]]
    return registry.where(F.col("parse_status").isin(*earlier))


def advanced(registry: DataFrame, done: DataFrame, step: str) -> DataFrame:
    """The registry after a step over rows of (paper_id, ok): done rows are in the step's state, others failed; the rest as they were."""
    d = done.groupBy("paper_id").agg(F.bool_and("ok").alias("_ok"))
    state = F.when(F.col("_ok").isNull(), F.col("parse_status")).when(F.col("_ok"), step).otherwise("failed")
    return registry.join(d, "paper_id", "left").withColumn("parse_status", state).select(*registry.columns)


def ingest(episodes: DataFrame, send: Callable[[dict], None], at_once: int) -> DataFrame:
    """``path, ok, error`` of sending episodes (path, title, body, reference_time), by reference time within each of at most ``at_once`` tasks; one that fails doesn't stop the others."""
    columns = ["path", "title", "body", "reference_time"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for row in part.to_dict("records"):
                try:
                    send(row)
                    out.append((row["path"], True, None))
                except Exception as e:  # noqa: BLE001 - whatever the service raises is the row's result
                    out.append((row["path"], False, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "ok", "error"])

    return episodes.select(*columns).repartition(at_once).sortWithinPartitions("reference_time", "path").mapInPandas(run, "path string, ok boolean, error string")
