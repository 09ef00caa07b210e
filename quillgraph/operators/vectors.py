"""A stored index of vectors for exact search by cosine, with pivots and the triangle inequality.

Rows are dealt to the nearest of a few pivots and sorted by their angle to it;
blocks of such rows keep the least and greatest angle to every pivot.  Angles
obey the triangle inequality, so these intervals bound how near a block's rows
can be to a query's.  Blocks of queries visit the blocks of best bound first;
what they have found then rules out the blocks whose bound lies below.  Nothing
is approximate: a block that is left out can't hold an answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import discard, written

#: Pivots, rows that they are chosen from, rows of a block and of a block of queries.
PIVOTS, SAMPLE, BLOCK, QUERIES = 32, 2048, 2048, 256
#: Blocks that each block of queries visits before bounds rule others out.
FIRST = 2
#: What rounding may take from a bound.
SLACK = 1e-6
#: Decimals of a score.
DECIMALS = 9

BLOCKS = "cell int, block long, n int, zero boolean, ids array<long>, data binary, lo array<double>, hi array<double>"


def unit(rows: np.ndarray) -> np.ndarray:
    """Vectors at unit length; zero ones stay."""
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def choose_pivots(rows: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Vectors far from each other: each is the one farthest from those before."""
    chosen, nearest = [0] if len(rows) else [], np.full(len(rows), np.inf)
    while chosen and len(chosen) < n:
        nearest = np.minimum(nearest, angles(rows, rows[chosen[-1:]])[:, 0])
        if nearest.max() <= 1e-9:
            break
        chosen.append(int(nearest.argmax()))
    return rows[chosen]


def pivots_of(vectors: DataFrame, vec_col: str = "embedding") -> np.ndarray:
    """Pivots from at most SAMPLE rows, drawn by a hash of the vector; all have the commonest length of the sample."""
    drawn = _clean(vectors, None, vec_col).select("vec").distinct().orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE).collect()
    sizes = [len(r["vec"]) for r in drawn]
    size = max(set(sizes), key=lambda s: (sizes.count(s), s)) if sizes else 0
    rows = unit(np.array([r["vec"] for r in drawn if len(r["vec"]) == size], np.float64).reshape(sizes.count(size), size))
    rows = rows[np.abs(rows).sum(1) > 0]
    return choose_pivots(rows) if len(rows) else np.zeros((0, size))


def _clean(vectors: DataFrame, id_col: str | None, vec_col: str) -> DataFrame:
    vec = F.col(vec_col).cast("array<double>")
    rows = vectors.select(*([F.col(id_col).cast("long").alias("id")] if id_col else []), vec.alias("vec"))
    return rows.where("vec is not null" + " and id is not null" * bool(id_col)).where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x)) & (F.size("vec") > 0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def blocks_of(vectors: DataFrame, pivots: np.ndarray, id_col: str, vec_col: str, rows: int) -> DataFrame:
    """Rows as blocks: ``cell, block, n, zero, ids, data, lo, hi``.

    Ranges of (cell, angle to its pivot) are sorted and cut into blocks, so a
    cell that has most rows is many blocks in many tasks.
    """
    dim = pivots.shape[1]
    sent = vectors.sparkSession.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(_matrix(batch.column(1), dim))
            a = angles(x, sent.value) if len(sent.value) else np.zeros((len(x), 1))
            zero = ~x.any(axis=1)
            cell = np.where(zero, -1, a.argmin(1)).astype(np.int32)
            data = pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell), pa.array(np.where(zero, 0.0, a.min(1))), data], ["id", "cell", "angle", "data"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, cell, ids, data = TaskContext.get().partitionId() << 32, None, [], []

        def block() -> pa.RecordBatch:
            x = np.frombuffer(b"".join(data), np.float64).reshape(-1, dim)
            a = angles(x, sent.value)
            values = [cell, number, len(ids), cell < 0, ids, x.tobytes(), a.min(0).tolist(), a.max(0).tolist()]
            types = [pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], ["cell", "block", "n", "zero", "ids", "data", "lo", "hi"])

        for batch in batches:
            for id_, c, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if ids and (c != cell or len(ids) == rows):
                    yield block()
                    number, ids, data = number + 1, [], []
                cell = c
                ids.append(id_)
                data.append(d)
        if ids:
            yield block()

    placed = _clean(vectors, id_col, vec_col).where(F.size("vec") == dim).mapInArrow(place, "id long, cell int, angle double, data binary")
    return placed.repartitionByRange("cell", "angle", "id").sortWithinPartitions("cell", "angle", "id").select("id", "cell", "data").mapInArrow(cut, BLOCKS)


class VectorIndex:
    """Blocks of all rows, written once, and the pivots that bound them (PIVOTS vectors)."""

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> None:
        """Rows without an id or a vector, with a null or NaN in it, or with a vector of another length than the pivots' aren't indexed; ids may repeat."""
        self.pivots = pivots_of(vectors, vec_col)
        self.blocks = written(blocks_of(vectors, self.pivots, id_col, vec_col, BLOCK), "vector-blocks")

    def _pairs(self, queries: DataFrame) -> DataFrame:
        """``query_block, block, bound``: each block of queries with the blocks of each cell, and the greatest cosine that their rows can have.

        Blocks stand for thousands of rows, so these are few beside the pairs of rows.
        """
        cells = F.explode(F.sequence(F.lit(-1), F.lit(max(0, len(self.pivots) - 1)))).alias("cell")
        q = queries.select(F.col("block").alias("query_block"), F.col("zero").alias("q_zero"), F.col("lo").alias("q_lo"), F.col("hi").alias("q_hi"), cells)
        b = self.blocks.select("cell", "block", "zero", "lo", "hi")
        apart = F.zip_with(F.zip_with("lo", "q_hi", lambda x, y: x - y), F.zip_with("q_lo", "hi", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
        bound: Column = F.when(F.col("zero") | F.col("q_zero"), 0.0).otherwise(F.cos(F.least(F.array_max(apart), F.lit(np.pi))))
        return q.join(b, "cell").select("query_block", "block", (bound + SLACK).alias("bound"))

    def _scored(self, pairs: DataFrame, queries: DataFrame, k: int | None, least: float | None) -> DataFrame:
        """``query_block, query_id, id, score``: of each pair of blocks the k best rows of each query, or those from ``least`` on."""
        dim = self.pivots.shape[1]
        q = queries.select(F.col("block").alias("query_block"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
        both = pairs.select("query_block", "block").join(q, "query_block").join(self.blocks.select("block", "ids", "data"), "block").select("query_block", "q_ids", "q_data", "ids", "data")

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    number, q_ids, q_data, ids, data = (batch.column(c)[i].as_py() for c in range(5))
                    s = np.round(np.frombuffer(q_data, np.float64).reshape(-1, dim) @ np.frombuffer(data, np.float64).reshape(-1, dim).T, DECIMALS) + 0.0
                    q_ids, ids = np.array(q_ids), np.array(ids)
                    s[q_ids[:, None] == ids[None, :]] = -2.0  # a row isn't its own neighbour
                    if k is not None:
                        by_id = np.argsort(ids, kind="stable")
                        best = by_id[np.argsort(-s[:, by_id], axis=1, kind="stable")[:, :k]]
                        row = np.repeat(np.arange(len(q_ids)), best.shape[1])
                        col = best.ravel()
                        keep = s[row, col] > -2.0
                        row, col = row[keep], col[keep]
                    else:
                        row, col = np.nonzero(s >= least)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), number)), pa.array(q_ids[row]), pa.array(ids[col]), pa.array(s[row, col])], ["query_block", "query_id", "id", "score"])

        return both.mapInArrow(compare, "query_block long, query_id long, id long, score double")

    def _queries(self, queries: DataFrame, id_col: str, vec_col: str) -> DataFrame:
        return written(blocks_of(queries, self.pivots, id_col, vec_col, QUERIES), "vector-queries")

    def nearest(self, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
        """``query_id, rank, id, score``: the k rows of greatest cosine for each query, ties by id, never itself; and the pairs of blocks that were compared.

        Scores are rounded to nine decimals before they are ranked.  A zero
        vector has cosine 0 with all.  Queries are read as rows of the index
        are; repeated ids count as one query each time they stand.
        """
        q = self._queries(queries, id_col, vec_col)
        pairs = written(self._pairs(q), "vector-pairs")
        visit = F.row_number().over(Window.partitionBy("query_block").orderBy(F.desc("bound"), "block"))
        pairs = written(pairs.withColumn("visit", visit), "vector-visits")
        top = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        first = written(self._scored(pairs.where(F.col("visit") <= FIRST), q, k, None), "vector-first")
        # the k-th score of each query so far, the least of them for the block
        kth = first.withColumn("rank", F.row_number().over(top)).where(F.col("rank") == k).select("query_block", "query_id", "score")
        sizes = q.select(F.col("block").alias("query_block"), F.size(F.array_distinct("ids")).alias("n"))
        floor = kth.groupBy("query_block").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("known")).join(sizes, "query_block").where("known = n").select("query_block", "floor")
        rest = pairs.where(F.col("visit") > FIRST).join(floor, "query_block", "left").where(F.col("bound") >= F.coalesce("floor", F.lit(-2.0))).drop("floor")
        rest = written(rest, "vector-rest")
        found = first.unionByName(self._scored(rest, q, k, None)).select("query_id", "id", "score").distinct()
        compared = pairs.where(F.col("visit") <= FIRST).unionByName(rest).select("query_block", "block")
        return found.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score"), compared

    def within(self, queries: DataFrame, least: float, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
        """``query_id, id, score``: all rows whose cosine with a query is ``least`` or more, never itself; and the pairs of blocks that were compared."""
        q = self._queries(queries, id_col, vec_col)
        pairs = written(self._pairs(q).where(F.col("bound") >= least), "vector-pairs")
        return self._scored(pairs, q, None, least).select("query_id", "id", "score").distinct(), pairs.select("query_block", "block")

    def share_compared(self, compared: DataFrame, queries: int) -> float:
        """Pairs of a query and a row that were compared, of all."""
        rows = self.blocks.agg(F.sum("n")).first()[0]
        met = compared.join(self.blocks.select("block", "n"), "block").agg(F.sum("n")).first()[0] or 0
        blocks = compared.select("query_block").distinct().count()
        return met * (queries / max(1, blocks)) / max(1, rows * queries)

    def close(self) -> None:
        discard(self.blocks)
