"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into segments.  If two codes differ in fewer than
``segments * (radius + 1)`` bits, some segment of theirs differs in at most
``radius`` bits.  A search therefore probes every segment's table within a
radius, verifies what it finds, and grows the radius segment by segment until
the distance of the k-th verified neighbour is covered.

Rows and queries meet in blocks: each block of rows carries its own tables and
gives its k best for each query of a block; a merge keeps the k best of all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, written

K = 10
SEGMENT_BITS = 16
#: Rows and codes of queries that meet in one task.
BLOCK_ROWS = 1 << 18
BLOCK_QUERIES = 1 << 15


def sign_code(vector: Column, dims: int) -> Column:
    """One bit for each of ``dims`` components (positive: 1; null or NaN: 0) as a string of hex digits; null unless the vector has ``dims``."""
    bits = F.transform(vector, lambda x: F.when((x > 0) & ~F.isnan(x), "1").otherwise("0"))
    words = [F.lpad(F.conv(F.array_join(F.slice(bits, i + 1, 16), ""), 2, 16), 4, "0") for i in range(0, dims, 16)]
    return F.when(F.size(vector) == dims, F.concat(*words))


@lru_cache(maxsize=64)
def _flips(radius: int) -> np.ndarray:
    """All segment values with exactly ``radius`` bits."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(SEGMENT_BITS), radius)], np.int64)


class MultiIndex:
    """Tables of all segments of a block of codes.

    Codes may repeat; ids are whole numbers, and of equal distances the smaller
    id comes first.  A block may be empty.
    """

    def __init__(self, ids: np.ndarray, codes: np.ndarray) -> None:
        """codes: one row of 16-bit words per id."""
        order = np.argsort(ids, kind="stable")
        self.ids, self.codes = ids[order], codes[order]
        self.tables = []
        for s in range(codes.shape[1]):
            at = np.argsort(self.codes[:, s], kind="stable")
            self.tables.append((at, np.searchsorted(self.codes[at, s], np.arange((1 << SEGMENT_BITS) + 1))))

    def search(self, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and distances of the k nearest, ties by id, and all ties of the k-th kept out by id order."""
        n, segments = len(self.ids), len(self.tables)
        seen = np.zeros(n, bool)
        found, dist = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for radius in range(SEGMENT_BITS + 1):
            for s, (at, bounds) in enumerate(self.tables):
                # with this step, every code at a distance of up to radius * segments + s is verified
                probe = code[s] ^ _flips(radius)
                lo, hi = bounds[probe], bounds[probe + 1]
                full = hi > lo
                if full.any():
                    lo, size = lo[full], (hi - lo if full.all() else hi[full] - lo[full])
                    new = at[np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]
                    new = new[~seen[new]]
                    seen[new] = True
                    d = np.bitwise_count(self.codes[new] ^ code.astype(np.uint16)).sum(1).astype(np.int64)
                    found, dist = np.concatenate([found, new]), np.concatenate([dist, d])
                    if len(found) > 64 * k:
                        best = np.lexsort((found, dist))[:k]
                        found, dist = found[best], dist[best]
                if len(found) >= k and np.partition(dist, k - 1)[k - 1] <= radius * segments + s:
                    best = np.lexsort((found, dist))[:k]
                    return found[best], dist[best]
        best = np.lexsort((found, dist))[:k]
        return found[best], dist[best]


def _words(codes: pd.Series) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex("".join(codes)), ">u2").reshape(len(codes), -1)
    return raw.astype(np.uint16)


def top_k(rows: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", code_col: str = "code") -> DataFrame:
    """``query_id, rank, neighbor_id, distance``: the k nearest other rows of each query by Hamming distance, ties by id.

    Codes are hex strings of equal length in multiples of 4.  Rows with a null
    id or code are left out; a query isn't its own neighbour; equal rows are
    neighbours only under different ids; a repeated id is one row, of its
    smallest code.  Fewer than k rows give fewer ranks; empty tables no rows.

    Of rows of one code only the k + 1 smallest ids can be among a query's k
    nearest, and queries of one code are searched for once, so a code that
    very many rows have costs no more than others.
    """
    clean = lambda df: df.select(df[id_col].cast("long").alias("id"), df[code_col].alias("code")).where("id is not null and code is not null").groupBy("id").agg(F.min("code").alias("code"))
    of_code = Window.partitionBy("code").orderBy("id")
    rows, queries = clean(rows).withColumn("r", F.row_number().over(of_code)).where(F.col("r") <= k + 1).drop("r"), clean(queries)
    rows, codes = written(rows, "topk-rows"), written(queries.select("code").distinct(), "topk-codes")
    blocks = lambda df, size: max(1, -(-df.count() // size))
    n, m = blocks(rows, BLOCK_ROWS), blocks(codes, BLOCK_QUERIES)
    left = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n))).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    right = codes.withColumn("q", F.pmod(F.xxhash64("code"), F.lit(m)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))

    def block(r: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if r.empty or q.empty:
            return pd.DataFrame({"code": pd.Series(dtype=str), "neighbor_id": pd.Series(dtype="int64"), "distance": pd.Series(dtype="int64")})
        index = MultiIndex(r["id"].to_numpy(np.int64), _words(r["code"]))
        found = [index.search(code, k + 1) for code in _words(q["code"]).astype(np.int64)]
        sizes = [len(at) for at, _ in found]
        return pd.DataFrame({"code": np.repeat(q["code"].to_numpy(), sizes), "neighbor_id": np.concatenate([index.ids[at] for at, _ in found]), "distance": np.concatenate([d for _, d in found])})

    found = left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInPandas(block, "code string, neighbor_id long, distance long")
    best = Window.partitionBy("code").orderBy("distance", "neighbor_id")
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).groupBy("code").agg(F.array_sort(F.collect_list(F.struct("distance", "neighbor_id"))).alias("near"))
    others = F.slice(F.filter("near", lambda x: x.neighbor_id != F.col("id")), 1, k)
    out = queries.join(found, "code").select(F.col("id").alias("query_id"), F.posexplode(others).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), "x.neighbor_id", "x.distance")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of each vector whose id is divisible by 100, among all vectors, by sign bits."""
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", sign_code(F.col("embedding"), 64).alias("code"))
    return top_k(rows, rows.where("vec_id % 100 = 0"))


OP3_SQL = f"""
WITH c AS (
  SELECT vec_id, min(list_aggregate(list_transform(embedding, lambda x: CASE WHEN x > 0 AND NOT isnan(x) THEN '1' ELSE '0' END), 'string_agg', ''))::BIT AS code
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = 64 GROUP BY vec_id),
d AS (
  SELECT q.vec_id AS query_id, r.vec_id AS neighbor_id, CAST(bit_count(xor(q.code, r.code)) AS BIGINT) AS distance
  FROM c q JOIN c r ON q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank, neighbor_id, distance FROM d)
WHERE rank <= {K}
"""
