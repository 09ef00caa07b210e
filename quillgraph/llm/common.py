"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import hashlib
import inspect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.storage import discard, written  # noqa: F401

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Share of an Arrow batch that numpy works on at a time, in bytes of text.
SLICE_BYTES = 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hexdigest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, text: str | int, rows: int = 1 << 31) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of at most ``rows`` rows of about SLICE_BYTES of text; a longer text stands alone."""
    if not batch.num_rows:
        return
    _, at = text_buffers(batch.column(text))
    cuts = [0]
    while cuts[-1] < batch.num_rows:
        end = int(np.searchsorted(at, at[cuts[-1]] + SLICE_BYTES, "right")) - 1
        cuts.append(min(max(cuts[-1] + 1, end), cuts[-1] + rows))
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


#: Odd multiplier of the polynomial hashes and its inverse modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads 64-bit values (the constants of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
#: Random values for the 256 bytes, so that byte values don't act as small polynomial coefficients.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * BASE)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i up to n, kept for texts of the usual size."""
    if len(_powers["up"]) <= n:
        size = max(n + 1, 2 * len(_powers["up"]))
        for key, base in (("up", BASE), ("down", BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums: run_hash() gets the hash of any run of bytes from them."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=out[1:])
    return out


def run_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs [start, end), equal for equal bytes wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of the texts that ``at`` cuts ``data`` into, and how many words each text has."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at) - 1, np.int64)
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    edge = at[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] = solid[edge]
    last[edge - 1] = solid[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.diff(np.searchsorted(start, at))


def give_back() -> None:
    """Return freed memory to the system.

    Spark uses a Python worker again, for other operators too, and the worker
    would keep what its largest task took.
    """
    _powers.update(up=np.ones(1, np.uint64), down=np.ones(1, np.uint64))
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, TypeError, AttributeError):  # a C library without it
    _trim = None

Batches = Iterator[pa.RecordBatch]


#: Bytes of an Arrow batch, unless the session says otherwise: ten thousand rows, Spark's own bound, are too many if their texts are long.
BATCH_BYTES = 4 << 20


def in_batches(run: Callable[[Batches], Batches], schema: str | StructType) -> Callable[[DataFrame], DataFrame]:
    """For DataFrame.transform: ``run`` by mapInArrow, over batches of bounded bytes, giving memory back at the end of each task."""

    def task(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            give_back()

    def map_(df: DataFrame) -> DataFrame:
        conf, bound = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
        if bound not in conf.getAll:
            conf.set(bound, str(BATCH_BYTES))
        return df.mapInArrow(task, schema)

    return map_


#: Bytes of groups after which a worker gives memory back.
GROUPS_BYTES = 1 << 20
_grouped = 0


def _after(n_bytes: int) -> None:
    global _grouped
    _grouped += n_bytes
    if _grouped > GROUPS_BYTES:
        _grouped = 0
        give_back()


def released_group(run: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """``run`` for applyInArrow, giving memory back after every GROUPS_BYTES of groups."""
    if len(inspect.signature(run).parameters) == 1:

        def one(table: pa.Table) -> pa.Table:
            out = run(table)
            _after(table.nbytes)
            return out

        return one

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(left, right)
        _after(left.nbytes + right.nbytes)
        return out

    return two


def within(at: np.ndarray, mask_sums: np.ndarray) -> np.ndarray:
    """Sums per text, from prefix sums over bytes."""
    return mask_sums[at[1:]] - mask_sums[at[:-1]]


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text is divisible by 5 (a null id counts as an empty text, and is)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def draw(doc_id: Column, salt: int) -> Column:
    """A fixed number from 0 to 1 for an id, by which bounded samples are drawn."""
    return F.pmod(F.xxhash64(doc_id, F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))
