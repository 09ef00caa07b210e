"""Removal of repeated substrings by suffix arrays.

Every byte goes that lies in a ``LENGTH``-byte string which also starts in a
document with a smaller id.  Suffix arrays are built over buckets of text, so
that equal strings always meet:

1. Documents are packed into chunks, compressed, one row each.
2. Each string has an anchor, the 24 bytes within it whose hash is least, so
   equal strings have equal anchors.  Neighbouring strings of one anchor form
   a segment.  Anchors, dealt out by hash and counted once per chunk, show
   which stand in two documents at least; chunks are told which.
3. Segments at such anchors go, once per chunk, to the bucket of their anchor.
   A suffix array over a bucket's distinct segments and its common prefixes
   give each string's smallest document.  An anchor that very many documents
   share is split: each of its strings goes to a bucket by its own hash.
4. Chunks get the smallest documents of their strings and cut the texts.

Each chunk adds an anchor, a segment or a string to a bucket once, however
often it holds it.  With over ``MEET`` chunks a bucket meets in two steps, so
that one which stands in all chunks isn't gathered in one task: the chunks are
dealt into parts, each part's rows of a bucket are merged to one, the bucket
decides on these, and each part tells its chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, hexdigest, in_batches, prefix_hash, read_table, released_group, run_hash, text_buffers, written
from .suffix import common_prefixes, suffix_array, words_at

LENGTH, ANCHOR = 50, 24
#: Bytes of text of a chunk, of the text whose anchors a bucket counts, and of segments that are sorted together.
CHUNK, COUNTED, SORTED = 4 << 20, 16 << 20, 1 << 19
#: Parts of a bucket that are sorted one after the other; a chunk has a row for each bucket, so larger buckets mean fewer rows.
SHELVES = 8
#: Windows that are hashed at a time.
STEP = 1 << 18
#: Documents that may share an anchor before its strings are dealt out one by one.
SHARED = 4096
#: Chunks whose rows of a bucket meet in one step, and parts' rows at most.
MEET = 1 << 14

_PLACE = np.uint64((1 << 27) - 1)


def _pack(docs: DataFrame) -> DataFrame:
    """``chunk, ids, live, sizes, body, n_bytes, rest``: documents in rows of about CHUNK bytes of text; ``rest`` holds further columns."""
    rest = [c for c in docs.columns if c not in ("id", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def row(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts).combine_chunks()
            data, at = text_buffers(table.column("text"))
            ids = table.column("id").combine_chunks()
            packed = [ids.fill_null(0).to_numpy().astype(np.int64).tobytes(), (~np.asarray(ids.is_null())).astype(np.uint8).tobytes(), np.diff(at).tobytes(), zstandard.ZstdCompressor(level=6).compress(data.tobytes())]
            other = pa.BufferOutputStream()
            with pa.ipc.new_stream(other, table.select(rest).schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as sink:
                sink.write_table(table.select(rest))
            packed.append(other.getvalue().to_pybytes() if rest else None)
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | n]), *(pa.array([x], pa.binary()) for x in packed), pa.array([len(data)])], ["chunk", "ids", "live", "sizes", "body", "rest", "n_bytes"])

        for batch in batches:
            _, at = text_buffers(batch.column("text"))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK - size, "right")) - 1)
                held.append(batch.slice(lo, hi - lo))
                size += int(at[hi] - at[lo])
                lo = hi
                if size >= CHUNK or lo < batch.num_rows:
                    yield row(held)
                    n, held, size = n + 1, [], 0
        if held:
            yield row(held)

    return docs.transform(in_batches(run, "chunk long, ids binary, live binary, sizes binary, body binary, rest binary, n_bytes long"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row at a time as Python values."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _sums(at: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """How many of each text's bytes are marked."""
    sums = np.zeros(len(mask) + 1, np.int32 if len(mask) < 1 << 31 else np.int64)
    np.cumsum(mask, out=sums[1:])
    return (sums[at[1:]] - sums[at[:-1]]).astype(np.int64)


def _runs_of(ordered: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    cuts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(ordered)]).tolist()
    return list(zip(cuts, [*cuts[1:], len(ordered)]))


class Chunk:
    """Texts of one chunk and their segments."""

    def __init__(self, row: dict) -> None:
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.live = np.frombuffer(row["live"], np.uint8).astype(bool)
        self.at = np.concatenate([[0], np.cumsum(np.frombuffer(row["sizes"], np.int64))])
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["body"], max_output_size=max(1, int(self.at[-1]))), np.uint8)

    def _docs(self, lo: int, hi: int) -> np.ndarray:
        """The document of each byte from lo to hi."""
        first, last = (int(np.searchsorted(self.at, x, "right")) - 1 for x in (lo, hi - 1))
        steps = np.zeros(hi - lo, np.int32)
        np.add.at(steps, self.at[first + 1 : last + 1] - lo, 1)
        steps[0] = first
        return np.cumsum(steps, dtype=np.int32)

    def segments(self) -> None:
        """Fill in ``start`` and ``count`` (windows) of every segment, its ``anchor``, ``content`` hash and ``doc``."""
        out, width = [], LENGTH - ANCHOR + 1
        for lo in range(0, len(self.data) - LENGTH + 1, STEP):
            hi = min(lo + STEP, len(self.data) - LENGTH + 1)
            prefix = prefix_hash(self.data[lo : hi + LENGTH - 1])
            place = np.arange(hi - lo + width - 1)
            h = run_hash(prefix, place, place + ANCHOR)
            least = (h & ~_PLACE) | place.astype(np.uint64)
            span = 1
            while 2 * span <= width:
                least = np.minimum(least[:-span], least[span:])
                span *= 2
            least = np.minimum(least[: hi - lo], least[width - span : width - span + hi - lo])
            anchor = (least & _PLACE).astype(np.int64)
            doc = self._docs(lo, hi + LENGTH - 1)
            own = doc[: hi - lo]
            at = np.flatnonzero((own == doc[LENGTH - 1 :]) & self.live[own])
            if not len(at):
                continue
            anchor = anchor[at]
            new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (anchor[1:] != anchor[:-1])])
            first = np.flatnonzero(new)
            start, count = at[first], np.diff(np.append(first, len(at)))
            out.append((start + lo, count, self.ids[own[start]], h[anchor[first]], run_hash(prefix, start, start + count + LENGTH - 1)))
        none = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2
        self.start, self.count, self.doc, self.anchor, self.content = (np.concatenate(x) for x in zip(*out)) if out else none

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """For each segment its content's number, and for each content the segment where it stands first."""
        _, first, number = np.unique(self.content, return_index=True, return_inverse=True)
        return number, first


def _slots(anchor: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of a hash, and 32 further bits by which a bucket tells hashes apart (a clash costs work, not results)."""
    return ((anchor >> np.uint64(32)) % np.uint64(n)).astype(np.int64), anchor.astype(np.uint32)


def _anchors(chunks: DataFrame, n: int) -> DataFrame:
    """``bucket, chunk, h, docs``: packed anchors of each chunk and in how many of its documents they stand (up to 65535)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            c = Chunk(row)
            c.segments()
            order = np.lexsort((c.doc, c.anchor))
            anchor, doc = c.anchor[order], c.doc[order]
            new = np.concatenate([[True], anchor[1:] != anchor[:-1]])[: len(anchor)]
            more = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])[: len(anchor)]
            first = np.flatnonzero(new)
            docs = np.minimum(np.add.reduceat(more, first, dtype=np.int64), 65535).astype(np.uint16) if len(first) else np.zeros(0, np.uint16)
            bucket, h = _slots(anchor[first], n)
            o = np.argsort(bucket, kind="stable")
            bucket, h, docs = bucket[o], h[o], docs[o]
            cuts = _runs_of(bucket)
            yield pa.RecordBatch.from_arrays(
                [pa.array([bucket[a] for a, _ in cuts], pa.int64()), pa.array(np.full(len(cuts), row["chunk"])), *(pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()) for x in (h, docs))],
                ["bucket", "chunk", "h", "docs"],
            )

    return chunks.transform(in_batches(run, _ANCHORS))


_ANCHORS = "bucket long, chunk long, h binary, docs binary"
_SHARED = "chunk long, bucket long, h binary, hot binary"


def _counts(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of each row and of all rows, the order that sorts them, where each one begins in it, and documents by anchor."""
    parts = [np.frombuffer(x, np.uint32) for x in table.column("h").to_pylist()]
    h, docs = np.concatenate(parts), np.frombuffer(b"".join(table.column("docs").to_pylist()), np.uint16).astype(np.int64)
    order = np.argsort(h, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
    return parts, h, order, first, np.add.reduceat(docs[order], first)


def _shared(table: pa.Table) -> pa.Table:
    """For each chunk of a bucket its anchors that stand in two documents at least, and which of them very many share."""
    parts, h, order, first, sums = _counts(table)
    total = np.empty(len(h), np.int64)
    total[order] = np.repeat(sums, np.diff(np.append(first, len(h))))
    cuts = np.cumsum([0, *map(len, parts)])
    out = [(x[t > 1].tobytes(), (t[t > 1] > SHARED).tobytes()) for x, t in zip(parts, np.split(total, cuts[1:-1]))]
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "h": pa.array([a for a, _ in out], pa.binary()), "hot": pa.array([b for _, b in out], pa.binary())})


def _merged_anchors(table: pa.Table) -> pa.Table:
    """The rows of a bucket and part as one row of the part."""
    _, h, order, first, sums = _counts(table)
    return pa.table([table.column("bucket")[:1], table.column("part")[:1], pa.array([h[order][first].tobytes()], pa.binary()), pa.array([np.minimum(sums, 65535).astype(np.uint16).tobytes()], pa.binary())], ["bucket", "chunk", "h", "docs"])


def _tell_anchors(rows: pa.Table, told: pa.Table) -> pa.Table:
    """What the part was told, for each of its chunks."""
    known = np.frombuffer(b"".join(told.column("h").to_pylist()), np.uint32)
    hot = np.frombuffer(b"".join(told.column("hot").to_pylist()), bool)
    order = np.argsort(known)
    known, hot = known[order], hot[order]
    out = []
    for x in rows.column("h").to_pylist():
        h = np.frombuffer(x, np.uint32)
        at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
        keep = known[at] == h if len(known) else np.zeros(len(h), bool)
        out.append((h[keep].tobytes(), hot[at[keep]].tobytes()))
    return pa.table({"chunk": rows.column("chunk"), "bucket": rows.column("bucket"), "h": pa.array([a for a, _ in out], pa.binary()), "hot": pa.array([b for _, b in out], pa.binary())})


Step = Callable[[pa.Table], pa.Table]


def _in_buckets(rows: DataFrame, n_chunks: int, decide: Step, merge: Step, tell: Callable[[pa.Table, pa.Table], pa.Table], out: str) -> DataFrame:
    """``decide`` for each bucket's rows of (bucket, chunk, ...); with over MEET chunks in two steps, for parts of the chunks and then for their chunks."""
    if n_chunks <= MEET:
        return rows.groupBy("bucket").applyInArrow(released_group(decide), out)
    schema = rows.schema
    rows = written(rows.withColumn("part", F.pmod(F.xxhash64("chunk"), F.lit(-(-n_chunks // MEET)))), "cut-parts")
    merged = rows.groupBy("bucket", "part").applyInArrow(released_group(merge), schema)
    decided = merged.groupBy("bucket").applyInArrow(released_group(decide), out).withColumnRenamed("chunk", "part")
    return rows.groupBy("bucket", "part").cogroup(decided.groupBy("bucket", "part")).applyInArrow(released_group(tell), out)


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions of all runs [start, start + size), one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(start, size)


def _pack_segments(shelf: np.ndarray, segment: np.ndarray, offset: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray, body: np.ndarray) -> bytes:
    """Columns of segments, compressed; ``shelf`` rises and ``segment`` rises within it, so neighbours are of one document."""
    columns = (shelf.astype(np.uint8), np.diff(segment, prepend=0).astype(np.uint32), offset.astype(np.uint8), size.astype(np.uint8), np.diff(low, prepend=0), high - low, body)
    return zstandard.ZstdCompressor(level=3).compress(b"".join(c.tobytes() for c in columns))


def _unpack_segments(packed: bytes, n: int) -> tuple[np.ndarray, ...]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    at, out = 0, []
    for kind in (np.uint8, np.uint32, np.uint8, np.uint8, np.int64, np.int64):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    low = np.cumsum(out[4])
    # the differences are counted modulo 2**32, as a shelf begins anew
    segment = np.cumsum(out[1], dtype=np.uint32).astype(np.int64)
    return out[0], segment, out[2].astype(np.int64), out[3].astype(np.int64), low, low + out[5], np.frombuffer(raw, np.uint8, -1, at)


def _candidates(chunks: DataFrame, n_anchor: int, n: int) -> DataFrame:
    """``bucket, chunk, n, packed``: distinct segments of each chunk at shared anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            c = Chunk(row)
            c.segments()
            told = [(p["bucket"], np.frombuffer(p["h"], np.uint32), np.frombuffer(p["hot"], np.uint8)) for p in row["told"] or []]
            known = np.concatenate([h.astype(np.int64) | b << 32 for b, h, _ in told]) if told else np.zeros(0, np.int64)
            hot = np.concatenate([x for _, _, x in told]) if told else np.zeros(0, np.uint8)
            order = np.argsort(known)
            known, hot = known[order], hot[order].astype(bool)
            bucket, h = _slots(c.anchor, n_anchor)
            key = bucket << 32 | h.astype(np.int64)
            at = np.minimum(np.searchsorted(known, key), max(0, len(known) - 1))
            keep = np.flatnonzero(known[at] == key) if len(known) else np.zeros(0, np.int64)
            # of equal segments one goes on, with the smallest and largest document it stands in
            o = keep[np.lexsort((keep, c.content[keep]))]
            new = np.flatnonzero(np.concatenate([[True], c.content[o][1:] != c.content[o][:-1]])[: len(o)])
            first = o[new]
            low, high = (f.reduceat(c.doc[o], new) if len(new) else c.doc[:0] for f in (np.minimum, np.maximum))
            to = ((c.anchor[first] >> np.uint64(20)) % np.uint64(n)).astype(np.int64)
            offset, size, start = np.zeros(len(first), np.int64), c.count[first] + LENGTH - 1, c.start[first]
            split = hot[at[first]] if len(hot) else np.zeros(0, bool)
            if split.any():
                count = c.count[first[split]]
                each = _runs(np.zeros(len(count), np.int64), count)
                where = np.repeat(start[split], count) + each
                prefix = [prefix_hash(c.data[s : s + k + LENGTH - 1]) for s, k in zip(start[split].tolist(), count.tolist())]
                own = np.concatenate([run_hash(p, np.arange(k), np.arange(k) + LENGTH) for p, k in zip(prefix, count.tolist())])
                again = lambda x: np.concatenate([x[~split], np.repeat(x[split], count)])
                to = np.concatenate([to[~split], ((own >> np.uint64(20)) % np.uint64(n)).astype(np.int64)])
                first, low, high = again(first), again(low), again(high)
                offset, start = np.concatenate([offset[~split], each]), np.concatenate([start[~split], where])
                size = np.concatenate([size[~split], np.full(len(each), LENGTH)])
            o = np.lexsort((first, to))
            rows, bucket = [], to // SHELVES
            for lo, hi in _runs_of(bucket[o]):
                p = o[lo:hi]
                rows.append((bucket[p[0]], row["chunk"], len(p), _pack_segments(*(x[p] for x in (to % SHELVES, first, offset, size, low, high)), c.data[_runs(start[p], size[p])])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if k < 3 else pa.binary()) for k, x in enumerate(zip(*rows))], ["bucket", "chunk", "n", "packed"])

    return chunks.transform(in_batches(run, "bucket long, chunk long, n long, packed binary"))


_RUNS = "bucket long, chunk long, segment binary, offset binary, size binary, doc binary"


class _Segments:
    """All segments of a table's rows; ``number`` tells equal ones, which ``first`` has once, in the order of their hashes."""

    def __init__(self, table: pa.Table) -> None:
        parts, content = [], []
        for packed, n in zip(table.column("packed").to_pylist(), table.column("n").to_pylist()):
            parts.append(_unpack_segments(packed, n))
            end = np.cumsum(parts[-1][3])
            content.append(run_hash(prefix_hash(parts[-1][-1]), end - parts[-1][3], end))
        self.rows, self.owner = table.num_rows, np.repeat(np.arange(table.num_rows), table.column("n").to_numpy())
        self.shelf, self.segment, self.offset, self.size, self.low, self.high, self.text = (np.concatenate(x) for x in zip(*parts))
        del parts
        self.start = np.cumsum(self.size) - self.size
        _, self.first, self.number = np.unique(np.concatenate(content), return_index=True, return_inverse=True)

    def told(self, table: pa.Table, run_of: np.ndarray, run_at: np.ndarray, run_size: np.ndarray, run_doc: np.ndarray) -> pa.Table:
        """For each row its segments' runs, from those of the distinct segments (in their order), where a smaller document has them."""
        n_runs = np.bincount(run_of, minlength=len(self.first))
        run_from = np.cumsum(n_runs) - n_runs
        pick = _runs(run_from[self.number], n_runs[self.number])
        seg = np.repeat(np.arange(len(self.number)), n_runs[self.number])
        keep = run_doc[pick] < self.high[seg]
        pick, seg = pick[keep], seg[keep]
        cuts = np.searchsorted(self.owner[seg], np.arange(self.rows + 1))
        packed = [(self.segment[seg], np.int32), (self.offset[seg] + run_at[pick], np.int32), (run_size[pick], np.int32), (run_doc[pick], np.int64)]
        arrays = [pa.array([x[cuts[k] : cuts[k + 1]].astype(t).tobytes() for k in range(self.rows)], pa.binary()) for x, t in packed]
        return pa.table([table.column("bucket"), table.column("chunk"), *arrays], ["bucket", "chunk", "segment", "offset", "size", "doc"])


def _smallest(table: pa.Table) -> pa.Table:
    """For each chunk of a bucket the windows that also stand in a smaller document than some document of the chunk: runs ``(segment, offset, size, doc)``."""
    s = _Segments(table)
    # equal segments of several chunks are sorted once
    least = np.full(len(s.first), np.iinfo(np.int64).max)
    np.minimum.at(least, s.number, s.low)
    order = np.argsort(s.shelf[s.first], kind="stable")
    runs = []
    for lo, hi in _runs_of(s.shelf[s.first][order]):
        some = order[lo:hi]
        at = s.first[some]
        of, *run = _runs_of_least(s.text[_runs(s.start[at], s.size[at])], s.size[at], least[some])
        runs.append((some[of], *run))
    run_of, *run = (np.concatenate(x) for x in zip(*runs))
    order = np.argsort(run_of, kind="stable")
    return s.told(table, run_of[order], *(x[order] for x in run))


def _runs_of_least(text: np.ndarray, size: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs ``segment, offset, size, doc`` of the windows of distinct segments that have one smallest document, from each segment's smallest one."""
    windows, begin = size - LENGTH + 1, np.cumsum(size) - size
    place = _runs(begin, windows)
    of = np.repeat(np.arange(len(size)), windows)

    window = np.full(len(text), -1, np.int32)
    window[place] = np.arange(len(place))
    key = words_at(text)
    order = suffix_array(text, LENGTH, key)
    order = order[window[order] >= 0]
    new = common_prefixes(key, order, LENGTH) < LENGTH
    del key
    group = np.flatnonzero(new)
    docs = least[of[window[order]]]
    smallest = np.empty(len(place), np.int64)
    smallest[window[order]] = np.repeat(np.minimum.reduceat(docs, group), np.diff(np.append(group, len(order))))
    cut = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (smallest[1:] != smallest[:-1])]))
    return of[cut], place[cut] - begin[of[cut]], np.diff(np.append(cut, len(of))), smallest[cut]


def _merged_segments(table: pa.Table) -> pa.Table:
    """The rows of a bucket and part as one row of the part: its distinct segments, numbered, with their smallest and largest documents."""
    s = _Segments(table)
    low, high = np.full(len(s.first), np.iinfo(np.int64).max), np.full(len(s.first), np.iinfo(np.int64).min)
    np.minimum.at(low, s.number, s.low)
    np.maximum.at(high, s.number, s.high)
    n, size = len(s.first), s.size[s.first]
    order = np.argsort(s.shelf[s.first], kind="stable")
    some = s.first[order]
    packed = _pack_segments(s.shelf[some], order, np.zeros(n, np.int64), size[order], low[order], high[order], s.text[_runs(s.start[some], size[order])])
    return pa.table([table.column("bucket")[:1], table.column("part")[:1], pa.array([n], pa.int64()), pa.array([packed], pa.binary())], ["bucket", "chunk", "n", "packed"])


def _tell_segments(rows: pa.Table, told: pa.Table) -> pa.Table:
    """What the part was told of its distinct segments, for each of its chunks."""
    join = lambda name, kind: np.frombuffer(b"".join(told.column(name).to_pylist()), kind).astype(np.int64)
    run_of = join("segment", np.int32)
    order = np.argsort(run_of, kind="stable")
    return _Segments(rows).told(rows, run_of[order], *(join(*x)[order] for x in (("offset", np.int32), ("size", np.int32), ("doc", np.int64))))


def _cut(chunks: DataFrame, id_type: str, kept: bool, rest: str = "") -> DataFrame:
    """Results of the documents of chunks that know their runs; ``rest`` is the schema of further columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            c = Chunk(row)
            edge = np.zeros(len(c.data) + 1, np.int32)
            told = row["told"] or []
            join = lambda name, kind: np.concatenate([np.frombuffer(p[name], kind) for p in told]).astype(np.int64)
            if told and len(segment := join("segment", np.int32)):
                c.segments()
                offset, size, doc = join("offset", np.int32), join("size", np.int32), join("doc", np.int64)
                number, _ = c.distinct()
                # runs by content, then one copy for each segment of that content
                of = number[segment]
                o = np.argsort(of, kind="stable")
                n_runs = np.bincount(of, minlength=len(c.start))
                first = np.cumsum(n_runs) - n_runs
                hit = np.flatnonzero(n_runs[number])
                pick = o[_runs(first[number[hit]], n_runs[number[hit]])]
                seg = np.repeat(hit, n_runs[number[hit]])
                keep = doc[pick] < c.doc[seg]
                lo = c.start[seg[keep]] + offset[pick[keep]]
                np.add.at(edge, lo, 1)
                np.add.at(edge, lo + size[pick[keep]] + LENGTH - 1, -1)
            gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
            del edge
            starts = gone.copy()
            starts[1:] &= ~gone[:-1]
            inner = c.at[1:-1][c.at[1:-1] < len(gone)]
            starts[inner] = gone[inner]
            removed, spans = _sums(c.at, gone), _sums(c.at, starts)
            left = []
            for a, b, r in zip(c.at[:-1].tolist(), c.at[1:].tolist(), removed.tolist()):
                left.append((c.data[a:b][~gone[a:b]] if r else c.data[a:b]).tobytes())
            ids = pa.array(c.ids, mask=~c.live)
            arrays = [ids, pa.array(np.diff(c.at)), pa.array(removed), pa.array(spans), pa.array(map(hexdigest, left), pa.string())]
            if kept:
                arrays.append(pa.array(left, pa.binary()))
            names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(arrays)]
            if rest:
                other = pa.ipc.open_stream(row["rest"]).read_all().combine_chunks()
                arrays += [x.combine_chunks() for x in other.columns]
                names += other.column_names
            yield pa.RecordBatch.from_arrays(arrays, names)

    out = chunks.transform(in_batches(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * kept + rest))
    return out.withColumn("id", F.col("id").cast(id_type))


def _run(docs: DataFrame, id_type: str, kept: bool, rest: str = "") -> DataFrame:
    chunks = written(_pack(docs), "cut-chunks")
    n_chunks, total = chunks.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    n_anchor = total // COUNTED + 1
    shared = written(_in_buckets(_anchors(chunks, n_anchor), n_chunks, _shared, _merged_anchors, _tell_anchors, _SHARED).where(F.length("h") > 0), "cut-anchors", total // 24)
    entries = (shared.agg(F.sum(F.length("h"))).first()[0] or 0) // 4
    n = entries * 64 // SORTED + 1
    told = shared.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "h", "hot")).alias("told"))
    found = _candidates(chunks.join(told, "chunk"), n_anchor, n)
    runs = written(_in_buckets(found, n_chunks, _smallest, _merged_segments, _tell_segments, _RUNS).drop("bucket").where(F.length("doc") > 0), "cut-runs", total // 12)
    discard(shared)
    told = runs.groupBy("chunk").agg(F.collect_list(F.struct("segment", "offset", "size", "doc")).alias("told"))
    return _cut(chunks.join(told, "chunk", "left"), id_type, kept, rest)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kept: bool = False) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept_sha256`` for each row, with ``kept=True`` also the bytes that stay.

    Texts are UTF-8 bytes; null counts as empty.  Matches never cross texts
    and are judged on the input.  Rows with a null id lose nothing and take
    nothing from others, rows of equal id don't take from each other, all are
    returned.  Further columns are ignored; an empty table gives no rows.  Ids
    are integers.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    return _run(docs, id_type, kept).withColumnRenamed("id", id_col)


def cut_documents(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` with repeats cut out of ``text``; ``n_chars`` of a cut text is counted anew.

    A character that loses some of its bytes goes as a whole.  A text of which
    nothing is left goes; texts that were empty or null stay as they are, and
    so do rows with a null id.  Rows of one id aren't cut by each other; columns
    may have any names; an empty table gives no rows.
    """
    others = [f for f in docs.schema.fields if f.name not in ("doc_id", "text")]
    named = {f.name: f"c{k}" for k, f in enumerate(others)}
    columns = [docs["doc_id"].cast("long").alias("id"), F.coalesce(docs["text"], F.lit("")).alias("text"), docs["text"].isNull().alias("was_null")]
    rest = ", was_null boolean" + "".join(f", {named[f.name]} {f.dataType.simpleString()}" for f in others)
    cut = _run(docs.select(*columns, *(docs[f.name].alias(named[f.name]) for f in others)), docs.schema["doc_id"].dataType.simpleString(), True, rest)
    cut = cut.where("n_removed = 0 or n_removed < n_bytes")
    # bytes of a cut character at an edge of what is left are no character of their own
    text = F.when(F.col("n_removed") > 0, F.replace(F.make_valid_utf8(F.col("kept").cast("string")), F.lit("\ufffd"), F.lit(""))).otherwise(F.col("kept").cast("string"))
    cut = cut.withColumn("text", F.when(~F.col("was_null"), text))
    value = lambda f: F.when(F.col("n_removed") > 0, F.length("text").cast(f.dataType)).otherwise(F.col(named[f.name])) if f.name == "n_chars" else F.col(named[f.name])
    by_name = {f.name: value(f).alias(f.name) for f in others} | {"doc_id": F.col("id").alias("doc_id"), "text": F.col("text")}
    return cut.select(*(by_name[c] for c in docs.columns))


def op4_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents."""
    return remove_repeats(read_table(spark, sf_dir, "documents"))


#: Every string of LENGTH bytes as hex digits, the smallest document it starts in, and the bytes that no such string of a smaller document covers.
OP4_SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, p, hash(substr(x, 2 * p + 1, {2 * LENGTH})) AS h FROM (SELECT doc_id, x, unnest(range(length(x) // 2 - {LENGTH - 1})) AS p FROM d)),
hit AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY h) AS first_ FROM w) WHERE first_ < doc_id),
o AS (SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {LENGTH}, true) AS new_ FROM hit),
g AS (SELECT doc_id, p, sum(new_::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM o),
runs AS (SELECT doc_id, run, min(p) AS lo, max(p) + {LENGTH} AS hi FROM g GROUP BY doc_id, run),
kept AS (SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS lo, lo AS hi FROM runs UNION ALL SELECT doc_id, max(hi), NULL FROM runs GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(substr(x, 2 * lo + 1, coalesce(2 * (hi - lo), length(x))), '' ORDER BY lo) AS x FROM kept JOIN d USING (doc_id) GROUP BY doc_id),
r AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT d.doc_id, (length(d.x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k.x, d.x))) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)
"""
