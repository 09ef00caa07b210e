"""An inverted index of trigrams for substring and regular expression search.

Texts are put in lower case and cut into runs of three bytes.  Segments of
documents are indexed where they are read: for each trigram a segment has one
list of document numbers, delta-coded, so a frequent trigram has many short
lists and none grows with the corpus.  The lists are then sorted by trigram and
written, so that a search skips the row groups that have none of its trigrams.

A search takes the rarest trigrams that a hit must contain, meets their lists
segment by segment and looks at the texts that are left.  What an index says is
a superset of the hits; the text decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, written

#: Documents and bytes of a segment.
SEGMENT_DOCS, SEGMENT_BYTES = 4096, 4 << 20
_DOC_BITS = 13
#: Files that the lists of a gram may go to, as a frequent one has a list for each segment.
SPLIT = 64
#: Lists that a search reads for each alternative, the rarest ones.
READ = 4
#: Documents that are looked up by their numbers at most; more are joined.
LOOKED_UP = 10_000
#: Numbers up to which Spark may broadcast them; compressed files of more would still look small to it.
BROADCAST_IDS = 200_000

SCHEMA = "gram int, segment long, n int, first long, postings binary"


def _distinct(values: np.ndarray) -> np.ndarray:
    """Each number once, in order; ``values`` is put in order in place.

    A sort runs in vector instructions, where np.unique hashes number by number.
    """
    values.sort()
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def _coded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as bytes of seven bits, the last one without the high bit, and how many bytes each takes."""
    size = np.ones(len(values), np.int64)
    for k in range(1, (int(values.max(initial=0)).bit_length() + 6) // 7):
        size += values >= np.uint64(1 << 7 * k)
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[start[has] + k] = (values[has] >> np.uint64(7 * k)).astype(np.uint8) & 127 | np.where(size[has] > k + 1, 128, 0).astype(np.uint8)
    return out, size


def decoded(first: int, postings: bytes) -> np.ndarray:
    """Document numbers of a list."""
    data = np.frombuffer(postings, np.uint8)
    end = np.flatnonzero(data < 128)
    start = np.concatenate([[0], end[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(start, end - start + 1)
    steps = np.add.reduceat((data & 127).astype(np.uint64) << (7 * place).astype(np.uint64), start)
    return np.cumsum(steps.astype(np.int64)) + first


def _pieces(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Runs of texts of SEGMENT_BYTES at most, by their places; a longer text is cut into pieces that share two bytes."""
    places, run, held = [], [], 0
    for place, text in enumerate(texts):
        for at in range(0, max(1, len(text) - 2), SEGMENT_BYTES):
            piece = text[at : at + SEGMENT_BYTES + 2]
            if run and held + len(piece) > SEGMENT_BYTES:
                yield places, run
                places, run, held = [], [], 0
            places.append(place)
            run.append(piece)
            held += len(piece)
    if run:
        yield places, run


def _pairs(places: list[int], texts: list[bytes], rank: np.ndarray) -> np.ndarray:
    """Each trigram of texts with the rank of its document, once, as one number."""
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.int32)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    pair = (data[:-2] << 16 | data[1:-1] << 8 | data[2:]).astype(np.int64)
    pair <<= _DOC_BITS
    pair |= np.repeat(rank[np.array(places)], size)[: len(pair)]
    # what begins in the last two bytes of a text goes beyond its end
    end = np.cumsum(size)
    beyond = np.concatenate([end - 2, end - 1])
    pair[beyond[(beyond >= 0) & (beyond < len(pair))]] = -1
    pair = _distinct(pair)
    return pair[1:] if len(pair) and pair[0] < 0 else pair


def _segment(number: int, ids: list[int], texts: list[bytes]) -> pa.RecordBatch:
    known, rank = np.unique(np.array(ids, np.int64), return_inverse=True)
    pair = _distinct(np.concatenate([_pairs(places, run, rank) for places, run in _pieces(texts)]))
    gram, doc = pair >> _DOC_BITS, known[pair & (1 << _DOC_BITS) - 1]
    start = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
    steps = np.diff(doc, prepend=0)
    steps[start] = 0
    coded, taken = _coded(steps.astype(np.uint64))
    offsets = np.append(np.concatenate([[0], np.cumsum(taken)])[start], len(coded)).astype(np.int32)
    lists = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(coded)])
    n = np.diff(np.append(start, len(gram))).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(gram[start].astype(np.int32)), pa.array(np.full(len(start), number)), pa.array(n), pa.array(doc[start]), lists], ["gram", "segment", "n", "first", "postings"])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0
    for batch in batches:
        for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            ids.append(id_)
            texts.append(text)
            held += len(texts[-1])
            if len(ids) == SEGMENT_DOCS or held >= SEGMENT_BYTES:
                yield _segment(number, ids, texts)
                number, ids, texts, held = number + 1, [], [], 0
    if ids:
        yield _segment(number, ids, texts)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "ngrams") -> DataFrame:
    """The written index of ``docs``: ``gram, segment, n, first, postings``, sorted by gram.

    ``id_col`` is a whole number.  Rows without it or without a text aren't
    indexed; several rows may share one.  Texts shorter than three bytes have
    no trigram and are found by searches that need none.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.lower(F.col(text_col).cast("string")).alias("text")).where("id is not null and text is not null")
    lists = rows.mapInArrow(_segments, SCHEMA)
    # ranges of grams would be drawn from a sample, which makes all lists twice; files sorted by gram are skipped as well
    dealt = lists.repartition("gram", F.pmod(F.xxhash64("segment"), F.lit(SPLIT)))
    return written(dealt.sortWithinPartitions("gram", "segment"), name)


def grams_of(literal: bytes) -> frozenset[int]:
    return frozenset(a << 16 | b << 8 | c for a, b, c in zip(literal, literal[1:], literal[2:]))


#: Parts of an expression: an escape, a class, a quantifier, a character.
_PART = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\{[^}]*\}|.", re.DOTALL)
#: Escapes of a letter or digit that take nothing after them.
_SIMPLE_ESCAPES = "dDwWsSbBAzZntrf"


def _letter(part: str) -> str:
    """The ASCII character, in lower case, that a part of an expression stands for alone; empty for others."""
    if len(part) == 1 and part not in ".^$*+?|()[]{}":
        found = part
    elif len(part) == 2 and part[0] == "\\" and not part[1].isalnum():
        found = part[1]
    elif len(part) == 4 and part[0] == "[" and part[1].lower() == part[2].lower():
        found = part[1]
    else:
        found = ""
    return found.lower() if found.isascii() else ""


def needed_grams(pattern: str) -> list[frozenset[int]] | None:
    """For each alternative of an expression trigrams that every match has, in lower case; None if it is of a kind that isn't looked into, or an alternative needs none.

    Runs of ASCII characters outside of groups are looked at, with classes of
    one letter in both cases.
    """
    parts = _PART.findall(pattern)
    if any(p[0] == "\\" and p[1:].isalnum() and p[1:] not in _SIMPLE_ESCAPES for p in parts) or "(?" in pattern or ("(" in parts and "|" in parts):
        return None
    alternatives, runs, depth = [], [b""], 0
    for part, after in zip([*parts, "|"], [*parts[1:], "|", ""]):
        depth += (part == "(") - (part == ")")
        letter = "" if depth or after in ("*", "?") or after.startswith("{0") else _letter(part)
        if letter:
            runs[-1] += letter.encode()
        if not letter or after == "+" or after.startswith("{"):
            runs.append(b"")
        if part == "|":
            alternatives.append(frozenset().union(*map(grams_of, runs)))
            runs = [b""]
    return alternatives if all(alternatives) else None


def candidates(index: DataFrame, alternatives: Sequence[frozenset[int]]) -> DataFrame:
    """``id``: documents that have all trigrams read of some alternative (the READ rarest of each)."""
    every = sorted(frozenset().union(*alternatives))
    # a row for each trigram of the query
    counts = {r["gram"]: r["n"] for r in index.where(F.col("gram").isin(every)).groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    chosen = [sorted(sorted(a, key=lambda g: (counts[g], g))[:READ]) for a in alternatives if all(g in counts for g in a)]
    read = index.where(F.col("gram").isin(sorted({g for a in chosen for g in a}))) if chosen else index.limit(0)

    def meet(lists: pa.Table) -> pa.Table:
        found = {g: decoded(first, p) for g, first, p in zip(*(lists.column(c).to_pylist() for c in ("gram", "first", "postings")))}
        ids = [reduce(np.intersect1d, [found[g] for g in a]) for a in chosen if all(g in found for g in a)]
        return pa.table({"id": np.unique(np.concatenate(ids)) if ids else np.zeros(0, np.int64)})

    # a list has at most as many numbers as a segment has documents, so a group is small however frequent its trigrams
    return read.groupBy("segment").applyInArrow(meet, "id long").distinct()


def _among(docs: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``docs`` with the numbers found: few are looked up, so that scans skip what can't have them, more are joined."""
    found = written(found, "ngrams-found")
    few = [r["id"] for r in found.limit(LOOKED_UP + 1).collect()]
    if len(few) <= LOOKED_UP:
        discard(found)
        # as text: isin() calls the JVM for each number, which takes seconds for thousands
        name = id_col if "`" in id_col else f"`{id_col.replace('.', '`.`')}`"
        return docs.where(f"{name} IN ({', '.join(f'{i}L' for i in few)})") if few else docs.limit(0)
    found = found.withColumnRenamed("id", "found_id")
    if found.count() > BROADCAST_IDS:
        found = found.hint("merge")
    return docs.join(found, F.col(id_col) == F.col("found_id"), "left_semi")


def containing(index: DataFrame, docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose text contains ``query`` whatever its case, as a scan would find them.

    A query of less than three bytes has no trigram, so all texts are looked at.
    """
    low = docs.sparkSession.range(1).select(F.lower(F.lit(query))).first()[0]
    grams = grams_of(low.encode())
    rows = _among(docs, candidates(index, [grams]), id_col) if grams else docs.where(F.col(id_col).isNotNull())
    return rows.where(F.contains(F.lower(F.col(text_col)), F.lit(low)))


def matching(index: DataFrame, docs: DataFrame, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose text an expression matches, as a scan would find them; all texts are looked at if it needs no trigram."""
    alternatives = needed_grams(pattern)
    rows = docs.where(F.col(id_col).isNotNull()) if alternatives is None else _among(docs, candidates(index, alternatives), id_col)
    return rows.where(F.regexp_like(F.col(text_col), F.lit(pattern)))
