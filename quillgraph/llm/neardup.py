"""Near-duplicate documents by HyperMinHash, confirmed on full shingle sets.

1. Whole texts give the set of their 5-word shingles (64-bit hashes), a key of
   the set and a sketch: for each of 72 buckets (more for a threshold under
   0.85) the smallest hash, kept as its count of leading zeros and ten bits of
   mantissa.  Equal sets form a class and go on as one row.
2. Bands of three registers are keys, and of small sets also the first hashes,
   of which alike sets share one.  A key that very many classes share is
   joined with the keys of the next bands, which splits classes that merely
   have a passage in common: alike classes share most bands.
3. In each key's group classes are joined to clusters if the collision-corrected
   estimate isn't lower than pairs at the threshold have it in all but one of
   10^10 cases.  Only the links that hold a cluster together leave a task, not
   all its pairs.
4. In each cluster links are confirmed on the full sets: first those with the
   cluster's smallest document, which nearly all copies of one text have, then
   those of the members that lack it, in blocks of bounded bytes of which only
   the links that join components leave.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ..operators.components import components
from .common import BASE, discard, in_batches, mix, prefix_hash, read_table, released_group, run_hash, slices, text_buffers, words, written

SHINGLE = 5
#: A link needs 100 * intersection >= percent * union; this if nothing else is asked for, as in op7 and the corpus pipeline.
PERCENT = 85
#: Registers at PERCENT; a lower threshold has more, see registers().
REGISTERS, BAND, MANTISSA = 72, 3, 10
#: Shingles of a set whose first hashes are keys too, as its few shared ones may all fall into bands that differ.
SMALL = 16
EMPTY = np.uint16(0xFFFF)
#: Classes that may share a key before it is made finer, and the following bands that it is joined with.
SHARED, FINER = 4096, 6
#: Sketches of a block; full sets of a part of a cluster, and hashes in them (2 MB), two parts making a block.
SKETCHES, SETS, SET_HASHES = 8192, 256, 1 << 18
#: Chance that a pair at the threshold has a lower estimate than is asked for.
MISS = 1e-10
#: A class with more than this share of all rows is hot; there can't be more hot ones than 1 / HOT.
HOT = 1 / 1000

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def shingles(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, text after text, and how many each has.

    ASCII capitals count as small letters.  A text of fewer words than a
    shingle has its whole sequence as one; a text without words has none.
    """
    folded = _FOLD[data]
    start, end, n_words = words(folded, at)
    h = run_hash(prefix_hash(folded), start, end)
    first = np.concatenate([[0], np.cumsum(n_words)])
    rolled, short = h.copy(), {}
    for k in range(1, SHINGLE):
        short[k] = rolled.copy()
        rolled[:-k] = mix(rolled[:-k] * BASE + h[k:])
    found = []
    for a, n in zip(first.tolist(), n_words.tolist()):
        if n >= SHINGLE:
            s = np.sort(rolled[a : a + n - SHINGLE + 1])
            found.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        else:
            found.append(mix(short[n][a : a + 1] + np.uint64(n)) if n else h[:0])
    return np.concatenate(found) if found else h[:0], np.array([len(s) for s in found], np.int64)


def registers(percent: int) -> int:
    """Registers at which a pair at the threshold misses all bands in fewer than one of 10^9 cases."""
    return max(REGISTERS, BAND * math.ceil(math.log(1e-9) / math.log(1 - (percent / 100) ** BAND)))


def finer(percent: int) -> int:
    """Following bands that a hot key is joined with: fewer bands agree at a lower threshold, and twice as many keep the rate."""
    return FINER if percent >= PERCENT else 2 * FINER


def sketch(sets: np.ndarray, sizes: np.ndarray, n_registers: int = REGISTERS) -> np.ndarray:
    """HyperMinHash registers of each set: leading zeros, then the mantissa; EMPTY where no hash fell."""
    n = len(sizes)
    doc = np.repeat(np.arange(n), sizes)
    bucket = ((sets >> np.uint64(32)) * np.uint64(n_registers) >> np.uint64(32)).astype(np.int64)
    least = np.full(n * n_registers, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, doc * n_registers + bucket, mix(sets ^ BASE))
    zeros = np.uint64(64) - np.frexp(least.astype(np.float64))[1].astype(np.uint64)
    mantissa = (least << (np.minimum(zeros, np.uint64(62)) + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    out = (np.minimum(zeros, np.uint64(62)) << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    out[least == np.iinfo(np.uint64).max] = EMPTY
    return out.reshape(n, n_registers)


def bands(registers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the bands that aren't wholly empty, text after text, and how many each text has."""
    parts = registers.reshape(len(registers), -1, BAND)
    key = np.broadcast_to(np.arange(1, parts.shape[1] + 1, dtype=np.uint64) * BASE, parts.shape[:2])
    for k in range(BAND):
        key = mix(key * BASE + parts[:, :, k].astype(np.uint64))
    full = (parts != EMPTY).any(2)
    return key[full].view(np.int64), full.sum(1)


def first_hashes(sets: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the first hashes of sets of at most SMALL, text after text, and how many each text has.

    Of two sets at the threshold, each shares all but n - ceil(percent * n / 100)
    hashes, so the first hash that both have is among one more than these.
    """
    count = np.where(sizes <= SMALL, sizes - -(-percent * sizes // 100) + (sizes > 0), 0)
    # the k-th of all keys is as far from its text's first hash as from its text's first key
    at = np.arange(count.sum()) + np.repeat(np.cumsum(sizes) - sizes - np.cumsum(count) + count, count)
    return mix(sets[at] * BASE).view(np.int64), count


def _together(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of ``a`` and then those of ``b``, text after text."""
    text = np.concatenate([np.repeat(np.arange(len(n)), n) for n in (na, nb)])
    return np.concatenate([a, b])[np.argsort(text, kind="stable")], na + nb


def _corrected(share: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """A share of equal registers less the chance collisions of truncated hashes."""
    chance = 0.1699 * 2.0**-MANTISSA * 4 * na * nb / np.maximum(na + nb, 1) ** 2
    return (share - chance) / (1 - chance)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard similarity from registers, and the registers it rests on."""
    used = ((a != EMPTY) | (b != EMPTY)).sum(-1)
    same = ((a == b) & (a != EMPTY)).sum(-1) / np.maximum(used, 1)
    return _corrected(same, na, nb), used


@lru_cache
def least_equal(percent: int, n_registers: int) -> np.ndarray:
    """By the registers used: how many equal ones a pair at the threshold has at least, but for MISS of all cases (the exact binomial tail)."""
    p, out = percent / 100, []
    for used in range(n_registers + 1):
        k, tail = 0, (1 - p) ** used
        while tail < MISS and k < used:
            k += 1
            tail += math.comb(used, k) * p**k * (1 - p) ** (used - k)
        out.append(k)
    return np.array(out)


def may_link(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    found, used = estimate(a, b, na, nb)
    least = least_equal(percent, a.shape[-1])[used] / np.maximum(used, 1)
    fits = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
    return fits & (found >= _corrected(least, na, nb) - 1e-12)


def _sketches(docs: DataFrame, percent: int) -> DataFrame:
    n_registers = registers(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets, sizes = shingles(*text_buffers(part.column("text")))
                cuts = np.concatenate([[0], np.cumsum(sizes)])
                keys = _set_keys(sets, cuts)
                sig = sketch(sets, sizes, n_registers)
                key, count = _together(*bands(sig), *first_hashes(sets, sizes, percent))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(key))
                sig = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * n_registers), len(sizes), [None, pa.py_buffer(sig.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes), *map(pa.array, keys), sig, lists], ["id", "n", "k1", "k2", "sig", "bands"])

    return docs.transform(in_batches(run, f"id {docs.schema['id'].dataType.simpleString()}, n long, k1 long, k2 long, sig binary, bands array<long>"))


def _set_keys(sets: np.ndarray, cuts: np.ndarray) -> list[np.ndarray]:
    """Two numbers that are equal for equal sets alone (but for a chance of 2**-128)."""
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(sets + np.uint64(k)), dtype=np.uint64)]) for k in (1, 2)]
    return [(s[cuts[1:]] - s[cuts[:-1]]).view(np.int64) for s in sums]


def _sets(docs: DataFrame) -> DataFrame:
    """``id, k1, k2, shingles``: packed sorted hashes of each text and the keys of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets, sizes = shingles(*text_buffers(part.column("text")))
                cuts = np.concatenate([[0], np.cumsum(sizes)])
                packed = [sets[a:b].tobytes() for a, b in zip(cuts.tolist(), cuts[1:].tolist())]
                yield pa.RecordBatch.from_arrays([part.column("id"), *map(pa.array, _set_keys(sets, cuts)), pa.array(packed, pa.binary())], ["id", "k1", "k2", "shingles"])

    return docs.transform(in_batches(run, f"id {docs.schema['id'].dataType.simpleString()}, k1 long, k2 long, shingles binary"))


def _signatures(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


class _Forest:
    """Components of the members of a block, and the links that joined them."""

    def __init__(self, ids: np.ndarray) -> None:
        self.ids, self.of, self.links = ids, np.arange(len(ids)), []

    def join(self, r: int, others: np.ndarray) -> None:
        """Link member ``r`` with ``others``; a link within a component isn't kept."""
        for o in others[np.unique(self.of[others], return_index=True)[1]].tolist():
            if self.of[o] != self.of[r]:
                self.of[self.of == self.of[o]] = self.of[r]
                self.links.append((self.ids[o], self.ids[r]))

    def table(self) -> pa.Table:
        a, b = np.array(self.links, np.int64).reshape(-1, 2).T
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _blocks(rows: DataFrame, key: str, size: int, n_rows: int = 0) -> DataFrame:
    """Add ``part``, ``i`` and ``j``: every two parts of a key's members, of about ``size`` members each, meet in one block."""
    n = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("parts"))
    rows = rows.join(_by_rows(n, n_rows), key).withColumn("part", F.pmod(F.xxhash64("id", F.lit(3)), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).drop("parts", "other")


def _by_sketch(table: pa.Table, percent: int) -> pa.Table:
    """Links that join members of a block (of equal key, i and j) whose sketches allow a link; a table has many blocks."""
    names = ("key", "i", "j", "id", "part", "n")
    order = np.lexsort([table.column(c).to_numpy() for c in reversed(names[:4])])
    key, i, j, ids, part, n = (table.column(c).to_numpy()[order] for c in names)
    sig = _signatures(table.column("sig"))[order]
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
    size = np.diff(np.append(first, len(key)))
    # most blocks have two members
    a = first[size == 2]
    a = a[(i[a] == j[a]) | (part[a] != part[a + 1])]
    a = a[may_link(sig[a], sig[a + 1], n[a], n[a + 1], percent)]
    links = [pa.table({"a": pa.array(ids[a]), "b": pa.array(ids[a + 1])})]
    for lo, hi in zip(first[size > 2].tolist(), (first + size)[size > 2].tolist()):
        forest, s, m, p = _Forest(ids[lo:hi]), sig[lo:hi], n[lo:hi], part[lo:hi]
        for r in range(hi - lo):
            others = np.flatnonzero((forest.of != forest.of[r]) & (True if i[lo] == j[lo] else p != p[r]))
            if len(others):
                forest.join(r, others[may_link(s[others], s[r], m[others], m[r], percent)])
        links.append(forest.table())
    return pa.concat_tables(links)


def _near_first(members: DataFrame, percent: int) -> DataFrame:
    """``id, cluster, n, near`` from rows of (id, cluster, shingles, pivot): whether a set is like its cluster's pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, near = [], []
            for mine, pivot in zip(batch.column("shingles"), batch.column("pivot")):
                a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (mine, pivot))
                common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                n.append(len(a))
                near.append(100 * common >= percent * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("cluster"), pa.array(n, pa.int64()), pa.array(near, pa.bool_())], ["id", "cluster", "n", "near"])

    return members.select("id", "cluster", "shingles", "pivot").transform(in_batches(run, "id long, cluster long, n long, near boolean"))


def _set_blocks(members: DataFrame, rows: int = 0) -> DataFrame:
    """``id, cluster, near, i, j, asks, answers``: blocks in which every member that isn't near its pivot meets all members of its cluster.

    The former are dealt into parts i, all members into parts j, each of at
    most SETS sets and about SET_HASHES hashes.  Clusters whose members are
    all near have no block.  ``rows`` says how many members there are.
    """
    far = ~F.col("near")
    parts = lambda some: F.greatest(F.ceil(F.count_if(some) / SETS), F.ceil(F.sum(F.when(some, F.col("n")).otherwise(0)) / SET_HASHES)).cast("int")
    sizes = members.groupBy("cluster").agg(parts(far).alias("pi"), parts(F.lit(True)).alias("pj")).where("pi > 0")
    m = members.join(_by_rows(sizes, rows), "cluster")
    m = m.withColumn("own_i", F.pmod(F.xxhash64("id", F.lit(4)), F.col("pi")).cast("int")).withColumn("own_j", F.pmod(F.xxhash64("id", F.lit(3)), F.col("pj")).cast("int"))
    block = lambda i, j, asks, answers: F.struct(i.alias("i"), j.alias("j"), asks.alias("asks"), answers.alias("answers"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    answering = F.transform(every("pi"), lambda i: block(i, F.col("own_j"), far & (i == F.col("own_i")), F.lit(True)))
    asking = F.transform(F.filter(every("pj"), lambda j: far & (j != F.col("own_j"))), lambda j: block(F.col("own_i"), j, F.lit(True), F.lit(False)))
    return m.select("id", "cluster", "near", F.explode(F.concat(answering, asking)).alias("b")).select("id", "cluster", "near", "b.*")


def _by_set(table: pa.Table, percent: int) -> pa.Table:
    """Links of the members that ask with those that answer, by their full sets; members near the pivot are linked already."""
    table = table.sort_by("id").combine_chunks()
    ids, near, asks, answers = (table.column(c).to_numpy() for c in ("id", "near", "asks", "answers"))
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
    size = np.array([len(x) for x in sets])
    _, every = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.concatenate([[0], np.cumsum(size)])
    there, forest = np.zeros(every.max(initial=0) + 1, np.uint8), _Forest(ids)
    forest.of[near] = np.argmax(near)
    for r in np.flatnonzero(asks).tolist():
        fits = (100 * np.minimum(size, size[r]) >= percent * np.maximum(size, size[r])) & (forest.of != forest.of[r])
        others = np.flatnonzero(fits & answers)
        if not len(others):
            continue
        mine = every[at[r] : at[r + 1]]
        there[mine] = 1
        if 4 * len(others) < len(ids):
            common = np.array([there[every[at[o] : at[o + 1]]].sum(dtype=np.int64) for o in others])
        else:
            common = np.add.reduceat(there[every], at[:-1], dtype=np.int64)[others]
        there[mine] = 0
        forest.join(r, others[100 * common >= percent * (size[others] + size[r] - common)])
    return forest.table()


def _groups(classes: DataFrame, percent: int, n: int) -> DataFrame:
    """``key, id, k1``, written: classes by the keys that at least two share.

    A key of more than SHARED classes gives way to its pairs with the next
    finer() bands' keys.  At the threshold 15 of 24 bands agree (of 29 at 0.80);
    that so few do that no two of them are that close happens about once in
    ten million.
    """
    rows = classes.select("id", "k1", F.posexplode("bands").alias("p", "key"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    rows = written(rows.join(sizes, "key"), "near-bands", 80 * n)
    few, many = rows.where(F.col("size") <= SHARED).select("key", "id", "k1"), rows.where(F.col("size") > SHARED)
    n_keys = F.size("bands")
    following = F.transform(F.sequence(F.lit(1), F.least(F.lit(finer(percent)), n_keys - 1)), lambda k: F.element_at("bands", ((F.col("p") + k) % n_keys + 1).cast("int")))
    closer = many.join(classes.select("id", "k1", "bands").where(n_keys > 1), ["id", "k1"]).select("id", "k1", "key", F.explode(following).alias("other"))
    closer = closer.select(F.xxhash64(F.least("key", "other"), F.greatest("key", "other")).alias("key"), "id", "k1").distinct()
    sizes = closer.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    groups = written(few.unionByName(closer.join(sizes, "key").select("key", "id", "k1")), "near-groups", 20 * n)
    discard(rows)
    return groups


#: Narrow rows that may be broadcast, about 10 MB in a hash table; more of them are joined by a shuffle.
BROADCAST_IDS = 200_000


def _few(ids: DataFrame) -> DataFrame:
    """Ids for a join with texts, which needn't be shuffled if the ids are few; counted from the written table."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge")


def _by_rows(table: DataFrame, rows: int) -> DataFrame:
    """A side of a join that isn't broadcast if it has many rows: Spark goes by its compressed files, a tenth of the rows in memory."""
    return table if rows <= BROADCAST_IDS else table.hint("merge")


def _components(docs: DataFrame, id_col: str, text_col: str, percent: int) -> tuple[DataFrame, DataFrame]:
    """Two written tables: ``id, n, k1, k2`` for each row, and ``k1, k2, size, component_id`` for each distinct set."""
    docs = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    sketches = written(_sketches(docs, percent), "near-sketches")
    rows = sketches.count()
    base = written(sketches.select("id", "n", "k1", "k2"), "near-keys", rows)
    # smaller sets (of fewer than 6 shingles at 85 %) are only like equal ones, which are one class already
    least = -(-percent // (100 - percent))
    by_set = written(base.where("id is not null and n > 0").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size")), "near-texts", 2 * rows)
    # a row for each set; an id that stands for several sets has several
    own = sketches.where(F.col("n") >= least).join(_by_rows(by_set.select("k1", "k2", F.col("rep").alias("id")), rows), ["id", "k1", "k2"])
    classes = written(own.groupBy("id", "k1", "k2").agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "near-classes", 40 * rows)
    discard(sketches)
    groups = _groups(classes, percent, rows)

    links = "a long, b long"
    # blocks are small: as many meet in a task's table as make up its size
    n_groups = groups.count()
    blocks = _blocks(groups, "key", SKETCHES, n_groups).withColumn("table", F.pmod(F.xxhash64("key", "i", "j"), F.lit(n_groups // SKETCHES + 1)))
    likely = _by_rows(blocks, n_groups).join(classes.select("id", "k1", "n", "sig"), ["id", "k1"]).groupBy("table").applyInArrow(released_group(lambda t: _by_sketch(t, percent)), links)
    likely = components(likely, rows)
    n_likely = likely.count()
    clusters = likely.select(F.col("node").alias("id"), F.col("component").alias("cluster"))
    texts = docs.join(_few(clusters.select("id")), "id", "left_semi")
    sets = written(_sets(texts).join(classes.select("id", "k1", "k2"), ["id", "k1", "k2"]).dropDuplicates(["id", "k1", "k2"]).select("id", "shingles"), "near-sets", 40 * rows)
    pivots = sets.join(_by_rows(clusters.where("id = cluster"), n_likely), "id").groupBy("cluster").agg(F.max("shingles").alias("pivot"))
    # put so that the join shuffles the pivots anew: Spark splits a cluster of very many members only then
    pivots = pivots.select(F.bitwise_not(F.bitwise_not(F.col("cluster"))).alias("of"), "pivot")
    members = written(_near_first(_by_rows(clusters, n_likely).join(sets, "id").join(pivots, F.col("cluster") == F.col("of")), percent), "near-members", 60 * rows)
    near = members.where("near and id <> cluster").select(F.col("id").alias("a"), F.col("cluster").alias("b"))
    far = _set_blocks(members, n_likely).join(_by_rows(sets, n_likely), "id").groupBy("cluster", "i", "j").applyInArrow(released_group(lambda t: _by_set(t, percent)), links)
    # rows of one id with several sets tie their classes together
    keys = F.struct("k1", "k2")
    several = base.where("id is not null and n > 0").groupBy("id").agg(F.min(keys).alias("lo"), F.max(keys).alias("hi")).where("lo <> hi").select("id")
    ids = base.where("n > 0").select("id", "k1", "k2").join(several, "id").join(by_set.select("k1", "k2", "rep"), ["k1", "k2"]).select("id", "rep").distinct()
    same = ids.join(ids.groupBy("id").agg(F.min("rep").alias("b")), "id").where("rep <> b").select(F.col("rep").alias("a"), "b")
    found = components(near.unionByName(far).unionByName(same), rows)

    named = written(by_set.join(_by_rows(found.withColumnRenamed("node", "rep"), found.count()), "rep", "left").select("k1", "k2", "size", F.coalesce("component", "rep").alias("component_id")), "near-named", 4 * rows)
    discard(by_set, classes, groups, likely, sets, members, found)
    return base, named


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``id, n_shingles, component_id, kept`` for each row; a link needs ``percent`` of the shingles of both in common.

    Rows with equal shingle sets and rows linked to each other form a
    component, named by its smallest id.  Texts that are null or have no words
    are linked with nothing.  A null id is linked with nothing, has no
    component and is kept.  Rows that share an id count as one document.
    Further columns are ignored; an empty table gives no rows.  Ids are
    integers.
    """
    return _verdicts(*_components(docs, id_col, text_col, percent), id_col, docs.schema[id_col].dataType)


def _verdicts(base: DataFrame, named: DataFrame, id_col: str, id_type: DataType) -> DataFrame:
    # rows of hot classes and rows without a word don't meet by their key; there are at most 1 / HOT hot classes
    total = named.agg(F.sum("size")).first()[0] or 0
    hot = F.broadcast(named.where(F.col("size") > HOT * total).drop("size"))
    worded = base.where("n > 0").select("id", "n", "k1", "k2")
    out = worded.join(hot, ["k1", "k2"]).unionByName(worded.join(hot, ["k1", "k2"], "left_anti").join(_by_rows(named.where(F.col("size") <= HOT * total).drop("size"), total), ["k1", "k2"], "left"))
    out = out.select("id", "n", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
    out = out.unionByName(base.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").cast(id_type).alias(id_col), F.col("n").alias("n_shingles"), F.col("component_id").cast(id_type).alias("component_id"), F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without those that near_duplicates() doesn't keep, all columns as they are, whatever their names.

    Rows with a null id, and texts that are null or have no word, are linked
    with nothing and stay; rows of one id are one document and stay or go
    together; of equal texts that of the smallest id stays; an empty table
    gives no rows.
    """
    base, named = _components(docs, "doc_id", "text", percent)
    gone = written(_verdicts(base, named, "doc_id", docs.schema["doc_id"].dataType).where(~F.col("kept")).select("doc_id").distinct(), "near-gone", base.count())
    discard(base, named)
    return docs.join(_few(gone), "doc_id", "left_anti").select(*docs.columns)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))


#: All links by the shingles that documents share, then what reaches what.
OP7_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= {SHINGLE} THEN list_transform(range(1, len(ws) - {SHINGLE - 2}), lambda i: hash(array_to_string(ws[i:i + {SHINGLE - 1}], ' '))) WHEN len(ws) > 0 THEN [hash(array_to_string(ws, ' '))] ELSE [] END) AS h
  FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= {PERCENT} * (x.n + y.n - common)),
both_ AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, both_.b FROM r JOIN both_ ON r.b = both_.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
