"""Token counts by byte-pair merging with a heap over a linked list.

A piece of text is a linked list of byte symbols.  A heap has the rank and the
place of each adjacent pair that a rule merges; the lowest is popped, its right
symbol leaves the list and the pairs with the two neighbours are entered anew.
An entry counts only if the pair at its place still has that rank, so nothing
is ever removed from the heap.  The count of a piece is its number of bytes
less its merges: no identifier of a token is looked up or put out, and a piece
of a million letters costs O(n log n).  Short pieces go through the same steps
side by side: a row of a matrix is the heap of one piece, another its list.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .bpe import load_spec
from .common import in_batches, read_table, slices, text_buffers

LIMIT = 1024
#: Distinct pieces that a task remembers before it starts over; about 30 MB.
CACHED = 200_000
#: Pieces up to this length are merged side by side, so many at a time; longer ones one by one, and aren't remembered.
SHORT_CHARS, SIDE_BY_SIDE = 32, 4096
#: No rank: above all ranks.
NONE = 1 << 40

#: A heap entry is a rank and a place, a pair two symbols.
_PLACE_BITS, _SYMBOL_BITS = 32, 20
_PLACE, _NO_SYMBOL = (1 << _PLACE_BITS) - 1, (1 << _SYMBOL_BITS) - 1

# How the byte-level pre-tokenizer cuts a text into pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same cut by the standard library, right for texts without a character of _RARE.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_LATIN = re.compile(rf" ?[{_LETTER}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\s0-9{_LETTER}]+|\s+(?!\S)|\s+")
_RARE = re.compile(r"[\x1c-\x1f\x85²³¹¼½¾ɐ-\U0010ffff]")


def _stand_ins() -> dict[str, int]:
    """Which byte each printable character of a byte-level vocabulary stands for."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    others = sorted(set(range(256)) - set(plain))
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def _slot(key: np.ndarray, bits: int) -> np.ndarray:
    return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)


class TokenCounter:
    """Counts tokens as the byte-level BPE file in ``spec`` (its JSON text) gives them.

    Strings of its special tokens inside a text count as one token each, which
    is the library's default.
    """

    def __init__(self, spec: str) -> None:
        d = json.loads(spec)
        model, cut = d["model"], d["pre_tokenizer"]
        odd = d["normalizer"] or model.get("unk_token") or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix") or model.get("ignore_merges")
        if model["type"] != "BPE" or cut["type"] != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"] or odd:
            raise ValueError("not a byte-level BPE file of the supported kind")
        byte_of = _stand_ins()
        # symbols are bytes and, after them, what the merges make; a pair has the part of its heap entry that isn't the place
        number = {c: b for c, b in byte_of.items()}
        self.entries: dict[int, int] = {}
        self.made: list[int] = []
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.made.append(number.setdefault(a + b, len(number)))
            self.entries.setdefault(number[a] << _SYMBOL_BITS | number[b], rank << _PLACE_BITS)
        if len(number) > _NO_SYMBOL:
            raise ValueError("too many symbols")
        special = [t["content"] for t in d["added_tokens"]]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in d["added_tokens"]):
            raise ValueError("special tokens that take in their surroundings aren't supported")
        self.special = re.compile("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.pattern = regex.compile(PATTERN)
        self.made_ = np.array(self.made, np.int64)
        self.slot_bits = (2 * len(self.entries) + 1).bit_length()
        self.slot_keys, self.slot_ranks = np.full(1 << self.slot_bits, -1, np.int64), np.full(1 << self.slot_bits, NONE, np.int64)
        keys = np.fromiter(self.entries, np.int64, len(self.entries))
        for key, entry, slot in zip(keys.tolist(), self.entries.values(), _slot(keys, self.slot_bits).tolist()):
            while self.slot_keys[slot] >= 0:
                slot = slot + 1 & len(self.slot_keys) - 1
            self.slot_keys[slot], self.slot_ranks[slot] = key, entry >> _PLACE_BITS
        self.known: dict[str, int] = {}

    def merges(self, data: bytes) -> int:
        """How many merges a piece takes."""
        get, made, n = self.entries.get, self.made, len(data)
        # one more symbol, which no rule knows, stands after the last and, as Python counts places from the end, before the first
        symbol = [*data, _NO_SYMBOL]
        heap = [e | i for i, e in enumerate(map(get, [a << _SYMBOL_BITS | b for a, b in zip(data, data[1:])])) if e is not None]
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        done = 0
        while heap:
            entry = heappop(heap)
            i = entry & _PLACE
            j = after[i]
            if get(symbol[i] << _SYMBOL_BITS | symbol[j]) != entry - i:
                continue
            symbol[i] = whole = made[entry >> _PLACE_BITS]
            symbol[j] = _NO_SYMBOL
            after[i] = k = after[j]
            before[k] = i
            done += 1
            h = before[i]
            if (e := get(symbol[h] << _SYMBOL_BITS | whole)) is not None:
                heappush(heap, e | h)
            if (e := get(whole << _SYMBOL_BITS | symbol[k])) is not None:
                heappush(heap, e | i)
        return done

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols; NONE for a pair that no rule merges."""
        key = left << _SYMBOL_BITS | right
        slot = _slot(key, self.slot_bits)
        there = self.slot_keys[slot]
        out = np.where(there == key, self.slot_ranks[slot], NONE)
        open_ = np.flatnonzero((there != key) & (there >= 0))
        while len(open_):
            slot[open_] = slot[open_] + 1 & len(self.slot_keys) - 1
            there = self.slot_keys[slot[open_]]
            hit = there == key[open_]
            out[open_[hit]] = self.slot_ranks[slot[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return out

    def merges_side_by_side(self, pieces: list[bytes]) -> np.ndarray:
        """merges() of many short pieces: each step pops the lowest entry of every heap that has one."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = int(size.max(initial=0)) + 2  # a symbol that no rule knows on either side
        row = np.repeat(np.arange(len(pieces)), size)
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + 1
        symbol = np.full((len(pieces), width), _NO_SYMBOL, np.int64)
        symbol[row, place] = np.frombuffer(b"".join(pieces), np.uint8)
        found = self._find(symbol[:, :-1].ravel(), symbol[:, 1:].ravel()).reshape(len(pieces), width - 1)
        rank_at = np.full((len(pieces), width), NONE, np.int64)
        rank_at[:, :-1] = found
        bits = width.bit_length()
        # a row in ascending order is a heap; it never has more entries than pairs at first and one more for each merge
        levels = (2 * width).bit_length()
        heap = np.full((len(pieces), 1 << levels), NONE, np.int64)
        heap[:, : width - 1] = np.sort(np.where(found < NONE, found << bits | np.arange(width - 1), NONE), axis=1)
        held = (found < NONE).sum(1)
        after = np.tile(np.arange(1, width + 1), (len(pieces), 1)) + np.arange(len(pieces))[:, None] * width
        symbol, rank_at, after = symbol.ravel(), rank_at.ravel(), after.ravel()
        before = after - 2
        done = np.zeros(len(pieces), np.int64)
        live = np.flatnonzero(held)
        while len(live):
            entry = _pop(heap, held, live, levels)
            i = live * width + (entry & (1 << bits) - 1)
            valid = rank_at[i] == entry >> bits
            rows, i, rank = live[valid], i[valid], entry[valid] >> bits
            j = after[i]
            k, h = after[j], before[i]
            symbol[i], symbol[j], rank_at[j] = self.made_[rank], _NO_SYMBOL, NONE
            after[i], before[k] = k, i
            done[rows] += 1
            ranks = self._find(np.concatenate([symbol[h], symbol[i]]), np.concatenate([symbol[i], symbol[k]]))
            for at, rank in ((h, ranks[: len(i)]), (i, ranks[len(i) :])):
                rank_at[at] = rank
                new = rank < NONE
                _push(heap, held, rows[new], rank[new] << bits | at[new] - rows[new] * width)
            live = live[held[live] > 0]
        return done

    def _learn(self, pieces: set[str]) -> list[str]:
        """Put the pieces that aren't known among the known ones; returns those too long to stay there."""
        known = self.known
        new = pieces.difference(known)
        if len(known) + len(new) > CACHED:
            known.clear()
            new = pieces
        short = sorted([p for p in new if len(p) <= SHORT_CHARS], key=len)
        for lo in range(0, len(short), SIDE_BY_SIDE):
            part = short[lo : lo + SIDE_BY_SIDE]
            data = [p.encode() for p in part]
            known.update(zip(part, (np.fromiter(map(len, data), np.int64, len(data)) - self.merges_side_by_side(data)).tolist()))
        rest = [p for p in new if len(p) > SHORT_CHARS]
        for p in rest:
            data = p.encode()
            known[p] = len(data) - self.merges(data)
        return rest

    def count_all(self, texts: Iterable[str]) -> list[int]:
        """Tokens of each text."""
        cut = [self.special.split(t) if self.special is not None and self.special.search(t) else [t] for t in texts]
        pieces = [[p for part in parts for p in (self.pattern if _RARE.search(part) else _LATIN).findall(part)] for parts in cut]
        passing = self._learn(set().union(*pieces))
        known = self.known
        counts = [sum(map(known.__getitem__, found)) + len(parts) - 1 for found, parts in zip(pieces, cut)]
        for p in passing:
            del known[p]
        return counts


def _pop(heap: np.ndarray, held: np.ndarray, rows: np.ndarray, levels: int) -> np.ndarray:
    """Take the lowest entry of each of these rows' heaps: the last entry fills the hole at the top and sinks."""
    flat, base = heap.ravel(), rows * heap.shape[1]
    low = flat[base]
    held[rows] -= 1
    last = base + held[rows]
    sinking = flat[last]
    flat[last] = NONE
    at = np.zeros(len(rows), np.int64)
    go = np.flatnonzero(last > base)
    for _ in range(levels - 1):
        if not len(go):
            break
        child = 2 * at[go] + 1
        left, right = flat[base[go] + child], flat[base[go] + child + 1]
        child += right < left
        least = np.minimum(left, right)
        down = least < sinking[go]
        go, child = go[down], child[down]
        flat[base[go] + at[go]] = least[down]
        at[go] = child
    stays = last > base
    flat[(base + at)[stays]] = sinking[stays]
    return low


def _push(heap: np.ndarray, held: np.ndarray, rows: np.ndarray, entry: np.ndarray) -> None:
    """Put an entry into each of these rows' heaps: it starts at the end and rises."""
    flat, base = heap.ravel(), rows * heap.shape[1]
    at = held[rows]
    held[rows] += 1
    go = np.flatnonzero(at > 0)
    while len(go):
        above = (at[go] - 1) >> 1
        parent = flat[base[go] + above]
        up = parent > entry[go]
        go, above = go[up], above[up]
        flat[base[go] + at[go]] = parent[up]
        at[go] = above
        go = go[above > 0]
    flat[base + at] = entry


def count_tokens(docs: DataFrame, spec: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How long each row's whole text is: ``id_col, n_bytes, n_tokens, over_limit``.

    ``over_limit`` says whether a text has more than ``limit`` tokens.  Row by
    row, without a shuffle; the file's text goes out as a broadcast of fixed
    size.  A null or empty text has no bytes and no tokens; a null id stays
    null; repeated rows are all returned; further columns, whatever their
    names, are ignored; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(sent.value)  # a task's own, so that the worker keeps nothing of it
        for batch in batches:
            for part in slices(batch, "text"):
                _, at = text_buffers(part.column(1))
                n = np.array(counter.count_all(part.column(1).fill_null("").to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at)), pa.array(n), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return picked.transform(in_batches(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")).withColumnRenamed("id", id_col)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, counted as the 50k byte-level BPE gives its tokens."""
    import public_tokenizers

    return count_tokens(read_table(spark, sf_dir, "documents"), load_spec(public_tokenizers.path("byte_bpe_50k.json")))
