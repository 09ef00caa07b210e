"""BPE encoding and decoding with a contiguous array of ranks per word.

A word is held as one list of parts and one list with the rank of each
adjacent pair.  The smallest rank is looked up by a scan, its boundary is
deleted and the two neighbouring ranks are refreshed.  Words of a corpus are
short, so the scan beats any queue; words of more than ``LONG`` symbols use a
heap over a linked list, which keeps a text without white space at
O(n log n).
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import hexdigest, in_batches, read_table, slices

LONG = 96
#: Words that a task remembers before it starts over; about 80 MB.
CACHED = 200_000

#: No rank: above all ranks.
NONE = np.iinfo(np.int32).max
#: Open addressing for ranks of pairs; a power of two, over twice the merges.
SLOTS = 1 << 18

_RARE = re.compile(r"[\x1c-\x1f\x85²³¹¼½¾ɐ-\U0010ffff]")


def _slot(key: np.ndarray) -> np.ndarray:
    return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(46)).astype(np.int64)


def _byte_alphabet() -> list[str]:
    """The printable stand-in for each byte in byte-level vocabularies: printable Latin-1 stands for itself, others follow from U+0100."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in keep else chr(next(other)) for b in range(256)]


class WordBpe:
    """A tokenizer of the kind "BPE with word ends" as its JSON file describes it.

    Built from the file's text, so that only the driver needs the file.
    Specials are matched in the raw text; what lies between is normalized
    (NFC, white space runs to one blank, lower case), cut by the file's
    pattern and merged within each piece.
    """

    def __init__(self, spec: str) -> None:
        d = json.loads(spec)
        model, steps = d["model"], d["normalizer"]["normalizers"]
        if model["type"] != "BPE" or [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or d["decoder"] is not None or model["unk_token"] is not None:
            raise ValueError("not a word-end BPE file of the supported kind")
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()} | {t["id"]: t["content"] for t in d["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.suffix = model["end_of_word_suffix"] or ""
        self.pattern = regex.compile(d["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        # the same pattern for the standard library, right for Latin texts alone
        self.latin = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
        self.ranks: dict[int, int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.ranks[self.vocab[a] << 32 | self.vocab[b]] = rank
        self.merged = np.array([self.vocab[a + b] for a, b in model["merges"]], np.int32)
        self.slot_keys, self.slot_ranks = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, np.int32)
        keys = np.fromiter(self.ranks, np.int64, len(self.ranks))
        for key, rank, slot in zip(keys.tolist(), self.ranks.values(), _slot(keys).tolist()):
            while self.slot_keys[slot] >= 0:
                slot = slot + 1 & SLOTS - 1
            self.slot_keys[slot], self.slot_ranks[slot] = key, rank
        alphabet = _byte_alphabet()
        self.inner = np.array([self.vocab.get(c, -1) for c in alphabet], np.int32)
        self.final = np.array([self.vocab.get(c + self.suffix, -1) for c in alphabet], np.int32)
        self.cache: dict[str, tuple[str, str]] = {}

    def pieces(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        if _RARE.search(text):
            return self.pattern.findall(" ".join(regex.split(r"[\t-\r \x85\xa0  -     　]+", text)).lower())
        return self.latin.findall(text.lower())

    def symbols(self, word: str) -> list[int]:
        raw = word.encode()
        ids = np.append(self.inner[list(raw[:-1])], self.final[raw[-1]])
        return ids[ids >= 0].tolist()

    def merge(self, word: str) -> tuple[int, ...]:
        """Ids of one piece."""
        ids = self.symbols(word)
        if len(ids) > LONG:
            return tuple(self._merge_long(ids))
        get, merged, none = self.ranks.get, self.merged, len(self.merged)
        ranks = [get(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == none:
                break
            i = ranks.index(low)
            ids[i] = int(merged[low])
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(ids[i] << 32 | ids[i + 1], none)
            if i:
                ranks[i - 1] = get(ids[i - 1] << 32 | ids[i], none)
        return tuple(ids)

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE for a pair that no merge joins or that has a sentinel (-1)."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = _slot(key)
        out = np.full(len(key), NONE, np.int32)
        open_ = np.arange(len(key))
        while len(open_):
            there = self.slot_keys[slot]
            hit = there == key
            out[open_[hit]] = self.slot_ranks[slot[hit]]
            go = ~hit & (there >= 0)
            open_, key, slot = open_[go], key[go], (slot[go] + 1) & SLOTS - 1
        out[(left < 0) | (right < 0)] = NONE
        return out

    def merge_many(self, words: list[str]) -> list[tuple[int, ...]]:
        """merge() of many short words at once: a row of ranks for each word, and each step deletes one boundary in every row that still has a rank."""
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        width = int(size.max(initial=1)) + 2  # a sentinel on either side
        data = np.frombuffer(b"".join(raw), np.uint8)
        end = np.cumsum(size)
        flat = self.inner[data]
        flat[end - 1] = self.final[data[end - 1]]
        row = np.repeat(np.arange(len(raw)), size)
        ids = np.full((len(raw), width), -1, np.int32)
        ids[row, np.arange(len(data)) - np.repeat(end - size, size) + 1] = flat
        ids_, ranks = ids.ravel(), np.full((len(raw), width), NONE, np.int32)
        ranks[:, :-1] = self._lookup(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(raw), width - 1)
        ranks_ = ranks.ravel()
        after = np.arange(1, ids_.size + 1, dtype=np.int32)
        before = np.arange(-1, ids_.size - 1, dtype=np.int32)
        live = np.arange(len(raw))
        while len(live):
            part = ranks[live]
            at = part.argmin(1)
            low = part[np.arange(len(live)), at]
            keep = low < NONE
            live, low = live[keep], low[keep]
            i = live * width + at[keep]
            j = after[i]
            k = after[j]
            ids_[i], ids_[j], ranks_[j] = self.merged[low], -1, NONE
            after[i], before[k] = k, i
            h = before[i]
            found = self._lookup(np.concatenate([ids_[i], ids_[h]]), np.concatenate([ids_[k], ids_[i]]))
            ranks_[i], ranks_[h] = found[: len(i)], found[len(i) :]
        kept = ids >= 0
        cuts = np.concatenate([[0], np.cumsum(kept.sum(1))]).tolist()
        every = ids[kept].tolist()
        return [tuple(every[a:b]) for a, b in zip(cuts, cuts[1:])]

    def _merge_long(self, ids: list[int]) -> list[int]:
        get, n = self.ranks.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        live = [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not live[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], live[j], after[i] = int(self.merged[rank]), False, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := get(ids[i] << 32 | ids[after[i]])) is not None:
                    heapq.heappush(heap, (r, i, ids[i], ids[after[i]]))
            if (p := before[i]) >= 0 and (r := get(ids[p] << 32 | ids[i])) is not None:
                heapq.heappush(heap, (r, p, ids[p], ids[i]))
        return [t for t, on in zip(ids, live) if on]

    def learn(self, words: set[str]) -> None:
        """Put the words that the cache lacks into it."""
        new = [w for w in words if w not in self.cache]
        if len(self.cache) + len(new) > CACHED:
            self.cache.clear()
            new = list(words)
        new.sort(key=len)
        short = [w for w in new if 4 * len(w) <= LONG]
        for lo in range(0, len(short), 8192):
            part = short[lo : lo + 8192]
            self._keep(part, self.merge_many(part))
        rest = new[len(short) :]
        self._keep(rest, map(self.merge, rest))

    def _keep(self, words: list[str], found: Iterable[tuple[int, ...]]) -> None:
        for w, ids in zip(words, found):
            self.cache[w] = (" ".join(map(str, ids)), self.decode(ids))

    def encode_batch(self, texts: list[str]) -> list[tuple[str, str]]:
        """For each text its ids and what they decode to, each id and token parted from the next by one blank."""
        parts = [self.cut.split(t) if self.cut is not None and "<|" in t else [t] for t in texts]
        words = [[[p] if k % 2 else self.pieces(p) for k, p in enumerate(ps)] for ps in parts]
        self.learn(set().union(*[x for ws in words for x in ws[::2]]))
        known = self.cache
        out = []
        for ws in words:
            hits = [known[w] for w in ws[0]]
            for k in range(1, len(ws)):
                hits += [known[w] for w in ws[k]] if k % 2 == 0 else [(str(self.special[ws[k][0]]), ws[k][0])]
            out.append((" ".join([h[0] for h in hits]), " ".join([h[1] for h in hits])))
        return out

    def encode(self, text: str) -> list[int]:
        return list(map(int, self.encode_batch([text])[0][0].split()))

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined with one blank, as the file has no decoder; ids it doesn't have are left out."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids if i in tokens])


def load_spec(path: str) -> str:
    """The tokenizer file's text; read on the driver alone and sent to the executors as a broadcast of fixed size (about 2 MB)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_documents(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Token counts and digests of each row's whole text: ``id_col, n_tokens, ids_sha256, decoded_sha256``, with ``ids=True`` also the ids (array of int).

    Row by row, without a shuffle.  A null or empty text has no tokens (its
    digests are those of the empty string); a null id stays null; repeated
    rows are all returned; further columns are ignored; an empty table gives
    no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task's own, as a worker that goes on to other operators would keep its 50 MB
        bpe = WordBpe(sent.value)
        for batch in batches:
            for part in slices(batch, "text"):
                found = bpe.encode_batch(part.column(1).fill_null("").to_pylist())
                columns = [
                    part.column(0),
                    pa.array([i.count(" ") + 1 if i else 0 for i, _ in found], pa.int64()),
                    pa.array([hexdigest(i.encode()) for i, _ in found], pa.string()),
                    pa.array([hexdigest(d.encode()) for _, d in found], pa.string()),
                ]
                if ids:
                    columns.append(pa.array([list(map(int, i.split())) for i, _ in found], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).transform(in_batches(run, schema)).withColumnRenamed("id", id_col)


def op9_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, encoded and decoded with the 49k word BPE."""
    import public_tokenizers

    return encode_documents(read_table(spark, sf_dir, "documents"), load_spec(public_tokenizers.path("word_bpe_49k.json")))
