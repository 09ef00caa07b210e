"""Token counts against the tokenizers library and against merging one pair at a time."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillgraph.llm import tokencount
from quillgraph.llm.bpe import load_spec

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
LETTERS = "ab eE'stlmdvr  \t\n\x0b\x1c\x85\xa0 　​012²¼½٣Ⅷ_-!?éßµªñ́中文🙂﻿\0"


@pytest.fixture(scope="module")
def counter():
    return tokencount.TokenCounter(load_spec(PATH))


def counted(texts):
    library = Tokenizer.from_file(PATH)
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def odd_texts():
    rng = random.Random(12)
    made = ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    special = ["<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>c", "<|endoftext", "'S 's'll 'LL we've"]
    return [*made, *special, "", "x" * 5000, "ab" * 3000, " " * 70000, "qwertyuiop" * 20000, *(f"{chr(c)} a{chr(c)}{chr(c)}1" for c in range(0x800))]


def test_counts_are_the_librarys(counter):
    texts = odd_texts()
    assert counter.count_all(texts) == counted(texts)


def test_side_by_side_and_one_by_one(counter):
    """Both forms against merging the lowest pair again and again."""
    pair_rank = {key: entry >> 32 for key, entry in counter.entries.items()}

    def plain(data):
        symbols, merges = list(data), 0
        while True:
            ranked = [(pair_rank[a << 20 | b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a << 20 | b in pair_rank]
            if not ranked:
                return merges
            rank, i = min(ranked)
            symbols[i : i + 2] = [counter.made[rank]]
            merges += 1

    rng = random.Random(5)
    pieces = [bytes(rng.choice(b"aeinrst hou\xc3\xa9") for _ in range(rng.randrange(0, 40))) for _ in range(1500)]
    want = [plain(p) for p in pieces]
    assert [counter.merges(p) for p in pieces] == want
    assert counter.merges_side_by_side(pieces).tolist() == want


def test_query(spark):
    rows = tokencount.op12_token_counts(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    texts = [d["text"] or "" for d in docs]
    want = sorted((d["doc_id"], len(t.encode()), n, n > 1024) for d, t, n in zip(docs, texts, counted(texts)))
    assert sorted(map(tuple, rows)) == want and any(r["over_limit"] for r in rows)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(tokencount, "CACHED", 3)  # forgets all the time
    rows = [(1, "one two three", "x", "y"), (1, "one two three", "x", "y"), (None, "é", None, None), (2, None, None, None), (3, "", "x", "y"), (4, "word " * 1024, "", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, n_tokens string")
    got = sorted(map(tuple, tokencount.count_tokens(df, load_spec(PATH)).collect()), key=str)
    assert got == sorted([(1, 13, 3, False), (1, 13, 3, False), (None, 2, 1, False), (2, 0, 0, False), (3, 0, 0, False), (4, 5120, 1025, True)], key=str)
    assert tokencount.count_tokens(df.limit(0), load_spec(PATH)).count() == 0
    assert [r["over_limit"] for r in tokencount.count_tokens(df.where("doc_id = 1"), load_spec(PATH), limit=2).collect()] == [True, True]
