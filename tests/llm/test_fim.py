"""Fill-in-middle against brute force: the automaton step by step, outputs text by text, giant texts in small chunks."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import fim

LETTERS = ["\n", "<", ">", "P", "S", "M", "a", "é", "中", "<P>", "<M", "S>", "🙂"]


def test_functions_of_chunks_compose():
    rng = random.Random(3)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(0, 12))).encode() for _ in range(800)] + [b"", b"\n" * 70, b"a" * 99]
    data = np.frombuffer(b"".join(texts), np.uint8)
    after, begun = fim.transitions(data, np.cumsum([0, *map(len, texts)]))
    for text, left, lines in zip(texts, after, begun):
        for state in range(fim.STATES):
            at, n = state, 0
            for byte in text:
                n += at < fim.WITHIN
                seen = at % fim.WITHIN
                if seen != fim.FOUND:
                    seen = 1 if byte == ord("<") else 2 if seen == 1 and byte in b"PSM" else fim.FOUND if seen == 2 and byte == ord(">") else 0
                at = fim.WITHIN * (byte != 10) + seen
            assert (left[state], lines[state]) == (at, n)


def plain(doc_id, text, percent=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= percent:
        return (doc_id, len(units), "plain", None, None, text)
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < spm:
        return (doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def made_rows():
    rng = random.Random(11)
    rows = [(i, "".join(rng.choice(LETTERS[:9] if i % 3 else LETTERS) for _ in range(rng.randrange(0, 60)))) for i in range(300)]
    rows += [(i, "".join(rng.choice(["\n", "a", "é", "中"]) for _ in range(400))) for i in range(300, 330)]
    return rows + [(None, "a\nb\nc"), (None, None), (400, None), (401, ""), (402, "x\n" * 30), (402, "x\n" * 30), (402, "other"), (403, "no break"), (404, "\n" * 200), (405, "long " * 3000)]


@pytest.mark.parametrize("giant, chunk", [(1 << 22, 1 << 20), (0, 7), (50, 1), (20, 64)])
def test_outputs(spark, monkeypatch, giant, chunk):
    """Whole texts at once, and dealt out in chunks that cut letters and markers, in blocks of three."""
    monkeypatch.setattr(fim, "BLOCK", 3)
    rows = made_rows()
    if chunk == 1:
        rows = [r for r in rows if len(r[1] or "") < 500]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, form string, id int")
    made = fim.fill_in_middle(df, giant=giant, chunk=chunk).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    got = [tuple(r) for r in made.collect()]
    assert sorted((r[:6] for r in got), key=str) == sorted((plain(*r) for r in rows), key=str)
    assert sorted(r[6] for r in got) == sorted(r[1] or "" for r in rows)


def test_shares_and_no_rows(spark):
    df = spark.createDataFrame([(i, "a\nb\nc\nd") for i in range(500)], "doc_id long, text string")
    for percent, spm in ((60, 10), (0, 50), (100, 0)):
        got = sorted(tuple(r) for r in fim.fill_in_middle(df, percent, spm).collect())
        assert got == sorted(plain(i, "a\nb\nc\nd", percent, spm) for i in range(500))
    assert fim.fill_in_middle(df.limit(0)).count() == 0
