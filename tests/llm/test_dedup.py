"""Near-duplicates and repeated substrings against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import neardup, substrings
from quillgraph.llm.suffix import common_prefixes, suffix_array, words_at

SF = "/root/testdata/sf0.001"


def plain_components(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    having = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            having[x].append(i)
    for i, s in sets.items():
        common = defaultdict(int)
        for x in s:
            for j in having[x]:
                if j > i:
                    common[j] += 1
        for j, n in common.items():
            if 100 * n >= 85 * (len(s) + len(sets[j]) - n):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), top(i)) for i in sets}


def hard_rows():
    """A base whose copies are near to it but not to each other, texts that share a passage, short and odd texts."""
    rng = random.Random(3)
    base = [rng.choice("abcdefgh") + str(rng.randrange(1000)) for _ in range(120)]
    passage = "Common passage of words here that stands everywhere "
    rows = []
    for k in range(300):
        w = list(base)
        if k != 170:
            for _ in range(rng.choice([1, 1, 2, 2, 3])):
                w[rng.randrange(120)] = f"z{rng.random()}"
        rows.append((k, passage + " ".join(w)))
    rows += [(1000 + k, passage + "in all of the documents of this test " + " ".join(f"q{rng.randrange(400)}" for _ in range(rng.randrange(40)))) for k in range(200)]
    return rows + [(3000, ""), (3001, None), (3002, "A b"), (3003, "a B"), (3004, "a b c d e f"), (3005, "A b\nc d e f"), (3006, "x")]


def check(df, rows):
    got = neardup.near_duplicates(df).collect()
    want = plain_components(rows)
    assert len(got) == df.count()
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_near_duplicates_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check(docs, [(r["doc_id"], r["text"]) for r in docs.collect()])


@pytest.mark.parametrize("limits", [(4096, 8192, 1024), (20, 64, 40)])
def test_near_duplicates_of_hard_rows(spark, monkeypatch, limits):
    for name, value in zip(("SHARED", "SKETCHES", "SETS"), limits):
        monkeypatch.setattr(neardup, name, value)
    rows = hard_rows()
    df = spark.createDataFrame([*rows, (None, "a b c d e f"), rows[0]], "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("id", "n", "component", "key")})
    check(df, rows)
    kept = neardup.one_of_each(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {c for _, c in plain_components(rows).values()} | {None}


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_estimate_is_close():
    rng = np.random.default_rng(1)
    off = []
    for _ in range(40):
        pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
        a, b = np.unique(pool[:2400]), np.unique(pool[400:])
        r = neardup.sketch(np.concatenate([a, b]), np.array([len(a), len(b)]))
        found, _ = neardup.estimate(r[0], r[1], len(a), len(b))
        off.append(found - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert abs(np.mean(off)) < 0.04


@pytest.mark.parametrize("n", [0, 1, 2, 5, 50, 3000])
@pytest.mark.parametrize("letters", [1, 2, 3, 200])
def test_suffix_array(n, letters):
    text = np.random.default_rng(n + letters).integers(0, letters, n).astype(np.uint8)
    order, raw = suffix_array(text, 50), text.tobytes()
    assert sorted(order.tolist()) == list(range(n))
    keys = [raw[i : i + 50].ljust(50, b"\0") for i in order]
    assert keys == sorted(keys)
    lengths = common_prefixes(words_at(text), order, 50)
    for k in range(1, min(n, 200)):
        want = next((c for c in range(50) if keys[k - 1][c] != keys[k][c]), 50)
        assert lengths[k] == want


def plain_cut(rows):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49) if i is not None else ():
            w = b[p : p + 50]
            first[w] = min(i, first.get(w, i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49) if i is not None else ():
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        spans = sum(gone[k] and (k == 0 or not gone[k - 1]) for k in range(len(gone)))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def passages():
    rng = random.Random(5)
    common = "the common passage that stands in all the documents of this small test, word by word. " * 2
    piece = lambda: rng.choice([common[rng.randrange(30) : rng.randrange(60, 170)], "ab" * rng.randrange(60), "z" * rng.randrange(80), "éö" * 20, "".join(rng.choice("abc ") for _ in range(30))])
    return [(rng.randrange(60), "".join(piece() for _ in range(rng.randrange(8)))) for _ in range(150)] + [(None, common), (3, None), (4, ""), (5, common), (5, common)]


@pytest.mark.parametrize("limits", [(4096, 4 << 20, 2 << 20), (3, 2000, 1500)])
def test_repeats_are_removed(spark, monkeypatch, limits):
    for name, value in zip(("SHARED", "CHUNK", "SORTED"), limits):
        monkeypatch.setattr(substrings, name, value)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    for rows in (passages(), [(r["doc_id"], r["text"]) for r in docs.collect()]):
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("id", "chunk", "kept", "n_removed")})
        got = substrings.remove_repeats(df).collect()
        key = lambda r: tuple(map(str, r))
        assert sorted(map(tuple, got), key=key) == sorted(plain_cut(rows), key=key)
        cut = substrings.cut_documents(df)
        assert cut.columns == df.columns
        assert cut.count() == sum(n == 0 or gone < n for _, n, gone, _, _ in plain_cut(rows))


def test_nothing_to_remove(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.remove_repeats(none).count() == 0 and substrings.cut_documents(none).count() == 0


def test_an_id_with_several_texts_is_one_document(spark):
    a, b = ("%s %s" % (p, " ".join(f"{p}{k}" for k in range(60))) for p in "ab")
    rows = [(9, a), (9, b), (4, a + " x"), (7, b + " y"), (7, b + " y"), (8, "other words of another kind here")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(4, 4), (7, 4), (7, 4), (8, 8), (9, 4), (9, 4)]


def test_links_from_80_percent_on(spark):
    """Pairs of 0.80 to 0.85, and some just under 0.80, of 4 to 200 shingles."""
    rows, gone = [], set()
    for size in (4, 5, 8, 9, 12, 13, 14, 17, 19, 20, 25, 36, 41, 42, 60, 100, 200):
        for k in range(20):
            w = [f"w{size}_{k}_{i}" for i in range(size + 4)]
            # size of size + more shingles are common
            more = [m for m in range(1, size) if size >= 0.8 * (size + m)][-1] + (k % 4 == 3)
            i = len(rows)
            rows += [(i, " ".join(w)), (i + 1, " ".join(w + [f"x{i}_{m}" for m in range(more)]))]
            if 100 * size >= 80 * (size + more):
                assert size < 8 or 100 * size < 85 * (size + more)
                gone.add(i + 1)
    # one changed word of 50: 41 of 51 shingles
    w = [f"v{i}" for i in range(50)]
    rows += [(9000, " ".join(w)), (9001, " ".join(w[:25] + ["changed"] + w[26:]))]
    gone.add(9001)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.one_of_each(df, 80)
    assert {r["doc_id"] for r in got.collect()} == {i for i, _ in rows} - gone


@pytest.mark.parametrize("meet", [1, 2])
def test_repeats_are_removed_in_two_steps(spark, monkeypatch, meet):
    """Many small chunks, dealt into parts of which a bucket sees one row each; with strings that very many documents share."""
    for name, value in (("MEET", meet), ("CHUNK", 1500), ("SHARED", 3)):
        monkeypatch.setattr(substrings, name, value)
    rows = passages()
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(plain_cut(rows), key=key)


def test_a_text_of_ten_thousand_copies(spark, monkeypatch):
    """Exact copies, near copies and their common passage, in parts of chunks and over blocks of sets."""
    monkeypatch.setattr(substrings, "MEET", 2)
    monkeypatch.setattr(substrings, "CHUNK", 200_000)
    monkeypatch.setattr(neardup, "SETS", 500)
    base = [f"w{k}" for k in range(40)]
    near, far = " ".join(base[:39]), " ".join(base[:20])
    ids = spark.range(10_000)
    docs = ids.selectExpr("id AS doc_id", f"'{' '.join(base)}' AS text")
    docs = docs.unionByName(ids.limit(2000).selectExpr("10000 + id AS doc_id", f"concat('{near} x', id) AS text")).unionByName(ids.limit(50).selectExpr("20000 + id AS doc_id", f"concat('{far} y', id, ' z', id) AS text"))
    found = neardup.near_duplicates(docs).groupBy("component_id").count().collect()
    assert {r["component_id"]: r["count"] for r in found} == {0: 12_000} | {20_000 + k: 1 for k in range(50)}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(map(tuple, substrings.remove_repeats(docs).collect())) == sorted(plain_cut(rows))


def test_chance_of_a_missed_estimate():
    """The least number of equal registers is the exact binomial tail."""
    from math import comb

    for percent, n in ((85, 72), (80, 87)):
        least, p = neardup.least_equal(percent, n), percent / 100
        for used in range(n + 1):
            below = lambda k: sum(comb(used, i) * p**i * (1 - p) ** (used - i) for i in range(k))  # noqa: B023,E731
            assert below(least[used]) < neardup.MISS and (least[used] == used or below(least[used] + 1) >= neardup.MISS)


def test_members_far_from_the_first_document_are_compared(spark, monkeypatch):
    """A chain of texts, each like the next but not like the first, in small parts."""
    monkeypatch.setattr(neardup, "SETS", 3)
    w = [f"c{k}" for k in range(260)]
    rows = [(k, " ".join(w[4 * k : 4 * k + 100])) for k in range(40)] + [(100 + k, " ".join(f"{a}q" for a in w[4 * k : 4 * k + 100])) for k in range(40)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


@pytest.mark.parametrize(("percent", "common", "more"), [(85, 85, 15), (80, 80, 20)])
def test_no_pair_at_the_threshold_is_missed(spark, percent, common, more):
    """1500 pairs that have just as many shingles in common as a link needs, all of them linked."""
    w = "transform(sequence(0, {}), i -> concat('w', id, '_', i))"
    ids = spark.range(1500)
    one = ids.selectExpr("2 * id AS doc_id", f"concat_ws(' ', {w.format(common + 3)}) AS text")
    two = ids.selectExpr("2 * id + 1 AS doc_id", f"concat_ws(' ', concat({w.format(common + 3)}, transform(sequence(1, {more}), i -> concat('x', id, '_', i)))) AS text")
    found = neardup.near_duplicates(one.unionByName(two), percent=percent)
    assert found.where("component_id = 2 * (doc_id div 2)").count() == 3000
    # a shingle less in common is too few
    apart = ids.selectExpr("2 * id + 1 AS doc_id", f"concat_ws(' ', concat({w.format(common + 3)}, transform(sequence(1, {more + 1}), i -> concat('x', id, '_', i)))) AS text")
    assert neardup.near_duplicates(one.unionByName(apart), percent=percent).where("kept").count() == 3000


def test_many_ids_are_not_broadcast(spark, monkeypatch):
    docs = spark.range(10).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"))
    plan = lambda ids: docs.join(neardup._few(ids), docs["doc_id"] == ids["id"], "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(spark.range(5)) and "BroadcastHashJoin" not in plan(spark.range(300_000))
    # all joins by shuffle give the same rows
    words = " ".join(f"w{k}" for k in range(60))
    texts = [(k, f"{words} x{k // 3}" if k % 3 else f"{words} {words[::-1]} {k}") for k in range(24)] + [(30, None), (31, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    want = sorted(map(tuple, neardup.near_duplicates(docs).collect()), key=str)
    monkeypatch.setattr(neardup, "BROADCAST_IDS", -1)
    assert sorted(map(tuple, neardup.near_duplicates(docs).collect()), key=str) == want
    assert len({r[2] for r in want}) < len(want)
