"""Indexes against scans of the same rows."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import intervals, ngrams, search, vectors

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(8)
    words = ["Alpha", "beta", "GAMMA", "délta", "ÉTÉ", "eta.", "x_1", "licence", "License", "中文字", "ab"]
    rows = [(i * 37 - 400, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))) for i in range(600)]
    rows += [(5, "twice alpha"), (5, "twice beta"), (None, "alpha"), (9_000_000_000, "far licence"), (7, None), (8, ""), (10, "K İ Σας")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return rows, df


@pytest.fixture(scope="module", params=[(4096, 4 << 20), (7, 90)])
def index(request, made):
    with pytest.MonkeyPatch.context() as m:
        m.setattr(ngrams, "SEGMENT_DOCS", request.param[0])
        m.setattr(ngrams, "SEGMENT_BYTES", request.param[1])
        yield ngrams.build_index(made[1].repartition(3))


@pytest.mark.parametrize("query", ["alpha", "gamma d", "ÉTÉ", "été", "a", "", "licen", "beta beta beta", "中文", "nowhere", "σας", "eta. x_1"])
def test_substrings_as_by_a_scan(spark, made, index, query):
    rows, df = made
    want = df.where("doc_id is not null").where(F.contains(F.lower("text"), F.lower(F.lit(query)))).collect()
    got = ngrams.containing(index, df, query).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


PATTERNS = ["[Ll]icen[sc]e", "alpha|GAMMA", "Alpha (beta|GAMMA)", "eta[.] x_1", r"eta\. x", "lice?nce", "lic+ence", "be{1}ta", "(Al)?pha", "^Alpha.*beta$", "far|nowhere", r"\d", "délta", r"\Qeta.\E", "(?i)licence", r"\x41lpha"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_expressions_as_by_a_scan(made, index, pattern):
    _, df = made
    want = df.where("doc_id is not null").where(F.regexp_like("text", F.lit(pattern))).collect()
    assert sorted(map(tuple, ngrams.matching(index, df, pattern).collect())) == sorted(map(tuple, want))


def test_needed_grams_are_needed():
    """No text that a made expression matches lacks them."""
    rng = random.Random(2)
    for _ in range(4000):
        pattern = "".join(rng.choice(["a", "b", "c", "abc", "cab", "ba", "[Aa]", "[ab]", ".", "+", "?", "*", "{2}", "{0,2}", r"\.", r"\w", "|", "(b|a)", "(ab)"]) for _ in range(rng.randrange(1, 8)))
        try:
            compiled = re.compile(pattern)
        except re.error:
            continue
        found = ngrams.needed_grams(pattern)
        for _ in range(6):
            text = "".join(rng.choice("abcabcAB. ") for _ in range(12))
            if found is not None and compiled.search(text):
                assert any(g <= ngrams.grams_of(text.lower().encode()) for g in found), (pattern, text)
    assert ngrams.needed_grams("MIT [Ll]icense") == [ngrams.grams_of(b"mit license")]
    assert ngrams.needed_grams("ab|abc") is None and ngrams.needed_grams("abcd|bcde") == [ngrams.grams_of(b"abcd"), ngrams.grams_of(b"bcde")]


def test_lists_are_delta_coded_and_few_are_read(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    index = ngrams.build_index(docs)
    for r in index.where("n > 20").limit(50).collect():
        ids = ngrams.decoded(r["first"], r["postings"])
        assert len(ids) == r["n"] and (np.diff(ids) > 0).all() and len(r["postings"]) < 3 * r["n"]
    (grams,) = ngrams.needed_grams("Licensed under")
    total, read = index.agg(F.sum(F.octet_length("postings")), F.sum(F.when(F.col("gram").isin(list(grams)), F.octet_length("postings")))).first()
    assert 0 < read < total / 100
    assert ngrams.candidates(index, [grams]).count() < docs.count() / 5
    plan = index.where(F.col("gram").isin(sorted(grams)[:3]))._jdf.queryExecution().executedPlan().toString()
    assert "In(gram" in plan


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    index = ngrams.build_index(none)
    assert index.count() == 0 and ngrams.containing(index, none, "abc").count() == 0 and ngrams.matching(index, none, "abc").count() == 0


@pytest.mark.parametrize("size", [4 << 20, 90, 3])
def test_segments_hold_each_trigram_of_each_text(monkeypatch, size):
    """Against a plain loop; numbers are sorted, as np.unique hashes them one by one."""
    rng = random.Random(3)
    texts = [b"", b"a", b"ab", b"abc", b"", b"\xff\x00\xff\x00", b"aaaa"] + [bytes(rng.choice(b"abc\xc3\xa9 ") for _ in range(rng.randrange(0, 40))) for _ in range(500)] + [b"ab", b"c"]
    ids = [rng.choice([-(2**63), 2**63 - 1, 0, 127, 128, 16383, 16384]) if rng.random() < 0.2 else rng.randrange(-300, 300) for _ in texts]
    unique, hashed = np.unique, []
    monkeypatch.setattr(ngrams, "SEGMENT_BYTES", size)
    monkeypatch.setattr(np, "unique", lambda x, **more: (hashed.append(len(x)), unique(x, **more))[1])
    got = ngrams._segment(1, ids, texts).to_pylist()
    monkeypatch.undo()
    want = {}
    for id_, text in zip(ids, texts):
        for gram in ngrams.grams_of(text):
            want.setdefault(gram, set()).add(id_)
    assert {r["gram"]: ngrams.decoded(r["first"], r["postings"]).tolist() for r in got} == {g: sorted(i) for g, i in want.items()}
    assert [r["gram"] for r in got] == sorted(want) and all(r["n"] == len(want[r["gram"]]) for r in got)
    assert max(hashed) == len(texts)


@pytest.mark.parametrize("looked_up, broadcast", [(10_000, 200_000), (100, 200_000), (100, 100)])
def test_many_candidates_are_found_once(spark, monkeypatch, looked_up, broadcast):
    """Thousands of numbers aren't put in one call each, and a join doesn't meet the lists a second time."""
    column, given = type(F.lit(1)), []
    isin = column.isin
    monkeypatch.setattr(ngrams, "LOOKED_UP", looked_up)
    monkeypatch.setattr(ngrams, "BROADCAST_IDS", broadcast)
    monkeypatch.setattr(column, "isin", lambda self, *cols: (given.append(len(cols[0])), isin(self, *cols))[1])
    docs = spark.range(-1500, 1500).selectExpr("IF(id = 0, -9223372036854775808, id) AS `an id.x`", "IF(id % 3 = 0, 'nothing', 'A needle') AS text")
    docs = docs.select(F.struct("`an id.x`").alias("key"), "text", "`an id.x`")
    for id_col in ("`an id.x`", "key.`an id.x`"):
        index = ngrams.build_index(docs, id_col)
        got = ngrams.containing(index, docs, "a NEEDLE", id_col)
        assert got.count() == 2000 and got.where("text <> 'A needle'").count() == 0
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroupsInArrow" not in plan and ("Join" in plan) == (looked_up < 2000) and ("SortMergeJoin" in plan) == (broadcast < 2000)
        assert ngrams.containing(index, docs, "nothing", id_col).where(F.col(id_col) == -(2**63)).count() == 1
    plain = docs.select(F.col("`an id.x`").alias("an id"), "text")
    assert ngrams.containing(ngrams.build_index(plain, "an id"), plain, "needle", "an id").count() == 2000
    assert max(given) <= 6


def made_spans(rng, n):
    return [(rng.choice("abc"), lo := rng.randrange(-40, 60), lo + rng.choice([-1, 0, 1, 2, 3, 8, 40]), i) for i in range(n)] + [(None, 0, 9, 900), ("a", None, 5, 901), ("a", 5, None, 902), ("a", -(2**40), 2**40, 903), ("a", 3, 3, 904), ("a", 3, 3, 904)]


def test_cells_cover_a_span_once(spark):
    rng = random.Random(1)
    rows = [(lo, lo + n) for lo, n in [(rng.randrange(-500, 500), rng.randrange(0, 300)) for _ in range(300)]] + [(0, 0), (-1, -1), (-8, 7), (0, 1023), (5, 4)]
    got = spark.createDataFrame(rows, "lo long, hi long").select("lo", "hi", intervals.cells(F.col("lo"), F.col("hi")).alias("c")).collect()
    for r in got:
        numbers = [x for c in r["c"] for x in range(c["cell"] << c["size"], c["cell"] + 1 << c["size"])]
        assert sorted(numbers) == list(range(r["lo"], r["hi"] + 1))
        assert all([c["size"] for c in r["c"]].count(c["size"]) <= 2 for c in r["c"])


def test_points_meet_the_spans_that_contain_them(spark):
    rng = random.Random(3)
    spans, points = made_spans(rng, 200), [(rng.choice("abcd"), rng.randrange(-50, 120), i) for i in range(150)] + [("a", None, 500), (None, 4, 501), ("a", 3, 502), ("a", 3, 502)]
    s, p = spark.createDataFrame(spans, "k string, lo long, hi long, id int"), spark.createDataFrame(points, "k string, at long, no int")
    inside = [(q, x) for q in points for x in spans if None not in (q[0], q[1], x[0], x[1], x[2]) and q[0] == x[0] and x[1] <= q[1] <= x[2]]
    got = intervals.spans_of_points(p, s, ["k"], "at", "lo", "hi")
    assert sorted((r["no"], r["id"]) for r in got.collect()) == sorted((q[2], x[3]) for q, x in inside)
    some = intervals.aggregated_over_spans(p, s, ["k"], "at", "lo", "hi", {"n": F.count(F.lit(1)), "least": F.min("id")}, {"n": F.sum, "least": F.min}).collect()
    want = {}
    for k, at in {q[:2] for q, _ in inside}:
        want[k, at] = [x[3] for x in spans if x[0] == k and None not in x[:3] and x[1] <= at <= x[2]]
    assert {(r["k"], r["at"]): (r["n"], r["least"]) for r in some} == {k: (len(v), min(v)) for k, v in want.items()}
    assert intervals.spans_of_points(p, s.limit(0), ["k"], "at", "lo", "hi").count() == 0


def test_no_row_is_made_outside_a_span(spark):
    """A thousand spans of one file that a line isn't in give it no row, nested ones that it is in no more than there are sizes."""
    spans = spark.range(1000).selectExpr("'f' AS path", "id * 10 AS lo", "id * 10 + 4 AS hi", "id")
    hits = spark.createDataFrame([("f", 5), ("f", 13)], "path string, line long")
    assert intervals.spans_of_points(hits, spans, ["path"], "line", "lo", "hi").collect()[0]["id"] == 1
    nested = spark.range(1000).selectExpr("concat('n', id) AS id", "'t' AS title", "'f' AS path", "1 AS line_start", "id + 20 AS line_end")
    placed = intervals._placed(hits.withColumnRenamed("line", "at"), "at", intervals._cut(nested, "line_start", "line_end"))
    assert placed.count() <= 2 * 11
    assert {r["line"]: r["id"] for r in search.best_nodes_for_lines(hits, nested).collect()} == {5: "n0", 13: "n0"}


def test_best_nodes_for_lines(spark):
    nodes = [("a", "t", "f", 1, 10), ("b", "s", "f", 3, 5), ("c", "s", "f", 3, 5), ("d", "z", "f", None, None), ("e", "q", "g", None, None), ("h", "r", "h", 5, 3), ("i", "r", None, 1, 3)]
    hits = [("f", 4), ("f", 4), ("f", 9), ("f", 99), ("g", 1), ("h", 4), ("none", 1)]
    got = search.best_nodes_for_lines(spark.createDataFrame(hits, "path string, line long"), spark.createDataFrame(nodes, "id string, title string, path string, line_start long, line_end long"))
    assert {(r["path"], r["line"]): r["id"] for r in got.collect()} == {("f", 4): "b", ("f", 9): "a", ("f", 99): "b", ("g", 1): "e", ("h", 4): "h", ("none", 1): None}


def all_pairs(rows, k=None, least=None):
    """Answers for the rows whose id is divisible by 10, one pair after the other."""
    x = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and len(v) == 8 and not any(e is None or e != e for e in v)}
    score = lambda a, b: 0.0 if not a.any() or not b.any() else round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 9)
    out = {}
    for q in [i for i in x if i % 10 == 0]:
        found = sorted((-score(x[q], v), i) for i, v in x.items() if i != q)
        out[q] = [(i, -s + 0.0) for s, i in found if least is None or -s >= least][:k]
    return out


def vector_rows(clustered):
    rng = np.random.default_rng(6)
    centres = 5 * rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] * clustered + rng.normal(size=8)).tolist()) for i in range(700)]
    rows += [(i, centres[0].tolist()) for i in range(1000, 1150)]  # equal vectors
    return rows + [(2000, [0.0] * 8), (2001, [0.0] * 8), (2010, None), (None, [1.0] * 8), (2020, [1.0] * 7), (2030, [float("nan")] * 8), (2040, [1.0, None] * 4)]


@pytest.mark.parametrize("clustered", [0, 1])
def test_nearest_vectors_are_those_of_all_pairs(spark, monkeypatch, clustered):
    """One index, read by two searches; on clusters most pairs are ruled out."""
    monkeypatch.setattr(vectors, "BLOCK", 16)
    monkeypatch.setattr(vectors, "QUERIES", 8)
    rows = vector_rows(clustered)
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, cell string")
    index, queries = vectors.VectorIndex(df), df.where("vec_id % 10 = 0")
    found, compared = index.nearest(queries, 7)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    want = all_pairs(rows, k=7)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]] and [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=2e-9)
    near, met = index.within(queries, 0.8)
    assert sorted((r["query_id"], r["id"]) for r in near.collect()) == sorted((q, i) for q, v in all_pairs(rows, least=0.8).items() for i, _ in v)
    if clustered:
        assert index.share_compared(met, len(want)) < 0.4 and index.share_compared(compared, len(want)) < 0.5


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    index = vectors.VectorIndex(none)
    assert index.nearest(none, 3)[0].count() == 0 and index.within(none, 0.5)[0].count() == 0


def test_points_are_not_broadcast(spark):
    points, spans = spark.range(9).select(F.lit(1).alias("k"), F.col("id").alias("x")), spark.range(9).select(F.lit(1).alias("k"), F.col("id").alias("lo"), (F.col("id") + 3).alias("hi"))
    found = intervals.spans_of_points(points, spans, ["k"], "x", "lo", "hi")
    summed = intervals.aggregated_over_spans(points, spans, ["k"], "x", "lo", "hi", {"n": F.count(F.lit(1))}, {"n": F.sum})
    assert sorted((r["x"], r["n"]) for r in summed.collect()) == [(x, min(x, 3) + 1) for x in range(9)]
    for df in (found, summed):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
