"""Operators on small cases."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgraph.functions import ranking, text
from quillgraph.operators import bench, checks, components, context, enrich, graph, identity, links, registry, search


def one(spark, column, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (text.slugify, "Hello, World! é", "hello-world"),
        (text.run_slug, "a b_c-d", "a-b_c-d"),
        (text.run_slug, "!!", "run"),
        (text.letters_key, "A-b C", "abc"),
        (text.doi_identity, " https://doi.org/10.1/AbC/ ", "10.1/abc"),
        (text.doi_link, "doi:10.5/X.", "10.5/x"),
        (text.doi_link, "11.5/X", None),
        (text.doi_in_text, "see 10.1234/abc.d, and", "10.1234/abc.d"),
        (text.arxiv_identity, "arXiv:2401.12345v2", "2401.12345"),
        (text.arxiv_identity, "arXiv:hep-th/9901001v2", "hep-th/9901001"),
        (text.arxiv_link, "https://arxiv.org/pdf/2401.12345v2.pdf", "2401.12345v2"),
        (text.arxiv_link, "hep.th", None),
        (text.author_key, "Doe, Jane", "jane doe"),
        (text.squeeze, " a \n b ", "a b"),
        (text.remote_repo, "git@github.com:me/it.git", "me/it"),
        (text.remote_repo, "https://example.org/me/it", None),
        (text.plain_answer, "<think>x</think>```sh\nmake all\n```", "make all"),
        (text.encode_segment, "a b/c", "a%20b%2Fc"),
        (text.json_object, 'noise {"a": 1} noise', '{"a": 1}'),
        (text.reference_kind, "paper:x", "paper"),
        (text.reference_kind, "x", "raw"),
        (text.slugify, None, None),
    ],
)
def test_scalars(spark, f, value, want):
    assert one(spark, f("c"), value) == want


def test_lists_and_maps(spark):
    assert one(spark, text.split_authors("c"), "A and B and ") == ["A", "B"]
    assert one(spark, text.inline_list("c"), '[a, "b", ]') == ["a", "b"]
    assert one(spark, text.task_terms("c"), "Fix THE bug in it") == ["bug", "fix", "the"]
    assert one(spark, text.string_map("c"), '{"a": 1, "b": null, "c": {"d": 2}}') == {"a": "1", "b": "", "c": '{"d":2}'}
    assert one(spark, text.looks_like_path("c"), "a/b") and not one(spark, text.looks_like_path("c"), "abc")
    assert one(spark, text.looks_like_symbol("c"), "pkg.mod") and not one(spark, text.looks_like_symbol("c"), "two words")
    assert one(spark, text.line_count("c"), "a\nb\n") == 2


def test_cosine(spark):
    row = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [])], "a array<double>, b array<double>, e array<double>")
    r = row.select(text.cosine("a", "b").alias("x"), text.cosine("e", "e").alias("z")).first()
    assert r["x"] == pytest.approx(0.70710678) and r["z"] == 0.0


def test_source_type_and_authority(spark):
    assert one(spark, ranking.source_type("c"), "x/.agents/memory/state/A.md") == "canonical_memory"
    assert one(spark, ranking.source_type("c"), "sub/AGENTS.md") == "agent_guidance"
    assert one(spark, ranking.source_type("c"), "docs/a.md") == "docs"
    tiers = {"*.md": 1.2, "docs/*": 1.6}
    assert one(spark, ranking.authority("c", tiers), "repo/docs/a.md") == 1.6
    assert one(spark, ranking.authority("c", tiers), "a.txt") == 1.0
    assert one(spark, ranking.freshness(F.col("c")), 30.0, "double") == 0.5
    assert one(spark, ranking.freshness(F.col("c")), 3000.0, "double") == 0.1
    assert one(spark, ranking.freshness(F.col("c")), None, "double") == 1.0


def test_components_match_union_find(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: top(x) for a, b in pairs if a != b for x in (a, b)}


def test_topic_pairs_lose_nothing_to_the_prefix(spark):
    rng = random.Random(2)
    docs = {i: {f"tok{rng.randrange(60)}" for _ in range(rng.randrange(12))} for i in range(80)}
    df = {}
    for s in docs.values():
        for t in s:
            df[t] = df.get(t, 0) + 1
    kept = {i: {t for t in s if 2 * df[t] <= sum(map(bool, docs.values()))} for i, s in docs.items()}
    weight = lambda s: sum(1 / df[t] for t in s)
    want = {(a, b) for a in docs for b in docs if a < b and len(kept[a] & kept[b]) >= 2 and round(weight(kept[a] & kept[b]) / weight(kept[a] | kept[b]), 6) >= 0.18}
    tokens = spark.createDataFrame([(i, t) for i, s in docs.items() for t in s], "id long, token string")
    assert {(r["source"], r["target"]) for r in enrich.topic_pairs(tokens).collect()} == want


def test_topics_by_blocks_and_components(spark, monkeypatch):
    """A family of near copies, copies and strangers, in small blocks; links are chosen component by component, not in rounds."""
    monkeypatch.setattr(enrich, "BLOCK_DOCS", 3)
    monkeypatch.setattr(enrich, "GROUP_PAIRS", 10)
    monkeypatch.setattr(enrich, "FEW_LINKS", 5)
    docs = {i: {"core", "family", "shared", f"own{i // 2}"} for i in range(40)} | {100 + i: {f"x{i % 7}", f"y{i % 5}", f"z{i}"} for i in range(60)} | {500: {"lone"}}
    df = {}
    for s in docs.values():
        for t in s:
            df[t] = df.get(t, 0) + 1
    kept = {i: {t for t in s if 2 * df[t] <= len(docs)} for i, s in docs.items()}
    weight = lambda s: sum(1 / df[t] for t in s)
    score = lambda a, b: round(weight(kept[a] & kept[b]) / weight(kept[a] | kept[b]), 6)
    want = {(a, b): (score(a, b), len(kept[a] & kept[b]), ",".join(sorted(kept[a] & kept[b], key=lambda t: (df[t], t))[:5])) for a in docs for b in docs if a < b and len(kept[a] & kept[b]) >= 2 and score(a, b) >= 0.18}
    tokens = spark.createDataFrame([(i, t) for i, s in docs.items() for t in s], "id long, token string")
    assert {(r["source"], r["target"]): (r["score"], r["shared"], r["evidence"]) for r in enrich.topic_pairs(tokens).collect()} == want
    used, chosen = {}, {}
    for (a, b), found in sorted(want.items(), key=lambda x: (-x[1][0], str(x[0][0]), str(x[0][1]))):
        if used.get(a, 0) < 3 and used.get(b, 0) < 3:
            chosen[a, b] = found
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
    assert {(r["source"], r["target"]): (r["score"], r["shared"], r["evidence"]) for r in enrich.topic_links(tokens).collect()} == chosen


def test_links_of_copies_are_chosen_without_all_their_pairs(spark, monkeypatch):
    """Copies of two texts that are near to each other: 180,000 pairs, of which the choice looks at few."""
    written, seen = enrich.written, {}

    def counted(df, name, *rows):
        out = written(df, name, *rows)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(enrich, "written", counted)
    docs = {i: {"core", "both", "left" if i % 2 else "right"} for i in range(95, 698)} | {1000 + i: {f"own{i}"} for i in range(700)}
    tokens = spark.createDataFrame([(i, t) for i, s in docs.items() for t in s], "id long, token string")
    # classes overlap by two tokens of 603 and differ by one of 302 and one of 301
    near = round((2 / 603) / (2 / 603 + 1 / 302 + 1 / 301), 6)
    pairs = [(1.0 if (b - a) % 2 == 0 else near, a, b) for a in range(95, 698) for b in range(a + 1, 698)]
    used, want = {}, {}
    for score, a, b in sorted(pairs, key=lambda p: (-p[0], str(p[1]), str(p[2]))):
        if used.get(a, 0) < 3 and used.get(b, 0) < 3:
            want[a, b] = score
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
    assert {(r["source"], r["target"]): r["score"] for r in enrich.topic_links(tokens).collect()} == want
    assert near in want.values() and seen["links"] <= 9 and max(seen.values()) < 5000


def test_no_links_where_no_token_is_shared(spark):
    assert enrich.topic_links(spark.createDataFrame([(1, "alpha"), (2, "beta"), (2, "gamma")], "id long, token string")).collect() == []


def test_links_of_equal_score_among_tied_classes():
    rng = random.Random(7)
    for _ in range(200):
        of = {x: rng.randrange(5) for x in rng.sample(range(130), rng.randrange(1, 40))}
        tied = [(a, b) for a in range(5) for b in range(a + 1, 5) if rng.random() < 0.3]
        used, want = {}, []
        for a, b in sorted(((a, b) for a in of for b in of if a < b and (of[a] == of[b] or tuple(sorted((of[a], of[b]))) in tied)), key=lambda p: (str(p[0]), str(p[1]))):
            if used.get(a, 0) < 3 and used.get(b, 0) < 3:
                want.append((*sorted((of[a], of[b])), a, b))
                used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
        rows = enrich._alike_links(pa.table({"class": pa.array(of.values(), pa.int64()), "id": pa.array(of, pa.int64())}), pa.table({"a": pa.array([a for a, _ in tied], pa.int64()), "b": pa.array([b for _, b in tied], pa.int64())}), 3).to_pylist()
        assert [tuple(r[c] for c in ("a", "b", "source", "target")) for r in rows if r["target"] is not None] == want
        left = [r for r in rows if r["target"] is None]
        assert {r["source"]: r["room"] for r in left if r["room"]} == {x: 3 - used.get(x, 0) for x in of if used.get(x, 0) < 3}
        assert {r["a"] for r in left} == set(of.values()) and all(r["a"] == of[r["source"]] for r in left)


def test_registry_prefers_unused_rows(spark):
    manifest = spark.createDataFrame([(1, "2", "Same", "t2", None), (2, "1", "same!", "t1", "x.pdf"), (3, "9", "Alone", "t9", None)], "pos long, arxiv_id string, title string, tex_dir string, pdf_file string")
    bib = spark.createDataFrame([(1, "k1", None, "Same"), (2, "k2", None, "SAME"), (3, "k3", None, "same"), (4, "k4", "77", "Other")], "pos long, citation_key string, eprint string, title string")
    bib = bib.withColumn("doi", F.lit(None).cast("string")).withColumn("url", F.lit(None).cast("string"))
    got = {r["paper_id"]: (r["arxiv_id"], r["source_kind"]) for r in registry.merge_sources(manifest, bib).collect()}
    assert got == {"k1": ("1", "manifest_and_bib"), "k2": ("2", "manifest_and_bib"), "k3": ("1", "manifest_and_bib"), "k4": ("77", "bib"), "arxiv-9": ("9", "manifest")}
    with pytest.raises(LookupError):
        registry.pick_one(registry.merge_sources(manifest, bib), "nothing")


def test_thresholds():
    assert bench.parse_threshold("a<=2") == ("a", "<=", 2.0)
    with pytest.raises(ValueError):
        bench.parse_threshold("a=2")


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "id string, text string")
    assert links.containments(none, none.withColumnRenamed("id", "item")).count() == 0
    edges = spark.createDataFrame([], "source string, target string, rel_type string")
    assert graph.neighborhood(edges, spark.createDataFrame([("x",)], "id string"), 2).count() == 1
    with pytest.raises(ValueError):
        search.search_documents(none, " ", {}, {})


def test_merge_links(spark):
    schema = "source string, target string, strategy string, score double"
    old = spark.createDataFrame([("a", "t", "s", 0.1), ("b", "u", "s", 0.2)], schema)
    new = spark.createDataFrame([("c", "t", "s", 0.3, 1), ("c", "t", "s", 0.4, 2)], schema + ", pos int")
    assert sorted(map(tuple, links.merge_links(old, new).collect())) == [("b", "u", "s", 0.2), ("c", "t", "s", 0.4)]


def test_layout_places_every_node_once(spark):
    from quillgraph.plans import queries

    rows = queries.graph_layout(spark, "/root/testdata/sf0.001").collect()
    assert len({r["id"] for r in rows}) == len(rows) > 25 and all(r["x"] == r["x"] for r in rows)
    ring = [(r["x"] ** 2 + r["y"] ** 2) ** 0.5 for r in rows if r["id"].startswith("nation:")]
    assert max(ring) - min(ring) < 1e-6


def test_questions(spark):
    from quillgraph.operators import qa

    facts = spark.createDataFrame([(t, f"{t}{i % 12}", i) for t in ("symbol_definition", "make_target", "readme_command") for i in range(30)], "question_type string, expected_answer string, n int")
    a, b = qa.choose(facts, 25).collect(), qa.choose(facts.repartition(5), 25).collect()
    assert a == b and len(a) == 25
    got = [r["question_type"] for r in a]
    assert got.count("symbol_definition") == got.count("make_target") == 10
    assert len({(r["question_type"], r["expected_answer"]) for r in a}) == 25


def test_tabular_bundle(spark):
    from quillgraph.operators import tabular

    papers = spark.createDataFrame([("p", "T", None, [(1, "S", "c")], [], ["t"], ["Key A", "é"])], "paper_id string, title string, abstract string, sections array<struct<level:int,title:string,content:string>>, figures array<string>, tables array<string>, citations array<string>")
    books = spark.createDataFrame([("n", "p", [(0, "code", "x")])], "notebook_id string, paper_id string, cells array<struct<index:int,kind:string,source:string>>")
    more = spark.createDataFrame([("p", "CITES", "q"), ("p", "MENTIONS", "p:citation:0")], "source string, rel_type string, target string")
    b = tabular.bundle(papers, books, more)
    assert [tuple(r) for r in b["papers"].collect()] == [("p", "T", None, 1, 0, 1, 2)]
    assert [r["citation_id"] for r in b["citations"].orderBy("citation_row_id").collect()] == ["keya", "citation_1"]
    assert sorted(r["edge_id"] for r in b["edges"].collect()) == ["p:CITES:q", "p:MENTIONS:p:citation:0", "p:MENTIONS:p:citation:1"]
    nodes, edges = tabular.graph_of(papers)
    assert nodes.count() == 4 and edges.count() == 3
    view = {r["id"]: r for r in tabular.node_view(nodes).collect()}
    assert view["paper:p"]["title"] == "T" and view["paper:p:section:0"]["subtitle"] == "Level 1 · p"


def test_service_retries():
    from quillgraph.sources import service

    answers, slept = [(429, {"retry-after": "3"}, ""), (500, {}, ""), (200, {}, '[{"externalIds": {"A": 1, "B": [2]}}, null]')], []
    got = service.request(lambda ids: answers.pop(0), ["a", "b"], slept.append)
    assert slept == [3.0, 2.0]
    assert service.plain_paper(got[0])["externalIds"] == {"A": "1"} and service.plain_paper(got[1]) is None
    with pytest.raises(OSError):
        service.request(lambda ids: (404, {}, ""), ["a"], slept.append)


def test_modalities():
    from quillgraph.operators import capabilities

    assert capabilities.wanted_modalities() == set(capabilities.MODALITIES)
    assert capabilities.wanted_modalities({"code"}, {"code"}) == set()
    with pytest.raises(ValueError):
        capabilities.wanted_modalities({"nothing"})


def test_episodes(spark):
    import datetime

    from quillgraph.operators import episodes

    now = datetime.datetime(2024, 1, 2)
    rows = [("a/one_two.qmd", "---\ntitle: 'T'\n---\n# H\ntext\n```{python}\nrun()\n```\nend", now), ("b/long_name.md", "line\n" * 3000, now)]
    got = {r["path"]: r for r in episodes.episodes(spark.createDataFrame(rows, "path string, text string, mtime timestamp")).collect()}
    assert got["a/one_two.qmd"]["body"] == "Source Path: a/one_two.qmd\nDocument Title: T\nDocument Kind: qmd\n\n# H\ntext\nend"
    assert got["b/long_name.md"]["title"] == "long name" and got["b/long_name.md"]["body"].endswith("line" + episodes.CUT_NOTE)


def test_model_answers(spark):
    from quillgraph.operators import episodes

    items = spark.createDataFrame([('{"subject": " A ", "to": "B", "predicate": "is part-of"}',), ('{"source": "x", "target": "y", "relation": "r", "fact": "f"}',)], "item string")
    assert [tuple(r) for r in episodes.repaired_edges(items).collect()] == [("A", "B", "IS_PART_OF", "A is part-of B"), ("x", "y", "R", "f")]
    items = spark.createDataFrame([('{"entity": "E", "type_id": "7"}',), ('{"name": "N", "entity_type_id": "x"}',), ('{"name": "M", "type": "t"}',)], "item string")
    assert [tuple(r) for r in episodes.repaired_entities(items).collect()] == [("E", 7), ("N", 0), ("M", 0)]


def test_embedding_texts(spark):
    from quillgraph.operators import episodes

    df = spark.createDataFrame([(["Function"], {"name": "f", "path": "p", "module": "m", "source": "x" * 900, "other": "o"})], "l array<string>, p map<string,string>")
    r = df.select(episodes.code_text(F.col("l"), F.col("p")).alias("c"), episodes.graph_text(F.col("l"), F.col("p")).alias("g")).first()
    assert r["c"].startswith("kind: Function\nname: f\npath: p\n") and '{"module":"m"}' in r["c"] and r["c"].endswith("snippet: " + "x" * 800)
    assert 'attributes: {"module":"m","other":"o","path":"p"' in r["g"]


def test_cited_by(spark):
    from quillgraph.operators import episodes

    p = spark.createDataFrame([("a", "Key", ["z"]), ("b", None, ["KEY", "key"]), ("c", "z", [])], "paper_id string, citation_key string, citations array<string>")
    assert {r["paper_id"]: r["cited_by"] for r in episodes.cited_by(p).collect()} == {"a": ["b"], "b": [], "c": ["a"]}


@pytest.mark.parametrize("few", [200_000, 5])
def test_capped_links_are_the_sequential_choice(spark, monkeypatch, few):
    """A chain, a star and random links, chosen in one task or in rounds first."""
    monkeypatch.setattr(enrich, "FEW_LINKS", few)
    rng = random.Random(8)
    pairs = [(i, i + 1, 1.0 - i / 100) for i in range(40)] + [(100, 200 + i, rng.random()) for i in range(12)] + [(rng.randrange(300, 320), rng.randrange(320, 340), round(rng.random(), 2)) for _ in range(80)]
    pairs = [(a, b, s) for a, b, s in {(a, b): (a, b, s) for a, b, s in pairs}.values()]
    used, want = {}, set()
    for a, b, _ in sorted(pairs, key=lambda p: (-p[2], str(p[0]), str(p[1]))):
        if used.get(a, 0) < 2 and used.get(b, 0) < 2:
            want.add((a, b))
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
    got = enrich.capped_links(spark.createDataFrame(pairs, "source long, target long, score double"), cap=2)
    assert {(r["source"], r["target"]) for r in got.collect()} == want


def test_distinct_neighbours_need_few_rows(spark):
    rows = [(k, "a" if k < 500 else "b" if k % 2 else "c") for k in range(600)]
    df = spark.createDataFrame(rows, "k int, id string")
    got = [(r["k"], r["id"]) for r in context.adjacent_distinct(df, "id", ["k"], 3).orderBy("k").collect()]
    assert got == [(0, "a"), (500, "c"), (501, "b")]
    assert context.adjacent_distinct(df.where("id = 'a'"), "id", ["k"], 3).count() == 1
    nulls = spark.createDataFrame([(1, None), (2, None), (3, "x")], "k int, id string")
    assert [r["k"] for r in context.adjacent_distinct(nulls, "id", ["k"], 3).orderBy("k").collect()] == [1, 3]


def test_vectors_link_by_blocks(spark, monkeypatch):
    """Blocks of few rows give what a plain loop gives; words and known links count, odd vectors don't."""
    monkeypatch.setattr(links, "BLOCK", 7)
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], i % 2, [f"t{rng.randrange(3)}", f"u{rng.randrange(9)}"]) for i in range(60)]
    odd = [(100, [0.0] * 4, 0, ["t0"]), (101, None, 0, ["t0"]), (102, [1.0], 0, ["t0"]), (103, [1.0] * 4, 0, None)]
    df = spark.createDataFrame(rows + odd, "id long, vec array<double>, key int, tokens array<string>")
    known = spark.createDataFrame([(i, (i + 2) % 60) for i in range(60)], "source long, target long")
    got = {}
    for r in links.vector_links(df, df, 0.3, top=2, known=known).collect():
        got.setdefault(r["source"], []).append((r["score"], r["target"]))
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    for i, v, k, t in rows:
        want = sorted((-round(cosine(v, w), 6), j) for j, w, m, u in rows if j != i and m == k and set(t) & set(u) and j != (i + 2) % 60)
        assert sorted(got.get(i, []), key=lambda x: (-x[0], x[1])) == [(-s, j) for s, j in want if -s >= 0.3][:2]
    assert not set(got) & {100, 101, 102, 103}


def test_requests_and_plans_are_checked():
    assert checks.checked_request(" fix it ", "thesis-coding", 1) == ("fix it", "thesis-coding", 1)
    for bad in (("x", "nothing", 1), (" ", "thesis-coding", 1), ("x", "thesis-coding", 0)):
        with pytest.raises(ValueError):
            checks.checked_request(*bad)
    plan = checks.action_plan(" fix ", "advice", ["refresh a", "refresh b"], [("docs", "look"), ("x", "y")], [])
    assert plan[1:] == ["advice", "Refresh first if needed: refresh a", "Resolve missing leaf when it affects the task: docs -> look"] and "`fix`" in plan[0]
    assert checks.verification_commands("a", {"a": ["y", "x", "y"]}, ["z"]) == ["x", "y"] and checks.verification_commands("b", {}, ["z"]) == ["z"]


@pytest.mark.parametrize("hot", [1000, 4])
@pytest.mark.parametrize("with_known", [False, True])
def test_word_hints_with_hot_words(spark, monkeypatch, hot, with_known):
    monkeypatch.setattr(links, "HOT_WORD", hot)
    rng = random.Random(3)
    some = lambda: rng.sample(["the", "and", "of", "a1", "b1", "c1", "d1", "e1", "f1", "g1"], rng.randrange(1, 6))
    left, right = [(i, some()) for i in range(25)], [(100 + i, ["the", "and"][: 1 + i % 2] + rng.sample(["of", "a1", "b1", "c1", "d1"], rng.randrange(3)), i % 3) for i in range(30)]
    known = [(i, 100 + rng.randrange(30)) for i in range(25) for _ in range(3)] if with_known else []
    want = {}
    for i, t in left:
        found = sorted((-len(set(t) & set(u)), k, j) for j, u, k in right if len(set(t) & set(u)) >= 2 and (i, j) not in known)[:2]
        if found:
            want[i] = sorted((j, -n) for n, _, j in found)
    a, b = spark.createDataFrame(left, "id long, tokens array<string>"), spark.createDataFrame(right, "id long, tokens array<string>, rank int")
    got = {}
    for r in links.word_hints(a, b, spark.createDataFrame(known, "source long, target long") if known else None).collect():
        got.setdefault(r["source"], []).append((r["target"], r["shared"]))
    assert {k: sorted(v) for k, v in got.items()} == want


def test_phrases_that_end_within_words(spark):
    texts = [(1, "unlicensed under the terms"), (2, "licensed under the law"), (3, "x y"), (4, "licensed  under"), (5, "prelicensed underneath"), (6, None), (7, ""), (8, "a abcdefghijk b")]
    phrases = [(1, "licensed under the term"), (2, "licensed under"), (3, "y"), (4, "bcdefghij"), (5, " "), (6, ""), (7, " under "), (8, None), (9, "sed  under")]
    t, p = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(phrases, "item long, text string")
    want = {(i, k) for i, x in texts for k, y in phrases if x is not None and y is not None and y in x}
    got = [tuple(r) for r in links.containments(t, p).collect()]
    assert sorted(got) == sorted(want)


def test_equal_evidence_spans_are_one(spark):
    docs = spark.createDataFrame([(1, "a secret\nmore secret"), (2, "a secret\nno"), (3, "secret"), (4, "secret\nsecret\nend"), (5, "none\nat all")], "doc_id long, text string")
    got = sorted(tuple(r) for r in context.evidence_spans(docs, ["secret"]).collect())
    assert got == [
        (1, 1, 2, "a secret\na secret\nmore secret\nmore secret"), (2, 1, 2, "a secret\nno"), (3, 1, 1, "secret"),
        (4, 1, 2, "secret\nsecret"), (4, 1, 3, "secret\nsecret\nend"), (5, 1, 2, "none\nat all"),
    ]


def test_equal_evidence_spans_are_paid_once(spark):
    docs = spark.createDataFrame([(1, "a secret\nmore secret")], "doc_id long, text string")
    spans = context.evidence_spans(docs, ["secret"])
    packed = context.within_budget(spans, 200, ["line_start", "line_end"], group=["doc_id"])
    assert [(r["line_start"], r["line_end"], r["cost"], r["truncated"]) for r in packed.collect()] == [(1, 2, 16, False)]


def test_words_are_parted_as_in_sql(spark):
    import duckdb

    texts = ["a\x0bb", "a b\x0c c\x0b", "\x0b", " \x0b a", "a\x85b\u2003c\x1cd", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    want = [duckdb.execute(r"SELECT len(list_filter(regexp_split_to_array(?, '\s+'), lambda w: w <> '')) + 8", [t]).fetchone()[0] for t in texts]
    got = context.within_budget(rows, 200, ["k"], group=["k"]).orderBy("k").collect()
    assert [r["cost"] for r in got] == want


def test_paths_meet_on_more_than_a_name(spark):
    files = [(f"f{k}", f"/repo/src/pkg{k}/mod.py", f"src/pkg{k}/mod.py") for k in range(40)] + [("g", "a.md", "docs/a.md"), ("h", None, "x/y/z.rs"), ("i", "/a/docs/a.md", None)]
    texts = [("t1", "src/pkg3/mod.py"), ("t2", "see g3/mod.py and 3/mod.py"), ("t3", "./mod.py"), ("t4", "docs/a.md s/a.md"), ("t5", "x/y/z.rs y/z.rs"), ("t6", "/./a.md"), ("t7", "c/pkg1/mod.py src/g1/mod.py")]
    f, t = spark.createDataFrame(files, "id string, path string, relative_path string"), spark.createDataFrame(texts, "id string, text string")
    import re

    want = set()
    for source, body in texts:
        for ref in {re.sub("^[./]+", "", x) for x in re.findall(links.PATH, body)}:
            for target, path, relative in files:
                named = ref.split("/")[-1] in ((path or "").split("/")[-1], (relative or "").split("/")[-1])
                if named and ((path or "").endswith(ref) or relative == ref):
                    want.add((source, target, ref))
    found = links.path_links(t, f)
    assert {(r["source"], r["target"], r["evidence"]) for r in found.collect()} == want
    assert found.count() == len(want) and ("t2", "f13", "3/mod.py") in want


def test_copies_are_not_paired_for_the_best_match(spark):
    rng = random.Random(5)
    rows = [(k, str(rng.randrange(6)), rng.choice(["a", "b", None]), rng.choice([True, False, None]), rng.randrange(3)) for k in range(60)]
    records = [(k, str(k % 9), rng.choice(["a", "b", "c", None])) for k in range(70)]
    p = spark.createDataFrame(rows, "id long, citation_key string, arxiv_id string, structured boolean, richness long")
    r = spark.createDataFrame(records, "id long, citation_key string, arxiv_id string")
    want = {}
    for one in records:
        ranks = {}
        for row in rows:
            same = tuple(x is not None and x == y for x, y in zip(one, row))
            if any(same):
                ranks.setdefault(((row[3] is not None, row[3] or False), row[4], same), []).append(row[0])
        if ranks and len(best := ranks[max(ranks)]) == 1:
            want[str(one[0])] = str(best[0])
    assert {x["record_id"]: x["parsed_id"] for x in registry.best_matches(r, p).collect()} == want
    # many copies: a pair of all of them would be 4 * 10^8
    many = spark.range(20_000).select("id", F.lit("k").alias("citation_key"), F.lit("x").alias("arxiv_id"), F.lit(True).alias("structured"), F.col("id").alias("richness"))
    assert registry.best_matches(many.drop("structured", "richness"), many).select("parsed_id").distinct().collect()[0]["parsed_id"] == "19999"


def test_line_functions_on_odd_lines(spark):
    lines = ["[a, 'b']\r", "[", "]", "[]", " [x] ", "Doe, Ann, B", ",", "a,", "Ünï-Cødé 9 A", "", "ab", None]
    rows = spark.createDataFrame(list(enumerate(lines)), "k long, c string").select(
        "k", text.inline_list("c").alias("items"), text.author_key("c").alias("author"), text.letters_of_text("c").alias("fast"), text.letters_key("c").alias("key"), text.long_key("c", 3, text.letters_of_text).alias("long")
    )
    got = rows.orderBy("k").collect()
    assert [r["items"] for r in got][:5] == [["a", "b']\r"], [], [], [], ["x"]]
    assert [r["author"] for r in got][5:8] == ["ann, b doe", "", "a"]
    assert [r["fast"] for r in got] == [r["key"] for r in got] and got[8]["fast"] == "ncd9a"
    assert [r["long"] for r in got] == [r["key"] if r["key"] and len(r["key"]) >= 3 else None for r in got]


def test_candidates_are_made_once(spark):
    """Keys of whole texts aren't computed again for each use of an identity's candidates."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(k, f"d{k // 2}", None, None) for k in range(40)], "idx long, doi string, arxiv string, s2 string")
    found = identity.resolve_identities(rows.mapInArrow(count, rows.schema)).collect()
    assert len(found) == 40 and {r["component"] for r in found} == set(range(0, 40, 2)) and made.value == 40


def test_vectors_meet_some_rows_at_a_time(spark, monkeypatch):
    """Rows of a large block are compared a few at a time, vectors go as they are given."""
    monkeypatch.setattr(links, "ROWS", 3)
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], 0) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, vec array<float>, key int")
    vectors = {r["id"]: r["vec"] for r in df.collect()}
    cosine = lambda x, y: round(sum(a * b for a, b in zip(x, y)) / sum(a * a for a in x) ** 0.5 / sum(b * b for b in y) ** 0.5, 6)
    best = {i: min((-cosine(x, y), j) for j, y in vectors.items() if j != i) for i, x in vectors.items()}
    found = links.vector_links(df, df, 0.3)
    assert {r["source"]: r["target"] for r in found.collect()} == {i: j for i, (s, j) in best.items() if -s >= 0.3}
    assert links.BLOCK >= 16384
