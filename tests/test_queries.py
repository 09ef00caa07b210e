"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import duck, same

from quillgraph.plans import queries as _queries  # noqa: F401
from quillgraph.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    same(registry.QUERIES[name](spark, SF), con, registry.ORACLE_SQL[name])


def test_topic_links_are_the_greedy_choice(spark):
    pairs = registry.QUERIES["topic_pairs"](spark, SF).collect()
    used, want = {}, set()
    for r in sorted(pairs, key=lambda r: (-r["score"], str(r["source"]), str(r["target"]))):
        if used.get(r["source"], 0) < 3 and used.get(r["target"], 0) < 3:
            want.add((r["source"], r["target"]))
            for end in (r["source"], r["target"]):
                used[end] = used.get(end, 0) + 1
    assert {(r["source"], r["target"]) for r in registry.QUERIES["topic_links"](spark, SF).collect()} == want


def test_every_benchmark_item_is_scored(spark, tmp_path):
    items = [(i * i + 3, f"answer {i}") for i in range(130)]
    # document i holds the answer of the item in its place; documents of source b hold a wrong one
    docs = [(i, f"so answer {i % 130}" if i % 3 else "wrong", "b" if i % 3 == 0 else "a") for i in range(390)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["item_id"]: (r["questions"], r["exact_match"]) for r in registry.QUERIES["qa_scores"](spark, str(tmp_path)).collect()}
    assert got == {i: (3, 0.666667) for i, _ in items}
    summary = {r["source"]: (r["questions"], r["exact_match"]) for r in registry.QUERIES["qa_summary"](spark, str(tmp_path)).collect()}
    assert summary == {"a": (260, 1.0), "b": (130, 0.0)}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
