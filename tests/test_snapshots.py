"""Tables behind commits: what is written anew, and what readers see."""

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import links
from quillgraph.sources.snapshots import SnapshotTable
from quillgraph.streaming import pipelines


def counts(df):
    return df.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_rebuild_makes_changed_parts_alone(spark, tmp_path):
    made = lambda data: spark.createDataFrame(data, "source string, text string")
    data = [("a", "x"), ("a", "x"), ("b", "yy"), (None, "n"), ("c/ d", None)]
    t = SnapshotTable(spark, str(tmp_path / "t"))
    asked = []

    def build(df):
        asked.append({r["source"] for r in df.select("source").distinct().collect()})
        return counts(df)

    assert t.read() is None
    assert t.rebuild(made(data), "source", build) == {"built": ["null", "va", "vb", "vc/ d"], "kept": [], "dropped": []}
    assert rows(t.read()) == rows(counts(made(data)))
    assert t.rebuild(made(data[::-1]).repartition(3), "source", build) == {"built": [], "kept": ["null", "va", "vb", "vc/ d"], "dropped": []} and t.versions() == [1]
    data[2] = ("b", "zz")
    assert t.rebuild(made(data[1:4]), "source", build) == {"built": ["va", "vb"], "kept": ["null"], "dropped": ["vc/ d"]}
    assert asked == [{"a", "b", None, "c/ d"}, {"a", "b"}] and rows(t.read()) == rows(counts(made(data[1:4])))
    assert len(rows(t.read(1))) == 4
    t.rebuild(made([]), "source", build)
    assert t.parts() == [] and t.versions() == [1, 2, 3]


def test_update_writes_touched_buckets_alone(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"))
    put = lambda current, batch: pipelines.upsert(current, batch, "id", "pos")
    base = spark.range(5000).selectExpr("id", "id * 2 AS value", "0 AS pos")
    assert len(t.update(base, ["id"], put, buckets=100)) == 100
    before, first = {p.part: p.folder for p in t.parts()}, t.read()
    batch = spark.createDataFrame([(7, -1, 1), (7, -2, 2), (9000, 5, 1), (None, 6, 1)], "id long, value long, pos int")
    touched = t.update(batch, ["id"], put)
    after = {p.part: p.folder for p in t.parts()}
    assert len(touched) == 3 and {p for p in after if after[p] != before[p]} == set(touched)
    assert first.count() == 5000 and first.where("id = 7").first()["value"] == 14
    now = t.read()
    assert now.count() == 5002 and now.where("id = 7").collect()[0]["value"] == -2 and now.where("id is null").count() == 1
    assert t.update(batch.limit(0), ["id"], put) == [] and t.versions() == [1, 2]
    assert t.vacuum(keep=2) == 0 and t.vacuum(keep=1) == 0 and t.read().count() == 5002


def test_a_job_that_dies_changes_nothing(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"))
    put = lambda current, batch: pipelines.upsert(current, batch, "id", "pos")
    one = spark.createDataFrame([(1, 1)], "id long, pos int")
    t.update(one, ["id"], put, buckets=4)

    def dies(current, batch):
        return put(current, batch).withColumn("pos", F.raise_error(F.lit("lost")).cast("int"))

    with pytest.raises(Exception, match="lost"):
        t.update(one, ["id"], dies)
    assert t.versions() == [1] and rows(t.read()) == [(1, 1)]
    assert t.vacuum(keep=1) == 1 and rows(t.read()) == [(1, 1)]
    with pytest.raises(ValueError):
        t.update(one, ["id"], lambda current, batch: spark.range(50).selectExpr("id", "1 AS pos"))


def test_links_are_cleared_and_merged_in_buckets(spark, tmp_path):
    old = spark.createDataFrame([(1, 5, "a", 0.5), (2, 5, "a", 0.5), (1, 6, "a", 0.5), (3, 70, "a", 0.1)], "source long, target long, strategy string, score double")
    new = spark.createDataFrame([(9, 5, "b", 0.9, 1), (9, 5, "b", 0.8, 2)], "source long, target long, strategy string, score double, pos int")
    t = SnapshotTable(spark, str(tmp_path / "t"))
    t.update(old, ["target"], lambda current, batch: batch, buckets=8)
    assert len(t.update(new, ["target"], links.merge_links)) == 1
    assert rows(t.read()) == rows(links.merge_links(old, new))
