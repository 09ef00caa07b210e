"""TOML records against parsing files whole."""

import json
import random
import tomllib

import pytest
from pyspark.sql import functions as F

from quillgraph.sources import files, tomls

VALUES = ['"plain"', "'[[no]]'", '"""one\n[[runs]]\ntwo \\""" three"""', "'''\n[table]\n\"\"\"'''", '"""ends in two"""""', '"# no comment"', '"""a \\\n   [x]\n"""', "1", "[1,\n  2]", '{ k = "v" }', "1979-05-27T07:32:00Z", '"""open # [[runs]]\n"""', "true"]


def made(rng, tables):
    out = ["top = 1 # \"\"\" no string\n"] if rng.random() < 0.5 else []
    for k in range(tables):
        out.append(f"[[{rng.choice(['runs', 'issue', '\"odd name\"'])}]] # [x]\n" if rng.random() < 0.9 else f"[single{k}]\n")
        out += [f"k{i} = {rng.choice(VALUES)}\n" for i in range(rng.randrange(0, 4))]
    return "".join(out)


def whole(text):
    found, out = tomllib.loads(text), []
    for name, value in found.items():
        for item in value if isinstance(value, list) and value and isinstance(value[0], dict) else [value] if isinstance(value, dict) else []:
            out.append((name, json.dumps(item, sort_keys=True, default=str, ensure_ascii=False)))
    return sorted(out)


@pytest.mark.parametrize("split", [150, 1000, 128 << 20])
def test_records_of_many_blocks(spark, tmp_path, split):
    rng = random.Random(split)
    texts = {f"f{k}.toml": made(rng, rng.randrange(0, 40)) for k in range(3)}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows = tomls.items(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name, text in texts.items():
        got = sorted((r["name"], r["item"]) for r in rows if r["file"].endswith(name) and r["name"])
        assert got == whole(text), text


def test_tables_below_a_table_stay_with_it(spark, tmp_path):
    (tmp_path / "a.toml").write_text('x = 1\n[[runs]]\nrun_id = "a"\n[runs.env]\nS = "1"\n[[runs.scores]]\nmetric = "m"\nvalue = 2\n[[runs.scores]]\nmetric_id = "n"\n\n[[runs]]\nrun_id = "b"\n')
    got = files.results(spark, str(tmp_path / "a.toml")).collect()
    assert sorted(map(tuple, got), key=str) == [("a", "", "", "m", 2.0, None), ("a", "", "", "n", 0.0, None)]
    assert sorted((r["run_id"], r["env"].get("S")) for r in files.run_plan(spark, str(tmp_path / "a.toml")).collect()) == [("a", "1"), ("b", None)]
    assert [r["item"] for r in tomls.items(spark, str(tmp_path / "a.toml")).where("name = ''").collect()] == ['{"x": 1}']


def test_many_tables_in_many_tasks(spark, tmp_path):
    n = 20_000
    with open(tmp_path / "big.toml", "w") as f:
        for k in range(n):
            f.write(f'[[todos]]\nid = "T{k}"\ntitle = """\n[[issue]]\nline {k}"""\nstatus = "{"done" if k % 4 == 0 else "open"}"\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", 200_000)
    try:
        rows = files.backlog(spark, str(tmp_path / "big.toml"))
        assert rows.agg(F.count_distinct("id")).first()[0] == n * 3 // 4 == rows.count()
        assert spark.read.text(str(tmp_path / "big.toml")).rdd.getNumPartitions() > 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows.where("id = 'T77'").first()["title"] == "[[issue]]\nline 77"


def test_runs_are_written_and_read(spark, tmp_path):
    runs = spark.createDataFrame([("r1", 'b "x"', "ok\n2", [("m", 0.5, None), ("é", 1e-9, "s")]), ("r2", "b", "x", [])], "run_id string, benchmark_id string, status string, scores array<struct<metric_id: string, value: double, unit: string>>")
    tomls.write_runs(runs, str(tmp_path / "out"))
    got = sorted(map(tuple, files.results(spark, str(tmp_path / "out")).collect()), key=str)
    assert got == [("r1", 'b "x"', "ok\n2", "m", 0.5, None), ("r1", 'b "x"', "ok\n2", "é", 1e-9, "s")]
