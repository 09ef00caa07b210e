"""Sources and sinks on small files."""

import json

import pytest

from quillgraph.sources import bibtex, files, markdown, notebooks, pycode, sinks, tex
from quillgraph.streaming import pipelines


def put(root, **texts):
    for name, body in texts.items():
        p = root / name.replace("__", "/")
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    return str(root)


def test_bibtex():
    body = '@Article{k1, Title = {A {Nested} title},\n author="X and {Y}", year = 2020, year=2021}\n@comment{x}\n@misc(k2, url={u})'
    got = list(bibtex.entries(body))
    assert got == [("article", "k1", {"title": "A {Nested} title", "author": "X and {Y}", "year": "2021"}), ("misc", "k2", {"url": "u"})]
    with pytest.raises(ValueError):
        list(bibtex.entries("@article{k, title={never closed}"))


def test_read_bibtex(spark, tmp_path):
    (tmp_path / "a.bib").write_text("@article{k, doi={10.1/X}}")
    (tmp_path / "b.bib").write_text("@article{broken, title={")
    rows = bibtex.read_bibtex(spark, str(tmp_path), lenient=True).collect()
    assert [(r["citation_key"], r["fields"]) for r in rows] == [("k", {"doi": "10.1/X"})]


def test_tex(spark, tmp_path):
    paper = tmp_path / "p1"
    paper.mkdir()
    (paper / "main.tex").write_text("\\documentclass{x}\\title{A \\emph{b}}\n\\begin{document}\\begin{abstract}Sum% no\nmary\\end{abstract}\\input{sec/one}\\input{main}\\end{document}")
    (paper / "sec").mkdir()
    (paper / "sec" / "one.tex").write_text("\\section{One}Text \\citep[see][p. 1]{b, a}\\subsection{Two}More \\cite{*}\\begin{figure}\\caption{A {big} one}\\end{figure}\\begin{figure*}\\caption{No}\\end{figure*}")
    r = tex.read_papers(spark, str(tmp_path)).first()
    assert (r["path"], r["title"], r["abstract"], r["citations"], r["figures"]) == ("p1", "A b", "Sum mary", ["a", "b"], ["A big one"])
    assert [(s["level"], s["title"]) for s in r["sections"]] == [(1, "One"), (2, "Two")]
    bib = spark.createDataFrame([("p1", "a", {"doi": "https://doi.org/10.1234/X", "eprint": "2401.12345v2"}), ("p1", "z", {})], "path string, citation_key string, fields map<string,string>")
    ref = tex.cited_references(tex.read_papers(spark, str(tmp_path)), bib).collect()
    assert [(x["citation_key"], x["doi"], x["arxiv_id"]) for x in ref] == [("a", "10.1234/x", "2401.12345v2")]


def test_markdown(spark, tmp_path):
    (tmp_path / "n.md").write_text("---\ntitle: T\nauthors: [A, B]\ndate: 2024-01-02\n---\nIntro @key1\n# Head\nbody\n```\n# not a head\n```\n## Sub\nmore @key2.")
    r = markdown.read_documents(spark, str(tmp_path)).first()
    assert (r["title"], r["authors"], r["year"], r["citations"]) == ("T", ["A", "B"], "2024", ["key1", "key2"])
    assert [(s["level"], s["title"]) for s in r["sections"]] == [(0, ""), (1, "Head"), (2, "Sub")]


def test_memory(spark, tmp_path):
    (tmp_path / "DECISIONS.md").write_text("# D\n\n## One\nskip\n- first `src/a.py` and [x](docs/b.md)\n  goes on\n- second @key 2401.12345 <!-- supersedes: a, b;c -->\n## Two\nplain\n")
    nodes = markdown.read_memory(spark, str(tmp_path))
    rows = nodes.orderBy("line_start").collect()
    assert [(r["kind"], r["section"], r["ordinal"], r["line_start"], r["line_end"]) for r in rows] == [("bullet", "One", 1, 5, 6), ("bullet", "One", 2, 7, 7), ("section", "Two", None, 9, 9)]
    assert rows[1]["supersedes"] == ["a", "b", "c"] and "supersedes" not in rows[1]["text"]
    refs = {(r["raw"], r["kind"]) for r in markdown.reference_candidates(nodes).collect()}
    assert refs == {("src/a.py", "path"), ("docs/b.md", "path"), ("key", "citation_key"), ("2401.12345", "arxiv")}


def test_readme_facts():
    body = "```bash\n# build it\nmake all\nmake more\n```\n"
    assert [x[1:] for x in markdown.commands_of("p", body)] == [("build it", "make all")]
    assert [x[1:] for x in markdown.targets_of("m", "all: dep ## Builds all\n_x: ## no\n")] == [("all", "Builds all")]


def test_notebooks(spark, tmp_path):
    nb = {"metadata": {"kernelspec": {"name": "py", "language": "python"}}, "cells": [{"cell_type": "code", "source": ["a\n", "b"]}, {"cell_type": "odd", "source": "c"}]}
    (tmp_path / "p1").mkdir()
    (tmp_path / "p1" / "My Book.ipynb").write_text(json.dumps(nb))
    n = notebooks.read_notebooks(spark, str(tmp_path))
    r = n.first()
    assert (r["path"], r["notebook_id"], r["kernel"], r["language"]) == ("p1/My Book.ipynb", "my-book", "py", "python")
    assert [(c["index"], c["kind"], c["source"]) for c in r["cells"]] == [(0, "code", "a\nb"), (1, "raw", "c")]
    papers = spark.createDataFrame([("p1",), ("zz",)], "paper_id string")
    assert [tuple(x) for x in notebooks.attach(n, papers).collect()] == [("my-book", "p1")]


def test_code(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "a.py").write_text('import os\nfrom .b import helper as h\n\nclass C(object):\n    """Doc.\n\n    More."""\n    def m(self, x=1) -> int:\n        self.n()\n        return h(x)\n    def n(self):\n        only_one()\n')
    (tmp_path / "pkg" / "b.py").write_text("def helper(x):\n    return x\n\nasync def only_one():\n    pass\n")
    t = pycode.read_code(spark, str(tmp_path))
    got = {r["qualified_name"]: (r["kind"], r["signature"], r["doc_summary"]) for r in t["symbols"].collect()}
    assert got["pkg.a.C"] == ("class", "class C(object)", "Doc.") and got["pkg.a.C.m"][:2] == ("method", "def m(self, x=1) -> int") and got["pkg.b.only_one"][0] == "async_function"
    assert {r["target"] for r in t["imports"].collect()} == {"os", "pkg.b.helper"}
    calls = {r["target"]: r["resolved"] for r in pycode.resolve_calls(t["calls"], t["imports"], t["symbols"]).collect()}
    assert calls == {"self.n": "pkg.a.C.n", "h": "pkg.b.helper", "only_one": "pkg.b.only_one"}
    assert {r["target"]: r["resolved"] for r in pycode.resolve_imports(t["imports"], t["symbols"]).collect()} == {"os": None, "pkg.b.helper": "pkg.b.helper"}
    assert pycode.module_of("src/pkg/sub/__init__.py", {"src/pkg", "src/pkg/sub"}) == "pkg.sub"


def test_tables(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"arxiv_id": "1", "pdf_file": "a.pdf"}\n\n{"arxiv_id": "2", "title": "t"}\n')
    rows = {r["arxiv_id"]: (r["source_url"], r["pdf_url"]) for r in files.manifest(spark, str(tmp_path / "m.jsonl")).collect()}
    assert rows == {"1": ("https://arxiv.org/e-print/1", "https://arxiv.org/pdf/1.pdf"), "2": ("https://arxiv.org/e-print/2", None)}
    (tmp_path / "b.toml").write_text('[[issues]]\nid = "I1"\ntitle = "t"\ndescription = "d"\n[[issues]]\nid = "I2"\nstatus = "closed"\n[[todo]]\nid = "T1"\nstatus = "done"\n')
    assert [(r["kind"], r["id"], r["summary"]) for r in files.backlog(spark, str(tmp_path / "b.toml")).collect()] == [("issue", "I1", "d")]
    names = spark.createDataFrame([("a/b",), ("../x",), ("/etc",), ("a/../b",)], "p string")
    assert [r["s"] for r in names.select(files.safe_member("p").alias("s")).collect()] == [True, False, False, False]
    (tmp_path / "src").mkdir()
    for n in ("a.py", "b.md", "c.txt"):
        (tmp_path / "src" / n).write_text("x")
    found = files.matching(files.whole_texts(spark, str(tmp_path / "src")), ["*.py", "*.md"], ["b.*"])
    assert [r["path"].rsplit("/", 1)[-1] for r in found.collect()] == ["a.py"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("p", ["a", "b"], None)], "id string, xs array<string>, y string")
    out = sinks.export_all({"t": df}, str(tmp_path))
    assert [tuple(r) for r in spark.read.option("header", True).csv(out["t.csv"]).fillna("").collect()] == [("p", "a|b", "")]
    assert spark.read.parquet(out["t.parquet"]).collect() == df.collect()
    assert sinks.deterministic_json(spark.read.json(out["t.jsonl"])) == ['{"id":"p","xs":["a","b"]}']
    d = spark.createDataFrame([("T", ["A"], "Sum", [(1, "S", "body")], ["k"])], "t string, a array<string>, s string, x array<struct<level:int,title:string,content:string>>, c array<string>")
    assert d.select(sinks.markdown(*d.columns and [d[c] for c in ("t", "a", "s", "x", "c")]).alias("m")).first()["m"] == "# T\n\nAuthors: A\n\n## Abstract\n\nSum\n\n## S\n\nbody\n\n## Citations\n\n- @k"


def test_streams(spark, tmp_path):
    source, seen = tmp_path / "in", []
    source.mkdir()
    (source / "1.json").write_text('{"k": "a", "t": 1}\n{"k": "a", "t": 2}')
    for _ in range(2):
        pipelines.rebuild_on_change(spark, str(source), "k string, t int", lambda df: seen.append(pipelines.upsert(None, df, "k", "t").collect()), str(tmp_path / "check")).awaitTermination()
    assert [[tuple(r) for r in rows] for rows in seen if rows] == [[("a", 2)]]
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert pipelines.event_counts(events).agg({"n": "sum"}).first()[0] == events.count()


def test_commands_give_runs(spark, tmp_path):
    from quillgraph.sources import commands

    ok = """printf '{"status": "completed", "summary": "fine", "scores": [{"metric_id": "acc", "value": 0.5, "unit": "share"}]}' > "$BENCHMARK_RESULT_PATH"; test "$BENCHMARK_ID" = b && test "$SEED" = 7"""
    cases = {"ok": ok, "bad": "exit 3", "none": "true", "odd": 'echo nothing > "$BENCHMARK_RESULT_PATH"'}
    runs = [commands.run_benchmark(commands.RunRequest(k, "b", c, str(tmp_path), {"SEED": "7"}), tmp_path / k) for k, c in cases.items()]
    runs.append(commands.run_benchmark(commands.RunRequest("lost", "b", "true", str(tmp_path / "missing")), tmp_path / "lost"))
    assert [r["status"] for r in runs] == ["completed", "command_failed", "missing_result", "invalid_result", "launch_failed"]
    rows = {r["run_id"]: (r["status"], r["metric"], r["value"]) for r in commands.score_rows(spark, runs).collect()}
    assert rows["ok"] == ("completed", "acc", 0.5) and rows["bad"] == ("command_failed", None, None)
    assert [commands.rebuild(c) for c in ("true", "false", None)] == ["rebuilt", "skipped", "skipped"]


def test_archives_stay_in_their_folder(tmp_path):
    import io
    import tarfile

    from quillgraph.sources import files

    def archive(**members):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w:gz") as tar:
            for name, body in members.items():
                info = tarfile.TarInfo(name.replace("__", "/"))
                info.size = len(body)
                tar.addfile(info, io.BytesIO(body))
        return out.getvalue()

    assert files.unpacked(archive(a__b=b"one", c=b"two"), str(tmp_path)) == [f"{tmp_path}/a/b", f"{tmp_path}/c"]
    assert files.unpacked(archive(c=b"new"), str(tmp_path)) == [] and (tmp_path / "c").read_bytes() == b"two"
    assert files.unpacked(archive(c=b"new"), str(tmp_path), overwrite=True) and (tmp_path / "c").read_bytes() == b"new"
    with pytest.raises(ValueError):
        files.unpacked(archive(**{"..__x": b"bad"}), str(tmp_path))


def test_embeddings_have_their_dimension(spark):
    from quillgraph.sources import service

    rows = spark.createDataFrame([(i, "x" * i) for i in range(70)], "id long, text string")
    got = {r["id"]: r["vec"] for r in service.embeddings(rows, lambda ts: [[len(t), 1.0] for t in ts], 2).collect()}
    assert got == {i: [i, 1.0] for i in range(70)}
    with pytest.raises(Exception, match="dimension 3"):
        service.embeddings(rows, lambda ts: [[0.0] for _ in ts], 3).collect()


def test_results_in_a_form(spark):
    from quillgraph.sources import sinks

    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, t string").coalesce(1)
    assert sinks.structured(df, "json") == '[{"n":1,"t":"a"},{"n":2}]' and sinks.structured(df, "text") == "n | t\n1 | a\n2 | "
    with pytest.raises(ValueError):
        sinks.structured(df, "xml")
    done = []
    assert sinks.write_graph("both", lambda: done.append("docs"), lambda: done.append("graph")) == done == ["docs", "graph"]
    with pytest.raises(ValueError):
        sinks.write_graph("none", lambda: None, lambda: None)


def test_papers_are_parsed_many_at_once(spark):
    """Papers are rows of batches, not a group each."""
    files = [(f"p{k}", f"p{k}/main.tex", f"\\title{{T{k}}} \\input{{x}}") for k in range(50)] + [(f"p{k}", f"p{k}/x.tex", f"\\cite{{c{k}}}") for k in range(50)] + [("q", "q/a.tex", "no document")]
    papers = tex.papers_of(spark.createDataFrame(files, "folder string, path string, text string"))
    assert {(r["path"], r["title"], tuple(r["citations"]), len(r["sections"]), r["abstract"]) for r in papers.collect()} == {(f"p{k}", f"T{k}", (f"c{k}",), 0, None) for k in range(50)}
    plan = papers._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan and "MapInArrow" in plan
