"""Every scalar function on cases with known results, for each row of a table.

``{k}`` in a case stands for the row's key, so no result is a constant.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ranking, text
from ..operators import capabilities, checks, episodes, tabular
from ..sources import files
from .hosts import table
from .registry import register

_TIERS = {"*.md": 1.2, "docs/*": 1.6}


def _all(pattern: str) -> Callable[[Column], Column]:
    return lambda c: F.array_join(text.found_all(c, pattern), "|")


def _joined(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda c: F.array_join(f(c), "|")


#: (function, how it is called, [(input, result)])
CASES: list[tuple[str, Callable[[Column], Column], list[tuple[str, str | None]]]] = [
    ("slugify", text.slugify, [("Hello, World! {k}", "hello-world-{k}"), ("--", "")]),
    ("run_slug", text.run_slug, [("a b_c-d {k}", "a-b_c-d-{k}"), ("!!", "run")]),
    ("letters_key", text.letters_key, [("A-b C{k}", "abc{k}"), ("é", "")]),
    ("title_key", lambda c: text.long_key(c, 12), [("Visual Odometry {k}", "visualodometry{k}"), ("short", None)]),
    ("key_key", lambda c: text.long_key(c, 3), [("a{k}-x", "a{k}x"), ("ab", None)]),
    ("citation_id", lambda c: text.citation_id(c, F.lit(4)), [("Key-{k}", "key{k}"), ("--", "citation_4")]),
    ("doi_identity", text.doi_identity, [(" https://doi.org/10.1/AbC{k}/", "10.1/abc{k}"), ("doi:10.1/X{k}", "10.1/x{k}")]),
    ("doi_link", text.doi_link, [("doi:10.5/X{k}.", "10.5/x{k}"), ("11.5/X", None), ("https://dx.doi.org/10.7/A{k}", "10.7/a{k}")]),
    ("doi_in_text", text.doi_in_text, [("see 10.1234/Abc.{k}, and", "10.1234/abc.{k}"), ("none {k}", None)]),
    ("arxiv_identity", text.arxiv_identity, [("arXiv:2401.12345v2", "2401.12345"), ("arXiv:hep-th/{k}v2", "hep-th/{k}")]),
    ("arxiv_link", text.arxiv_link, [("https://arxiv.org/pdf/2401.12345v{k}.pdf", "2401.12345v{k}"), ("hep.th{k}", None)]),
    ("arxiv_in_text", text.arxiv_in_text, [("x arXiv:2401.12345v2 y", "2401.12345v2"), ("none", None)]),
    ("author_key", text.author_key, [("Doe{k}, Jane", "jane doe{k}"), (" Jane Doe{k} ", "jane doe{k}")]),
    ("split_authors", _joined(text.split_authors), [("A{k} and B and ", "A{k}|B")]),
    ("paper_id", lambda c: text.paper_id(F.lit(" "), c, F.lit("A Title")), [("2401.{k}", "arxiv-2401-{k}"), (" ", "a-title")]),
    ("squeeze", text.squeeze, [(" a \n b{k} ", "a b{k}")]),
    ("clip_dots", lambda c: text.clip_dots(c, 5), [("abcdefg{k}", "abcde..."), ("abc", "abc")]),
    ("clip_ellipsis", lambda c: text.clip_ellipsis(c, 5), [("abcdefg{k}", "abcd…"), ("abc", "abc")]),
    ("topic_tokens", _joined(text.topic_tokens), [("The Visual odometry{k}abcd and Method 1234 visual", "visual|odometry{k}abcd")]),
    ("task_terms", _joined(text.task_terms), [("Fix THE bug{k} in it", "bug{k}|fix|the")]),
    ("query_terms", _joined(text.query_terms), [("Foo|bar  BAZ{k}", "foo|bar|baz{k}")]),
    ("embedding_tokens", _joined(text.embedding_tokens), [("kg ab a_b{k} TEX xyz", "kg|a_b{k}|tex|xyz")]),
    ("plain_path", text.plain_path, [("./x/{k}", "x/{k}"), ("a\\b{k}", "a/b{k}")]),
    ("looks_like_path", text.looks_like_path, [("a/b{k}", "true"), ("abc{k}", "false"), ("x{k}.py", "true")]),
    ("looks_like_symbol", text.looks_like_symbol, [("pkg.mod{k}", "true"), ("two words{k}", "false"), ("snake_case{k}", "true")]),
    ("is_doc_path", text.is_doc_path, [("docs/a{k}", "true"), ("src/a{k}.py", "false")]),
    ("is_code_path", text.is_code_path, [("src/a{k}.py", "true"), ("notes/a{k}.md", "false")]),
    ("links", _all(text.LINK), [("see [a](x/{k}.md) and [b](y)", "x/{k}.md|y")]),
    ("code_spans", _all(text.CODE_SPAN), [("use `a.b{k}` or `c d`", "a.b{k}|c d")]),
    ("citation_keys", _all(text.CITATION_KEY), [("as @key{k} and @b-c", "key{k}|b-c")]),
    ("arxiv_ids", _all(text.ARXIV_ID), [("1234.56789v{k} and 2401.00001", "1234.56789v{k}|2401.00001")]),
    ("supersedes", _all(text.SUPERSEDES), [("<!-- supersedes: old{k} -->", "old{k}")]),
    ("external_paper_id", lambda c: text.external_paper_id(F.lit(" "), c, F.lit("1")), [("10.1/{k}", "DOI:10.1/{k}"), ("", "ARXIV:1")]),
    ("encode_segment", text.encode_segment, [("a b/c*{k}", "a%20b%2Fc%2A{k}")]),
    ("priority_rank", text.priority_rank, [("critical", "0"), ("P1", "1"), ("medium", "2"), ("P3", "3"), ("x{k}", "4")]),
    ("reference_kind", text.reference_kind, [("paper:x{k}", "paper"), ("x{k}", "raw")]),
    ("cell_kind", text.cell_kind, [("code", "code"), ("markdown", "markdown"), ("x{k}", "raw")]),
    ("plain_answer", text.plain_answer, [("<think>x</think>```sh\nmake all{k}\n```", "make all{k}")]),
    ("answer_is_right", lambda c: text.answer_is_right(c, F.array(F.lit("yes it is")), F.lit("text")), [("well, yes it is {k}", "true"), ("no {k}", "false")]),
    ("inline_list", _joined(text.inline_list), [('[a{k}, "b", ]', "a{k}|b")]),
    ("line_count", text.line_count, [("a\nb\n", "2"), ("{k}", "1")]),
    ("remote_repo", text.remote_repo, [("git@github.com:me/it{k}.git", "me/it{k}"), ("https://example.org/me/it", None)]),
    ("json_object", text.json_object, [('noise {"a": {k}} noise', '{"a": {k}}')]),
    ("string_map", lambda c: F.to_json(text.string_map(c)), [('{"a": {k}, "b": null}', '{"a":"{k}","b":""}')]),
    ("snippet", lambda c: text.snippet(c, "needle"), [("a\n Needle  here{k}\nb", "Needle here{k}"), ("none {k}", "none {k}")]),
    ("source_type", ranking.source_type, [("docs/a{k}.md", "docs"), ("x/.agents/memory/state/{k}.md", "canonical_memory"), ("sub/AGENTS.md", "agent_guidance"), ("{k}", "default")]),
    ("authority", lambda c: ranking.authority(c, _TIERS), [("repo/docs/a{k}.md", "1.6"), ("{k}.md", "1.2"), ("{k}.txt", "1.0")]),
    ("authority_label", lambda c: ranking.authority_label(F.try_to_number(c, F.lit("9.9")).cast("double")), [("1.5", "canonical"), ("1.2", "active"), ("0.5", "historical"), ("1.0", "default")]),
    ("freshness", lambda c: ranking.freshness(F.length(c).cast("double")), [("123456789012345678901234567890", "0.5"), ("", "1.0")]),
    ("document_label", tabular.document_label, [("literature", "Paper"), ("transcript", "Transcript"), ("x{k}", None)]),
    ("section_label", lambda c: tabular.document_label(c, True), [("research_note", "ResearchNoteSection"), ("documentation", "DocSection")]),
    ("safe_member", files.safe_member, [("a/b{k}", "true"), ("a/../{k}", "false"), ("/x{k}", "false")]),
    ("line_hit_score", lambda c: episodes.line_hit_score(c, F.lit("id"), "needle"), [("The Needle {k}", "1050"), ("x{k}", "700")]),
    ("recommendation", capabilities.recommendation, [("ready", "use_now"), ("stale", "refresh_first"), ("missing", "missing_leaf"), ("x{k}", "do_not_use")]),
    ("overclaims", checks.overclaims, [("Claim-Check: deployed {k}", "true"), ("deployed {k}", "false")]),
    ("may_ask", lambda c: checks.may_ask(c, ["src/"]), [("src/a{k}.py", "true"), ("src/tests/a{k}.py", "false"), ("lib/a{k}", "false")]),
    ("in_scope", lambda c: checks.in_scope([c], ["src/", "lib/"]), [("lib/a{k}", "true"), ("docs/{k}", "false")]),
    ("without_chunks", episodes.without_chunks, [("a{k}\n```{python}\nx = 1\n```\nb", "a{k}\nb")]),
]


def _quoted(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


_ROWS = [(name, n, given, want) for name, _, cases in CASES for n, (given, want) in enumerate(cases)]
_SQL = f"""SELECT s_suppkey, name, n, replace(want, '{{k}}', CAST(s_suppkey AS VARCHAR)) AS result
FROM supplier, (VALUES {", ".join(f"({_quoted(name)}, {n}, CAST({_quoted(want)} AS VARCHAR))" for name, n, _, want in _ROWS)}) c(name, n, want)"""


@register("text_functions", _SQL)
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each function on its cases, for every supplier."""
    cases = spark.createDataFrame([r[:3] for r in _ROWS], "name string, n int, given string")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey").crossJoin(F.broadcast(cases))
    rows = rows.withColumn("c", F.replace("given", F.lit("{k}"), F.col("s_suppkey").cast("string")))
    parts = None
    # a plan of all functions at once would be too large for generated code
    for lo in range(0, len(CASES), 12):
        some = CASES[lo : lo + 12]
        result = F.coalesce(*[F.when(F.col("name") == name, f(F.col("c")).cast("string")) for name, f, _ in some])
        part = rows.where(F.col("name").isin(*[name for name, _, _ in some])).select("s_suppkey", "name", "n", result.alias("result"))
        parts = part if parts is None else parts.unionByName(part)
    return parts
