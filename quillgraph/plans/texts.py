"""Text functions on the columns of tables: identifiers, paths, lines, answers and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ranking, text
from ..operators import checks, stats
from ..sources import files
from .hosts import ASCII_LOWER, LINES_SQL, table
from .registry import register


def _slug_sql(c: str) -> str:
    return f"trim({ASCII_LOWER.format(f'''regexp_replace({c}, '[^A-Za-z0-9]+', '-', 'g')''')}, '-')"


def _letters_sql(c: str) -> str:
    return ASCII_LOWER.format(f"regexp_replace({c}, '[^A-Za-z0-9]', '', 'g')")


_DOI = r"trim(trim(regexp_replace(trim(ref), '^((https?://(dx[.])?doi.org/)|doi:|DOI:)+', '')))"
_ARXIV = r"regexp_replace(regexp_replace(trim(ref), '^(https?://arxiv.org/(abs|pdf)/|arXiv:|arxiv:)', ''), '[.]pdf$', '')"
_IDENTIFIERS_SQL = rf"""WITH t AS (SELECT page_id, url, regexp_replace(url, '^[a-z]+://', '') AS tail FROM pages WHERE url IS NOT NULL),
r AS (SELECT page_id, url, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN ' https://doi.org/10.' || (1000 + page_id) || '/' || tail || '. ' WHEN 2 THEN 'arXiv:' || lpad(CAST(page_id % 10000 AS VARCHAR), 4, '0') || '.' || lpad(CAST(page_id % 100000 AS VARCHAR), 5, '0') || 'v2'
  WHEN 3 THEN 'see doi:10.5555/' || tail || ', p. 3' ELSE 'https://github.com/' || split_part(tail, '/', 1) || '/r' || page_id || '.git' END AS ref FROM t),
f AS (SELECT *, {_DOI} AS d0, {_ARXIV} AS a0, regexp_extract(ref, '10\.\d{{4,9}}/[^\s{{}}]+') AS dt, regexp_extract(ref, '\d{{4}}\.\d{{4,5}}') AS an,
  nullif(regexp_extract(ref, '(?:arXiv:)?(\d{{4}}\.\d{{4,5}}(?:v\d+)?)', 1), '') AS arxiv_in_text, nullif(regexp_extract(trim(ref), '^(?:git@github\.com:|ssh://git@github\.com/|https?://github\.com/)([^/]+/[^/]+?)(?:\.git)?/?$', 1), '') AS repo FROM r),
g AS (SELECT *, CASE WHEN starts_with(rtrim(d0, '.'), '10.') THEN lower(rtrim(d0, '.')) END AS doi_link, CASE WHEN regexp_matches(a0, '^[0-9]') AND contains(a0, '.') THEN a0 END AS arxiv_link FROM f)
SELECT page_id, trim(regexp_replace(lower(trim(ref)), '^(https://doi.org/|http://doi.org/|doi:)', ''), '/') AS doi_identity, doi_link, CASE WHEN dt <> '' THEN lower(rtrim(dt, '.,;')) END AS doi_in_text,
  CASE WHEN an <> '' THEN an ELSE regexp_extract(regexp_replace(lower(trim(ref)), '^arxiv:', ''), '^[^v]*') END AS arxiv_identity, arxiv_link, arxiv_in_text, repo,
  coalesce('DOI:' || nullif(trim(doi_link), ''), 'ARXIV:' || nullif(trim(arxiv_link), '')) AS external_id,
  CASE WHEN repo IS NOT NULL THEN {_slug_sql("repo")} WHEN arxiv_in_text IS NOT NULL THEN 'arxiv-' || {_slug_sql("arxiv_in_text")} ELSE {_slug_sql("ref")} END AS paper_id,
  replace(url_encode(ref), '~', '%7E') AS segment FROM g"""


@register("identifier_forms", _IDENTIFIERS_SQL)
def identifier_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of five kinds made of the urls of all pages, through every normalizer of identifiers."""
    page, tail, number = F.col("page_id"), F.regexp_replace("url", "^[a-z]+://", ""), F.col("page_id").cast("string")
    kinds = [
        F.col("url"),
        F.concat(F.lit(" https://doi.org/10."), (1000 + page).cast("string"), F.lit("/"), tail, F.lit(". ")),
        F.concat(F.lit("arXiv:"), F.lpad((page % 10000).cast("string"), 4, "0"), F.lit("."), F.lpad((page % 100000).cast("string"), 5, "0"), F.lit("v2")),
        F.concat(F.lit("see doi:10.5555/"), tail, F.lit(", p. 3")),
    ]
    repo = F.concat(F.lit("https://github.com/"), F.split_part(tail, F.lit("/"), F.lit(1)), F.lit("/r"), number, F.lit(".git"))
    ref: Column = repo
    for k, c in enumerate(kinds):
        ref = F.when(page % 5 == k, c).otherwise(ref)
    r = table(spark, sf_dir, "pages").where("url is not null").select("page_id", ref.alias("ref"))
    r = r.select("page_id", "ref", text.doi_link("ref").alias("doi_link"), text.arxiv_link("ref").alias("arxiv_link"), text.arxiv_in_text("ref").alias("arxiv_in_text"), text.remote_repo("ref").alias("repo"))
    return r.select(
        "page_id", text.doi_identity("ref").alias("doi_identity"), "doi_link", text.doi_in_text("ref").alias("doi_in_text"), text.arxiv_identity("ref").alias("arxiv_identity"), "arxiv_link", "arxiv_in_text", "repo",
        text.external_paper_id(F.lit(None).cast("string"), F.col("doi_link"), F.col("arxiv_link")).alias("external_id"), text.paper_id(F.col("repo"), F.col("arxiv_in_text"), F.col("ref")).alias("paper_id"), text.encode_segment("ref").alias("segment"),
    )


def _any_sql(parts: list[str]) -> str:
    return "(" + (" OR ".join(parts) or "FALSE") + ")"


def _in_sql(c: str, values) -> str:
    return f"{c} IN ({', '.join(repr(v) for v in values)})"


def _source_type_sql(p: str) -> str:
    whens = []
    for name, how, parts in ranking.SOURCE_TYPES:
        hits = [f"ends_with({p}, '{x}')" if how == "ends" else f"starts_with({p}, '{x}') OR contains({p}, '/{x}')" for x in parts]
        whens.append(f"WHEN {_any_sql(hits)} THEN '{name}'")
    return f"CASE {' '.join(whens)} ELSE 'default' END"


_QUIET_SQL = _any_sql([f"contains(p, '{x}')" for x in checks.QUIET_PARTS] + [f"starts_with(p, '{x}')" for x in checks.QUIET_BEGINNINGS])
_PATHS_SQL = rf"""WITH t AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[^A-Za-z0-9/]+', '_', 'g') AS seg FROM pages WHERE url IS NOT NULL),
r AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'src/' || seg || '.py' WHEN 1 THEN './docs/' || seg || '.md' WHEN 2 THEN 'a\' || replace(seg, '/', '\') WHEN 3 THEN '../' || seg WHEN 4 THEN split_part(seg, '/', 1) ELSE '/abs/' || seg || '.toml' END AS p FROM t),
f AS (SELECT *, regexp_replace(replace(trim(p), '\', '/'), '^([.]/)+', '') AS plain, regexp_extract(p, '[^/.][^/]*\.([^./]+)$', 1) AS ending, {ASCII_LOWER.format("p")} AS low FROM r)
SELECT page_id, plain AS plain_path, {_in_sql("p", ("AGENTS.md", "README.md", "Makefile"))} OR contains(p, '/') OR contains(p, '\') OR {_in_sql("ending", (*text.DOC_ENDINGS, *text.CODE_ENDINGS))} AS is_path,
  NOT regexp_matches(p, '[ :/]') AND regexp_matches(p, '^([A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)+|[A-Z][A-Za-z0-9_]+|[a-z][a-z0-9_]*_[a-z0-9_]+)$') AS is_symbol,
  starts_with(low, 'docs/') OR starts_with(low, '.agents/') OR {_in_sql("ending", text.DOC_ENDINGS)} AS is_doc,
  low = 'makefile' OR {_in_sql("ending", text.CODE_ENDINGS)} OR {_any_sql([f"starts_with(low, '{x}')" for x in text.CODE_ROOTS])} AS is_code, {_source_type_sql("plain")} AS source_type,
  p <> '' AND NOT starts_with(replace(p, '\', '/'), '/') AND NOT list_contains(string_split(replace(p, '\', '/'), '/'), '..') AS safe, NOT {_QUIET_SQL} AND starts_with(p, 'src/') AS asked, starts_with(p, 'src/') OR starts_with(p, './docs/') AS scoped,
  CASE WHEN trim({ASCII_LOWER.format("regexp_replace(p, '[^A-Za-z0-9_-]', '-', 'g')")}, '-') = '' THEN 'run' ELSE trim({ASCII_LOWER.format("regexp_replace(p, '[^A-Za-z0-9_-]', '-', 'g')")}, '-') END AS run_slug,
  CASE WHEN {_letters_sql("p")} = '' THEN 'citation_' || page_id ELSE {_letters_sql("p")} END AS citation_id FROM f"""


@register("path_forms", _PATHS_SQL)
def path_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of six kinds made of the urls of all pages, normalized and classified."""
    seg = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[^A-Za-z0-9/]+", "_")
    kinds = [F.concat(F.lit("src/"), seg, F.lit(".py")), F.concat(F.lit("./docs/"), seg, F.lit(".md")), F.concat(F.lit("a\\"), F.replace(seg, F.lit("/"), F.lit("\\"))), F.concat(F.lit("../"), seg), F.split_part(seg, F.lit("/"), F.lit(1))]
    p: Column = F.concat(F.lit("/abs/"), seg, F.lit(".toml"))
    for k, c in enumerate(kinds):
        p = F.when(F.col("page_id") % 6 == k, c).otherwise(p)
    r = table(spark, sf_dir, "pages").where("url is not null").select("page_id", p.alias("p"))
    return r.select(
        "page_id", text.plain_path("p").alias("plain_path"), text.looks_like_path("p").alias("is_path"), text.looks_like_symbol("p").alias("is_symbol"), text.is_doc_path("p").alias("is_doc"), text.is_code_path("p").alias("is_code"),
        ranking.source_type("p").alias("source_type"), files.safe_member("p").alias("safe"), checks.may_ask("p", ["src/"]).alias("asked"), checks.in_scope(["p"], ["src/", "./docs/"]).alias("scoped"),
        text.run_slug("p").alias("run_slug"), text.citation_id("p", F.col("page_id")).alias("citation_id"),
    )


_LINES_FORMS_SQL = rf"""WITH l AS (SELECT doc_id, line_no, trim(line) AS line FROM {LINES_SQL})
SELECT doc_id, line_no, lower(CASE WHEN contains(line, ',') THEN trim(trim(substr(line, strpos(line, ',') + 1)) || ' ' || trim(left(line, strpos(line, ',') - 1))) ELSE line END) AS author,
  array_to_string(list_filter(list_transform(string_split(line, ' and '), lambda a: trim(a)), lambda a: a <> ''), '|') AS authors,
  array_to_string(list_filter(list_transform(string_split(regexp_replace(line, '^\[|\]$', '', 'g'), ','), lambda a: trim(trim(a), '"''')), lambda a: a <> ''), '|') AS items,
  CASE WHEN length({_letters_sql("line")}) >= 3 THEN {_letters_sql("line")} END AS key, CASE WHEN contains(line, ':') THEN split_part(line, ':', 1) ELSE 'raw' END AS kind FROM l"""


@register("line_forms", _LINES_FORMS_SQL)
def line_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of all documents as an author, a list of authors, an inline list, a key and a reference."""
    lines = stats.lines_of(table(spark, sf_dir, "documents")).select("doc_id", "line_no", F.trim("line").alias("line"))
    joined = lambda c: F.array_join(c, "|")
    return lines.select("doc_id", "line_no", text.author_key("line").alias("author"), joined(text.split_authors("line")).alias("authors"), joined(text.inline_list("line")).alias("items"), text.long_key("line", 3, text.letters_of_text).alias("key"), text.reference_kind("line").alias("kind"))


_ANSWER = r"trim(regexp_replace(c, '(?s)<think>.*?</think>', '', 'g'))"
_ANSWERS_SQL = rf"""WITH t AS (SELECT conv_id, turn, role, '<think>' || role || chr(10) || '</think>```' || role || chr(10) || text || chr(10) || '```' AS c, text FROM conversations),
a AS (SELECT *, trim(split_part(trim(trim(trim(regexp_replace(regexp_replace({_ANSWER}, '^```[A-Za-z0-9_-]*\n', ''), '\n```$', '')), '`')), chr(10), 1)) AS answer FROM t)
SELECT conv_id, turn, answer, answer <> '' AND (contains(answer, 'the') OR contains(answer, 'Yes')) AS is_right, len(string_split(regexp_replace(text, '\n$', ''), chr(10))) AS lines, CASE WHEN role IN ('code', 'markdown') THEN role ELSE 'raw' END AS cell,
  CASE role WHEN 'critical' THEN 0 WHEN 'high' THEN 1 ELSE 4 END AS priority FROM a"""


@register("answer_forms", _ANSWERS_SQL)
def answer_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns as fenced answers behind a thought, freed of both and judged."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.concat(F.lit("<think>"), "role", F.lit("\n</think>```"), "role", F.lit("\n"), "text", F.lit("\n```")).alias("c"))
    accepted = F.array(F.lit("the"), F.lit("Yes"), F.lit(""))
    return t.select("conv_id", "turn", text.plain_answer("c").alias("answer"), text.answer_is_right(F.col("c"), accepted, F.lit("text")).alias("is_right"), text.line_count("text").cast("long").alias("lines"), text.cell_kind("role").alias("cell"), text.priority_rank("role").cast("long").alias("priority"))


@register("json_forms", """SELECT event_id, props AS found, '{"k":"' || json_extract_string(props, '$.k') || '","t":""}' AS map_ FROM events WHERE props IS NOT NULL""")
def json_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The properties of all events, found within other text, and with a null more as a map of texts."""
    e = table(spark, sf_dir, "events").where("props is not null")
    noisy, more = F.concat(F.lit("as asked: "), "props", F.lit(" -- done")), F.concat(F.rtrim(F.col("props"), F.lit("}")), F.lit(', "t": null}'))
    return e.select("event_id", text.json_object(noisy).alias("found"), F.to_json(text.string_map(more)).alias("map_"))
