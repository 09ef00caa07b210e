"""Scalar text functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_lower(c: Column | str) -> Column:
    """Lower case for A-Z alone; other letters stay."""
    return F.translate(col(c), _UPPER, _LOWER)


def blank_to_null(c: Column | str) -> Column:
    c = col(c)
    return F.when(F.trim(c) != "", c)


def slugify(c: Column | str) -> Column:
    """ASCII letters and digits in lower case, each other run as one dash, none at the ends."""
    return F.btrim(ascii_lower(F.regexp_replace(col(c), "[^A-Za-z0-9]+", "-")), F.lit("-"))


def run_slug(c: Column | str) -> Column:
    """As slugify(), but ``-`` and ``_`` stay, each other character is a dash of its own, and nothing becomes ``run``."""
    s = F.btrim(ascii_lower(F.regexp_replace(col(c), "[^A-Za-z0-9_-]", "-")), F.lit("-"))
    return F.when(s == "", "run").otherwise(s)


def letters_key(c: Column | str) -> Column:
    """ASCII letters and digits alone, in lower case: the key of titles and citations."""
    # nothing but ASCII is left, so lower() does the same as ascii_lower() and far faster
    return F.lower(F.regexp_replace(col(c), "[^A-Za-z0-9]+", ""))


_ASCII_WORD = (_UPPER + _LOWER + "0123456789").encode()
_TO_LOWER, _NO_WORD = bytes.maketrans(_UPPER.encode(), _LOWER.encode()), bytes(k for k in range(256) if k not in _ASCII_WORD)


@F.arrow_udf(StringType())
def _letters(texts: pa.Array) -> pa.Array:
    found = [None if t is None else t.translate(_TO_LOWER, _NO_WORD) for t in texts.cast(pa.binary()).to_pylist()]
    return pa.array(found, pa.binary()).cast(pa.string())


def letters_of_text(c: Column | str) -> Column:
    """letters_key() of long texts, where an expression costs far more than the way to Python."""
    return _letters(col(c))


def long_key(c: Column | str, least: int, letters: Callable[[Column | str], Column] = letters_key) -> Column:
    """letters_key(), null if shorter than ``least``: 12 for titles, 3 for citation keys."""
    # as an element the key is computed once
    return F.get(F.filter(F.array(letters(c)), lambda k: F.length(k) >= least), F.lit(0))


def citation_id(c: Column | str, index: Column) -> Column:
    k = letters_key(c)
    return F.when(k == "", F.concat(F.lit("citation_"), index.cast("string"))).otherwise(k)


def doi_identity(c: Column | str) -> Column:
    """A DOI for identity: one resolver prefix off, slashes off the ends; null stays null."""
    s = F.lower(F.trim(col(c)))
    return F.btrim(F.regexp_replace(s, "^(https://doi.org/|http://doi.org/|doi:)", ""), F.lit("/"))


def doi_link(c: Column | str) -> Column:
    """A DOI for links between documents: resolver prefixes and closing full stops off; null unless it starts with ``10.``."""
    s = F.rtrim(F.trim(F.regexp_replace(F.trim(col(c)), "^((https?://(dx[.])?doi.org/)|doi:|DOI:)+", "")), F.lit("."))
    return F.when(F.startswith(s, F.lit("10.")), F.lower(s))


def doi_in_text(c: Column | str) -> Column:
    """The first DOI within free text."""
    s = F.regexp_extract(col(c), r"10\.\d{4,9}/[^\s{}]+", 0)
    return F.when(s != "", F.lower(F.rtrim(s, F.lit(".,;"))))


def arxiv_identity(c: Column | str) -> Column:
    """The bare number of an arXiv id; ids of the old form lose prefix and version."""
    c = col(c)
    new = F.regexp_extract(c, r"\d{4}\.\d{4,5}", 0)
    old = F.regexp_extract(F.regexp_replace(F.lower(F.trim(c)), "^arxiv:", ""), "^[^v]*", 0)
    return F.when(new != "", new).otherwise(old)


def arxiv_link(c: Column | str) -> Column:
    """An arXiv id with its version; null unless it starts with a digit and has a full stop."""
    s = F.regexp_replace(F.trim(col(c)), "^(https?://arxiv.org/(abs|pdf)/|arXiv:|arxiv:)", "")
    s = F.regexp_replace(s, "[.]pdf$", "")
    return F.when(F.regexp_like(s, F.lit("^[0-9]")) & F.contains(s, F.lit(".")), s)


def arxiv_in_text(c: Column | str) -> Column:
    s = F.regexp_extract(col(c), r"(?:arXiv:)?(\d{4}\.\d{4,5}(?:v\d+)?)", 1)
    return F.when(s != "", s)


def author_key(c: Column | str) -> Column:
    """``Family, Given`` as ``given family`` in lower case."""
    c = F.trim(col(c))
    family = F.substring_index(c, ",", 1)
    turned = F.concat(F.trim(F.substring(c, F.length(family) + 2, F.length(c))), F.lit(" "), F.trim(family))
    return F.lower(F.when(F.contains(c, F.lit(",")), F.trim(turned)).otherwise(c))


def split_authors(c: Column | str) -> Column:
    return F.filter(F.transform(F.split(col(c), " and "), lambda a: F.trim(a)), lambda a: a != "")


def paper_id(citation_key: Column, arxiv: Column, title: Column) -> Column:
    return F.when(blank_to_null(citation_key).isNotNull(), slugify(citation_key)).when(blank_to_null(arxiv).isNotNull(), F.concat(F.lit("arxiv-"), slugify(arxiv))).otherwise(slugify(title))


def squeeze(c: Column | str) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def clip_dots(c: Column | str, n: int) -> Column:
    """At most ``n`` characters, then three dots."""
    c = col(c)
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def clip_ellipsis(c: Column | str, n: int) -> Column:
    """At most ``n`` characters, the last one an ellipsis if some are cut."""
    c = col(c)
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n - 1)), F.lit("…"))).otherwise(c)


# Words that tell topics nothing.
STOPWORDS = (
    "about", "after", "algorithm", "algorithms", "also", "among", "because", "before", "being", "between", "conclusion", "conclusions", "content", "dataset",
    "datasets", "discussion", "during", "each", "experiments", "figure", "figures", "from", "have", "into", "introduction", "method", "methods", "model",
    "models", "paper", "propose", "proposed", "results", "section", "study", "table", "tables", "their", "these", "this", "through", "using", "with",
)


def topic_tokens(c: Column | str) -> Column:
    """Distinct topic words: ASCII runs of at least four characters in lower case, no numbers, no stopwords."""
    # words are put in lower case one by one: they are ASCII, the text need not be
    raw = F.filter(F.split(col(c), "[^A-Za-z0-9]+"), lambda t: (F.length(t) >= 4) & F.regexp_like(t, F.lit("[A-Za-z]")))
    return F.filter(F.array_distinct(F.transform(raw, lambda t: F.lower(t))), lambda t: ~t.isin(*STOPWORDS))


def task_terms(c: Column | str) -> Column:
    """Distinct words of a task of at least three characters, in order."""
    return F.array_sort(F.array_distinct(F.filter(F.split(ascii_lower(c), "[^a-z0-9]+"), lambda t: F.length(t) >= 3)))


def query_terms(c: Column | str) -> Column:
    return F.filter(F.split(F.lower(col(c)), r"[\s|]+"), lambda t: t != "")


# Short words that embedding texts keep.
SHORT_TOKENS = ("kg", "tex", "bib")


def embedding_tokens(c: Column | str) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(col(c)), "[^A-Za-z0-9_]+"), lambda t: (F.length(t) >= 3) | t.isin(*SHORT_TOKENS)))


def plain_path(c: Column | str) -> Column:
    """Forward slashes, no leading ``./``."""
    return F.regexp_replace(F.replace(F.trim(col(c)), F.lit("\\"), F.lit("/")), "^([.]/)+", "")


# Endings of files that count as documents and as code.
DOC_ENDINGS = ("md", "qmd", "rst", "txt", "typ", "pdf", "bib")
CODE_ENDINGS = ("rs", "py", "sh", "toml", "yaml", "yml", "json", "jsonl", "ipynb", "js", "ts", "tsx", "jsx")
CODE_ROOTS = ("src/", "crates/", "scripts/", "python/", "tests/", "examples/")


def ending(c: Column | str) -> Column:
    return F.regexp_extract(col(c), r"[^/.][^/]*\.([^./]+)$", 1)


def looks_like_path(c: Column | str) -> Column:
    s = F.trim(col(c))
    return s.isin("AGENTS.md", "README.md", "Makefile") | F.contains(s, F.lit("/")) | F.contains(s, F.lit("\\")) | ending(s).isin(*DOC_ENDINGS, *CODE_ENDINGS)


def looks_like_symbol(c: Column | str) -> Column:
    s = F.trim(col(c))
    shape = r"^([A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)+|[A-Z][A-Za-z0-9_]+|[a-z][a-z0-9_]*_[a-z0-9_]+)$"
    return ~F.regexp_like(s, F.lit("[ :/]")) & F.regexp_like(s, F.lit(shape))


def is_doc_path(c: Column | str) -> Column:
    low = ascii_lower(c)
    return F.startswith(low, F.lit("docs/")) | F.startswith(low, F.lit(".agents/")) | ending(c).isin(*DOC_ENDINGS)


def is_code_path(c: Column | str) -> Column:
    low = ascii_lower(c)
    found = (low == "makefile") | ending(c).isin(*CODE_ENDINGS)
    for root in CODE_ROOTS:
        found = found | F.startswith(low, F.lit(root))
    return found


# Patterns of links, code spans, citation keys, arXiv ids and directives in Markdown.
LINK = r"\[[^\]]+\]\(([^)]+)\)"
CODE_SPAN = r"`([^`\n]+)`"
CITATION_KEY = r"@([A-Za-z][A-Za-z0-9:_-]+)"
ARXIV_ID = r"\b(\d{4}\.\d{4,5}(?:v\d+)?)\b"
SUPERSEDES = r"<!--\s*supersedes:\s*(.*?)\s*-->"


def found_all(c: Column | str, pattern: str) -> Column:
    return F.regexp_extract_all(col(c), F.lit(pattern), 1)


def external_paper_id(s2: Column, doi: Column, arxiv: Column) -> Column:
    """The id by which a metadata service knows a paper: its own, else the DOI, else the arXiv id."""
    t = lambda c: blank_to_null(F.trim(c))
    return F.coalesce(t(s2), F.concat(F.lit("DOI:"), t(doi)), F.concat(F.lit("ARXIV:"), t(arxiv)))


def encode_segment(c: Column | str) -> Column:
    """Percent encoding of a URL path segment."""
    return F.replace(F.replace(F.url_encode(col(c)), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))


def priority_rank(c: Column | str) -> Column:
    c = col(c)
    return F.when(c.isin("critical", "P0"), 0).when(c.isin("high", "P1"), 1).when(c.isin("medium", "P2"), 2).when(c.isin("low", "P3"), 3).otherwise(4)


def reference_kind(c: Column | str) -> Column:
    c = col(c)
    return F.when(F.contains(c, F.lit(":")), F.substring_index(c, ":", 1)).otherwise("raw")


def cell_kind(c: Column | str) -> Column:
    c = col(c)
    return F.when(c.isin("code", "markdown"), c).otherwise("raw")


def plain_answer(c: Column | str) -> Column:
    """An answer without thoughts, fences and back quotes; its first line."""
    s = F.trim(F.regexp_replace(col(c), r"(?s)<think>.*?</think>", ""))
    s = F.regexp_replace(F.regexp_replace(s, r"^```[A-Za-z0-9_-]*\n", ""), r"\n```$", "")
    s = F.trim(F.btrim(F.trim(s), F.lit("`")))
    return F.trim(F.substring_index(s, "\n", 1))


def answer_is_right(answer: Column, accepted: Column, kind: Column) -> Column:
    """Whether an answer is one of the accepted ones or contains one that isn't empty."""
    norm = lambda c: F.when(kind == "command", squeeze(plain_answer(c))).otherwise(plain_answer(c))
    a = norm(answer)
    return (a != "") & F.exists(F.transform(accepted, norm), lambda v: (a == v) | ((v != "") & F.contains(a, v)))


def inline_list(c: Column | str) -> Column:
    """``[a, "b"]`` as an array."""
    whole = F.trim(col(c))
    tail = F.when(F.startswith(whole, F.lit("[")), F.substring(whole, F.lit(2), F.length(whole))).otherwise(whole)
    # not an expression: its $ would also stand before a carriage return
    inner = F.when(F.endswith(tail, F.lit("]")), F.left(tail, F.length(tail) - 1)).otherwise(tail)
    return F.filter(F.transform(F.split(inner, ","), lambda x: F.btrim(F.trim(x), F.lit("\"'"))), lambda x: x != "")


def line_count(c: Column | str) -> Column:
    return F.greatest(F.lit(1), F.size(F.split(F.regexp_replace(col(c), r"\n\z", ""), "\n")))


def remote_repo(c: Column | str) -> Column:
    """``owner/name`` of a GitHub remote."""
    s = F.regexp_extract(F.trim(col(c)), r"^(?:git@github\.com:|ssh://git@github\.com/|https?://github\.com/)([^/]+/[^/]+?)(?:\.git)?/?$", 1)
    return F.when(s != "", s)


def json_object(c: Column | str) -> Column:
    """The JSON object in a noisy text: the whole of it, else what lies between the outer braces; as text."""
    c = F.trim(col(c))
    inner = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    whole = lambda t: F.when(F.schema_of_variant(F.try_parse_json(t)).startswith("OBJECT"), t)
    return F.coalesce(whole(c), whole(inner))


def string_map(c: Column | str) -> Column:
    """A JSON object as map of strings; null values become empty."""
    return F.transform_values(F.from_json(col(c), "map<string,string>"), lambda _, v: F.coalesce(v, F.lit("")))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two vectors of equal length; 0 if one is empty or has no length."""
    a, b = col(a), col(b)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def snippet(c: Column | str, query: str, n: int = 160) -> Column:
    """The first line that has the query, else the text; white space squeezed; clipped."""
    c = col(c)
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & F.contains(F.lower(x), F.lit(query.lower())))
    return clip_dots(squeeze(F.coalesce(F.get(lines, F.lit(0)), c)), n)
