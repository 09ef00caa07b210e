"""Quality rules by repetition coverage.

Words of whole texts are hashed with numpy from polynomial prefix sums over
their bytes; rolling hashes of several n-gram lengths follow from the word
hashes.  A text fails if too large a share of its characters lies inside
n-grams or lines that have stood in it before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import BASE, in_batches, mix, prefix_hash, read_table, run_hash, slices, text_buffers, within, words

#: Largest share of a text's word characters inside repeated n-grams, by n (twice the limits of the Gopher rules, so that one repeated line doesn't fail a short text).
NGRAM_LIMITS = {5: 0.30, 6: 0.28, 7: 0.26, 8: 0.24, 9: 0.22, 10: 0.20}
#: Largest shares of lines, and of word characters in lines, that repeat an earlier line.
LINE_LIMIT, LINE_CHARS_LIMIT = 0.40, 0.30
#: Most symbols for each word.
SYMBOLS_PER_WORD = 0.1
MIN_WORDS = 50

_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[list(b"#*$%&|<>")] = 1


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur more than once, and which have occurred before."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    many, again = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    again[order[1:]] = same
    many[order[1:]] = same
    many[order[:-1]] |= same
    return many, again


def _covered(at: np.ndarray, length: int, size: int) -> np.ndarray:
    """Marks of [i, i + length) for each i in ``at``."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """All counts of the texts that ``at`` cuts ``data`` into."""
    n_docs = len(at) - 1
    start, end, n_words = words(data, at)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = points[end] - points[start]
    first_word = np.concatenate([[0], np.cumsum(n_words)])
    char_sums = np.concatenate([[0], np.cumsum(chars)])
    doc_of = np.repeat(np.arange(n_docs), n_words)
    out = {"n_words": n_words, "word_chars": char_sums[first_word[1:]] - char_sums[first_word[:-1]]}
    out["n_symbols"] = within(at, np.concatenate([[0], np.cumsum(_SYMBOL[data], dtype=np.int64)]))

    prefix = prefix_hash(data)
    # lines: each text's first byte, and each byte after a line break of the same text, starts one
    breaks = np.flatnonzero(data == 10)
    owner = np.searchsorted(at, breaks, "right") - 1
    line_start = np.concatenate([at[:-1], breaks + 1])
    line_doc = np.concatenate([np.arange(n_docs), owner])
    order = np.lexsort((line_start, line_doc))
    line_start, line_doc = line_start[order], line_doc[order]
    line_end = np.concatenate([line_start[1:] - 1, at[-1:]])
    last = np.concatenate([line_doc[1:] != line_doc[:-1], [True]])[: len(line_doc)]
    line_end[last] = at[1:][line_doc[last]]
    w0, w1 = np.searchsorted(start, line_start), np.searchsorted(start, line_end)
    real = w1 > w0
    line_start, line_end, line_doc, w0, w1 = (x[real] for x in (line_start, line_end, line_doc, w0, w1))
    _, again = _repeats(mix(run_hash(prefix, line_start, line_end) + (line_doc.astype(np.uint64) + np.uint64(1)) * BASE))
    out["n_lines"] = np.bincount(line_doc, minlength=n_docs)
    out["n_dup_lines"] = np.bincount(line_doc[again], minlength=n_docs)
    out["dup_line_chars"] = np.bincount(line_doc[again], (char_sums[w1] - char_sums[w0])[again], n_docs).astype(np.int64)

    # n-grams: a repeated n-gram begins and ends with repeated shorter ones, so only those are hashed on
    h = run_hash(prefix, start, end)
    rolled, length = h + (doc_of.astype(np.uint64) + np.uint64(1)) * BASE, 1
    live = np.arange(len(h))
    for n in (3, *NGRAM_LIMITS):
        while length < n:
            rolled[:-length] = mix(rolled[:-length] * BASE + h[length:])
            length += 1
        live = live[live + n <= len(h)]
        live = live[doc_of[live] == doc_of[live + n - 1]]
        many, again = _repeats(rolled[live])
        if n == 3:
            out["n_repeat_words"] = np.bincount(doc_of[_covered(live[many], 3, len(h))], minlength=n_docs)
        else:
            inside = _covered(live[again], n, len(h))
            out[f"dup_{n}gram_chars"] = np.bincount(doc_of[inside], chars[inside], n_docs).astype(np.int64)
        live = live[many]
    return out


def judge(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base_failed, kept, and the largest share of a limit that repetition reaches."""
    base_failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    chars, lines, n = (np.maximum(m[c], 1) for c in ("word_chars", "n_lines", "n_words"))
    parts = [m[f"dup_{k}gram_chars"] / chars / limit for k, limit in NGRAM_LIMITS.items()]
    parts += [m["n_dup_lines"] / lines / LINE_LIMIT, m["dup_line_chars"] / chars / LINE_CHARS_LIMIT, m["n_symbols"] / n / SYMBOLS_PER_WORD]
    load = np.max(parts, axis=0)
    return base_failed, ~base_failed & (load <= 1), load


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, repetition`` for each row.

    Row by row, without a shuffle.  Null and empty texts have no words and
    fail; ids may be null or repeated; further columns are ignored; an empty
    table gives no rows.  ``repetition`` above 1 fails a text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                m = measure(*text_buffers(part.column(1)))
                verdicts = judge(m)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(m[c], pa.int64()) for c in _COUNTS), pa.array(verdicts[0]), pa.array(verdicts[1]), pa.array(verdicts[2], pa.float64())],
                    ["id", *_COUNTS, "base_failed", "kept", "repetition"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, {', '.join(f'{c} long' for c in _COUNTS)}, base_failed boolean, kept boolean, repetition double"
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).transform(in_batches(run, schema)).withColumnRenamed("id", id_col)


def op5_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents."""
    return judge_documents(read_table(spark, sf_dir, "documents"))


def _sql_ngrams() -> str:
    """Words' rows with a flag for each n: whether the n-gram that starts there repeats (for 3: stands twice or more), then whether it covers the word."""
    gram = {n: "concat_ws(' ', " + ", ".join("w" if k == 0 else f"lead(w, {k}) OVER o" for k in range(n)) + f") AS g{n}, lead(w, {n - 1}) OVER o IS NOT NULL AS whole{n}" for n in (3, *NGRAM_LIMITS)}
    again = {n: f"g.whole{n} AND row_number() OVER (PARTITION BY r, whole{n}, g{n} ORDER BY i) > 1 AS f{n}" for n in NGRAM_LIMITS}
    again[3] = "g.whole3 AND count(*) OVER (PARTITION BY r, whole3, g3) > 1 AS f3"
    inside = {n: f"bool_or(f{n}) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS in{n}" for n in again}
    return f"""
g AS (SELECT *, {", ".join(gram.values())} FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
f AS (SELECT r, i, w, {", ".join(again.values())} FROM g),
c AS (SELECT r, w, {", ".join(inside.values())} FROM f),
n AS (
  SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars, count(*) FILTER (in3) AS n_repeat_words,
    {", ".join(f"coalesce(sum(length(w)) FILTER (in{n}), 0) AS c{n}" for n in NGRAM_LIMITS)} FROM c GROUP BY r)"""


OP5_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT r, regexp_extract_all(text, '[^ 	-
]+') AS ws FROM d)),{_sql_ngrams()},
l AS (
  SELECT r, line, row_number() OVER (PARTITION BY r, line ORDER BY k) > 1 AS again
  FROM (SELECT r, unnest(ls) AS line, unnest(range(len(ls))) AS k FROM (SELECT r, string_split(text, chr(10)) AS ls FROM d)) WHERE regexp_matches(line, '[^ 	-
]')),
m AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (again) AS n_dup_lines, coalesce(sum(length(regexp_replace(line, '[ 	-
]+', '', 'g'))) FILTER (again), 0) AS line_chars FROM l GROUP BY r),
a AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, greatest(coalesce(n_lines, 0), 1) AS lines, coalesce(line_chars, 0) AS line_chars, {", ".join(f"coalesce(c{n}, 0) AS c{n}" for n in NGRAM_LIMITS)}
  FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)),
b AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, greatest(
    {", ".join(f"c{n}::DOUBLE / greatest(word_chars, 1) / {limit}::DOUBLE" for n, limit in NGRAM_LIMITS.items())},
    n_dup_lines::DOUBLE / lines / {LINE_LIMIT}::DOUBLE, line_chars::DOUBLE / greatest(word_chars, 1) / {LINE_CHARS_LIMIT}::DOUBLE, n_symbols::DOUBLE / greatest(n_words, 1) / {SYMBOLS_PER_WORD}::DOUBLE) AS repetition FROM a)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  base_failed, NOT base_failed AND repetition <= 1 AS kept, repetition FROM b
"""
