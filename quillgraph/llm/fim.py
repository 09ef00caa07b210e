"""Fill-in-middle transformation by a parallel automaton scan.

An automaton reads a text's bytes and keeps two things apart: whether a line
has begun, and how far into one of the marker strings the text is.  A chunk of
text doesn't know the state it is entered in, so it gives, for every state, the
state it is left in and how many lines begin in it.  Such functions compose
associatively: bytes to chunks, chunks to blocks, blocks to the document, and
back down each chunk learns the state it is entered in and the lines before it.
A cut after k lines is then looked for in one chunk alone.

Texts of up to GIANT bytes are one chunk each.  Longer ones are dealt out as
chunks over all tasks; only their functions meet, and only the chunks with a
cut are read again.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, read_table, slices, text_buffers

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PERCENT, SPM_PERCENT, SEED = 100, 50, 7
#: Bytes from which on a text is dealt out, of a chunk, and chunks of a block.
GIANT, CHUNK, BLOCK = 4 << 20, 1 << 20, 64

# Classes of bytes: line break, the three that markers are made of, all others.
_BREAK, _OPEN, _NAME, _CLOSE, _OTHER = range(5)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[ord("\n"), ord("<"), ord(">")]] = _BREAK, _OPEN, _CLOSE
_CLASS[[ord(m[1]) for m in (PREFIX, SUFFIX, MIDDLE)]] = _NAME

#: State: within a line or not, times how much of a marker stands before (nothing, "<", "<P", a whole one somewhere).
WITHIN, FOUND = 4, 3
STATES = 8


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each class and state, the next state and the lines that begin."""
    after, begun = np.zeros((5, STATES), np.int8), np.zeros((5, STATES), np.int32)
    for kind in range(5):
        for state in range(STATES):
            within, marker = divmod(state, WITHIN)
            if marker != FOUND:
                marker = 1 if kind == _OPEN else 2 if kind == _NAME and marker == 1 else FOUND if kind == _CLOSE and marker == 2 else 0
            after[kind, state] = WITHIN * (kind != _BREAK) + marker
            begun[kind, state] = not within
    return after, begun


_AFTER, _BEGUN = _tables()


def transitions(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text that ``at`` cuts ``data`` into and each state it may be entered in: the state it is left in, and the lines that begin.

    Bytes are composed pairwise, then the pairs, and so on; a run of bytes of
    no class of their own does what one of them does.
    """
    kinds = _CLASS[data]
    keep = np.ones(len(data), bool)
    keep[1:] = (kinds[1:] != _OTHER) | (kinds[:-1] != _OTHER)
    size = np.diff(at)
    keep[at[:-1][size > 0]] = True
    event = np.flatnonzero(keep)
    text = np.searchsorted(at, event, "right") - 1
    after, begun = _AFTER[kinds[event]], _BEGUN[kinds[event]]
    while len(text) and (text[1:] == text[:-1]).any():
        place = np.arange(len(text)) - np.searchsorted(text, text)
        left = np.flatnonzero(place % 2 == 0)
        paired = np.zeros(len(left), bool)
        inner = left < len(text) - 1
        paired[inner] = text[left[inner]] == text[left[inner] + 1]
        first, second = left[paired], left[paired] + 1
        through = after[first].astype(np.intp)
        new_begun, new_after = begun[left], after[left]
        new_begun[paired] += np.take_along_axis(begun[second], through, 1)
        new_after[paired] = np.take_along_axis(after[second], through, 1)
        after, begun, text = new_after, new_begun, text[left]
    all_after = np.tile(np.arange(STATES, dtype=np.int8), (len(size), 1))
    all_begun = np.zeros((len(size), STATES), np.int64)
    all_after[text], all_begun[text] = after, begun
    return all_after, all_begun


def _draws(doc_id: Column, seed: int, percent: int, spm_percent: int) -> list[Column]:
    """Two draws for the cuts and the form that a text gets if it can be cut, by a hash of its id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    return [h[0].alias("h1"), h[1].alias("h2"), F.when(h[2] % 100 >= percent, "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm").alias("wish")]


def _whole_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of id, text, h1, h2, wish transformed; each text is a chunk of its own."""
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    for batch in batches:
        for part in slices(batch, "text"):
            data, at = text_buffers(part.column(1))
            after, begun = transitions(data, at)
            n, start, end = begun[:, 0], at[:-1], at[1:]
            h1, h2 = (np.asarray(part.column(k)) for k in (2, 3))
            breaks = np.append(np.flatnonzero(data == 10) + 1, 0)
            before = np.searchsorted(breaks[:-1], start, "right")

            def offset(units: np.ndarray) -> np.ndarray:
                """Where the given number of lines of each text ends."""
                inner = breaks[np.clip(before + units - 1, 0, len(breaks) - 1)]
                return np.where(units == 0, start, np.where(units >= n, end, inner))

            one, two = offset(np.minimum(h1 % (n + 1), h2 % (n + 1))), offset(np.maximum(h1 % (n + 1), h2 % (n + 1)))
            chars = np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80)])
            form = np.where((start == end) | (after[:, 0] % WITHIN == FOUND), "plain", np.asarray(part.column(4).to_pylist(), object))
            raw, out = data.tobytes(), []
            for how, a, b, c, d in zip(form, start.tolist(), one.tolist(), two.tolist(), end.tolist()):
                if how == "plain":
                    out.append(raw[a:d])
                elif how == "psm":
                    out.append(b"".join((p, raw[a:b], s, raw[c:d], m, raw[b:c])))
                else:
                    out.append(b"".join((s, raw[c:d], p, raw[a:b], m, raw[b:c])))
            plain = form == "plain"
            counts = [pa.array(x, pa.int64(), mask=plain) for x in (chars[one] - chars[start], chars[two] - chars[one])]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(form, pa.string()), *counts, pa.array(out, pa.string())], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])


def _chunk_functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of id, digest, chunk, bytes as the chunk's function."""
    for batch in batches:
        data, at = text_buffers(batch.column(3))
        after, begun = transitions(data, at)
        lists = [pa.array(x.tolist(), pa.list_(t)) for x, t in ((after, pa.int32()), (begun, pa.int64()))]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), *lists], ["id", "digest", "chunk", "after", "begun"])


def _identity() -> Column:
    return F.struct(F.array(*[F.lit(s) for s in range(STATES)]).alias("after"), F.array(*[F.lit(0).cast("long")] * STATES).alias("begun"))


def _compose(f: Column, g: Column) -> Column:
    """First ``f``, then ``g``."""
    return F.struct(
        F.transform(f.after, lambda s: F.get(g.after, s)).alias("after"),
        F.zip_with(f.after, f.begun, lambda s, n: n + F.get(g.begun, s)).alias("begun"),
    )


def _composed(items: Column) -> Column:
    return F.aggregate(items, _identity(), _compose)


def _holder(items: Column, units: Column, state: Column, before: Column) -> Column:
    """The item in which the line after ``units`` lines begins: ``item, state, before``, null if none does; the first is entered in ``state`` after ``before`` lines."""
    start = F.struct(state.alias("state"), before.alias("before"), F.lit(0).alias("at"), F.lit(False).alias("held"))

    def step(acc: Column, item: Column) -> Column:
        begun = acc.before + F.get(item.begun, acc.state)
        here = acc.held | (units < begun)
        return F.struct(F.when(here, acc.state).otherwise(F.get(item.after, acc.state)).alias("state"), F.when(here, acc.before).otherwise(begun).alias("before"), (acc.at + F.when(here, 0).otherwise(1)).alias("at"), here.alias("held"))

    return F.aggregate(items, start, step, lambda acc: F.when(acc.held, F.struct(F.get(items, acc.at).alias("item"), acc.state.alias("state"), acc.before.alias("before"))))


def _giant_texts(texts: DataFrame, chunk: int) -> DataFrame:
    """As _whole_texts, for texts that are dealt out in chunks.

    A row of Spark holds at most 2 GB, so a document has at most 2048 chunks of
    a megabyte and 32 blocks.  Rows with the same id and text share their
    chunks' functions.
    """
    g = texts.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256)).withColumn("bytes", F.col("text").cast("binary"))
    starts = F.sequence(F.lit(0), F.expr(f"(octet_length(text) - 1) div {chunk}").cast("int"))
    pieces = g.select("id", "digest", F.posexplode(F.transform(starts, lambda c: F.substring(F.col("bytes"), c * chunk + 1, F.lit(chunk)))).alias("chunk", "piece"))
    kind = texts.schema["id"].dataType.simpleString()
    functions = pieces.repartition("digest", "chunk").transform(in_batches(_chunk_functions, f"id {kind}, digest string, chunk int, after array<int>, begun array<long>"))
    parts = functions.groupBy("id", "digest", F.expr(f"chunk div {BLOCK}").alias("block")).agg(F.array_sort(F.collect_set(F.struct("chunk", "after", "begun"))).alias("parts"))
    whole = _composed(F.col("parts"))
    blocks = parts.withColumn("whole", whole).select("id", "digest", F.struct("block", F.col("whole.after").alias("after"), F.col("whole.begun").alias("begun"), "parts").alias("b"))
    docs = blocks.groupBy("id", "digest").agg(F.array_sort(F.collect_list("b")).alias("blocks")).withColumn("total", _composed(F.col("blocks")))
    docs = docs.select(F.col("id").alias("doc"), F.col("digest").alias("doc_digest"), "blocks", F.get("total.begun", F.lit(0)).alias("n"), (F.get("total.after", F.lit(0)) % WITHIN == FOUND).alias("marked"))
    j = g.join(docs, F.col("id").eqNullSafe(F.col("doc")) & (F.col("digest") == F.col("doc_digest")))
    first, second = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    j = j.withColumn("a", F.least(first, second)).withColumn("b", F.greatest(first, second))
    for k in ("a", "b"):
        j = j.withColumn("block", _holder(F.col("blocks"), F.col(k), F.lit(0), F.lit(0).cast("long")))
        j = j.withColumn("held", _holder(F.col("block.item.parts"), F.col(k), F.col("block.state"), F.col("block.before")))
        # a chunk that is entered within a line begins its first one after a break
        skip = (F.col(k) - F.col("held.before") + F.when(F.col("held.state") >= WITHIN, 1).otherwise(0)).cast("int")
        base = F.col("held.item.chunk") * chunk
        piece = F.substring(F.col("bytes"), base + 1, F.lit(chunk)).cast("string")
        inner = F.when(skip > 0, F.octet_length(F.call_function("substring_index", piece, F.lit("\n"), skip)) + 1).otherwise(0)
        j = j.withColumn(f"{k}_at", F.when(F.col("held").isNull(), F.octet_length("text")).otherwise(base + inner)).drop("block", "held")
    cut = lambda start, end: F.substring(F.col("bytes"), start + 1, end - start).cast("string")
    j = j.withColumn("form", F.when(F.col("marked"), "plain").otherwise(F.col("wish")))
    j = j.withColumn("prefix", cut(F.lit(0), F.col("a_at"))).withColumn("middle", cut(F.col("a_at"), F.col("b_at"))).withColumn("suffix", cut(F.col("b_at"), F.octet_length("text")))
    counted = [F.when(F.col("form") != "plain", F.char_length(c).cast("long")).alias(f"{c}_chars") for c in ("prefix", "middle")]
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    return j.select("id", "n", "form", *counted, F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text")).alias("output"))


def fill_in_middle(docs: DataFrame, percent: int = PERCENT, spm_percent: int = SPM_PERCENT, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """Texts with their middle moved to the end: ``id_col, n, form, prefix_chars, middle_chars, output``.

    ``n`` lines (runs up to and with a line break) are cut at two places that a
    hash of the id draws.  ``form`` is psm, spm or plain: ``percent`` of the
    texts that can be cut are, ``spm_percent`` of these with the suffix first.
    A text that is empty or has one of the marker strings stays plain, and its
    two counts (of code points) are null.

    A null text counts as an empty one, a null id is drawn for as an empty
    string; repeated rows are all returned; rows of one id but different texts
    get the same draws; further columns, whatever their names, are ignored; an
    empty table gives no rows.  ``giant`` and ``chunk`` only say how the work
    is dealt out.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    texts = docs.select(docs[id_col].alias("id"), text.alias("text"), *_draws(docs[id_col], seed, percent, spm_percent))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    usual = texts.where(F.octet_length("text") <= giant).transform(in_batches(_whole_texts, schema))
    return usual.unionByName(_giant_texts(texts.where(F.octet_length("text") > giant), chunk)).withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of fill_in_middle() was made from."""
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    order = {"psm": (1, 3, 2), "spm": (2, 3, 1)}
    joined = [F.when(form == how, F.concat(*[F.get(parts, F.lit(k)) for k in places])) for how, places in order.items()]
    return functools.reduce(lambda a, b: F.coalesce(a, b), joined + [output])


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, cut and rearranged, with digests of the output and of the text rebuilt from it."""
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    made = fill_in_middle(read_table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


_NUMBER = "CAST('0x' || substr(h, {0}, 8) AS BIGINT)"
OP11_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS lines, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (SELECT *, len(lines) AS n, {_NUMBER.format(1)} AS h1, {_NUMBER.format(9)} AS h2, {_NUMBER.format(17)} AS h3, {_NUMBER.format(25)} AS h4 FROM d),
cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {PERCENT} THEN 'plain' WHEN h4 % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, array_to_string(lines[1:a], '') AS prefix, array_to_string(lines[a + 1:b], '') AS middle, array_to_string(lines[b + 1:n], '') AS suffix FROM cuts)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
