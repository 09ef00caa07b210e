"""Language identification with error-correcting output codes.

Each language has a codeword of bits.  One binary classifier over hashed byte
n-grams predicts each bit; decoding weighs each bit's loss by how surely that
bit's classifier tells texts of the language that it hasn't learned from, and
takes the codeword of least loss.  Texts whose two nearest codewords are close
are flagged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held_out, in_batches, read_table, slices, text_buffers, within

DIM = 4096
NGRAMS = (2, 3, 4)
#: Training documents of each language and of all together; what is learned from is a bounded sample, of which every language has a share.
PER_LANG, LEARNED = 500, 8000
#: Rows whose features stand in memory at a time.
ROWS = 512
RIDGE, FOLDS = 0.05, 4
SHARPNESS = 8.0
AMBIGUOUS_BELOW = 0.6

_LETTER = np.zeros(256, np.uint8)
_LETTER[[*range(65, 91), *range(97, 123)]] = 1
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashed n-gram counts of each text: square roots, at unit length."""
    n = len(at) - 1
    x = np.zeros((n, DIM), np.float32)
    if not len(data):
        return x
    folded = _FOLD[data].astype(np.uint32)
    doc = np.repeat(np.arange(n), np.diff(at))
    gram = folded.copy()
    for k in range(2, max(NGRAMS) + 1):
        gram = gram[:-1] * np.uint32(0x01000193) ^ folded[k - 1 :]
        if k not in NGRAMS or not len(gram):
            continue
        inside = doc[: len(gram)] == doc[k - 1 :]
        slot = ((gram * np.uint32(0x9E3779B1)) >> np.uint32(20)).astype(np.int64)
        x += np.bincount((doc[: len(gram)] * DIM + slot)[inside], minlength=n * DIM).reshape(n, DIM)
    np.sqrt(x, out=x)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def has_letter(part: pa.Array, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    found = within(at, np.concatenate([[0], np.cumsum(_LETTER[data], dtype=np.int64)])) > 0
    for i in np.flatnonzero(~found & (np.diff(at) > 0)):
        found[i] = any(map(str.isalpha, part[int(i)].as_py()))
    return found


def codewords(n: int) -> np.ndarray:
    """Codewords of +1 and -1, a row for each class: the exhaustive code for up to 6 classes, else the best of many random codes."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 6:
        bits = np.arange(1, 2 ** (n - 1))
        code = np.ones((n, len(bits)))
        for row in range(1, n):
            code[row] = np.where(bits >> (row - 1) & 1, -1, 1)
        return code
    rng, best, width = np.random.default_rng(11), None, int(np.ceil(10 * np.log2(n)))
    for _ in range(100):
        code = rng.choice([-1.0, 1.0], (n, width))
        apart = (width - code @ code.T) / 2 + np.eye(n) * width
        if abs(code.sum(0)).max() < n and (best is None or apart.min() > best[0]):
            best = (apart.min(), code)
    return best[1]


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # class x bit
    weights: np.ndarray  # feature x bit
    bias: np.ndarray
    trust: np.ndarray  # class x bit

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class, score and whether it is ambiguous."""
        margin = x @ self.weights + self.bias
        loss = np.stack([(np.log1p(np.exp(-4 * margin * c)) * t).sum(1) for c, t in zip(self.code, self.trust)], 1)
        p = np.exp(-SHARPNESS * (loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        score = p.max(1)
        return p.argmax(1), score, score < AMBIGUOUS_BELOW


def _ridge(x: np.ndarray, target: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of all bits at once, from one system in the smaller of rows and features; ``cost`` is a row's share of the penalty."""
    one = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    if len(x) <= x.shape[1]:
        alpha = np.linalg.solve((one @ one.T).astype(np.float64) + np.diag(RIDGE * cost), target)
        both = one.T @ alpha.astype(x.dtype)
    else:
        gram = (one.T @ (one / cost[:, None].astype(x.dtype))).astype(np.float64)
        gram[np.diag_indices_from(gram)] += RIDGE
        both = np.linalg.solve(gram, one.T.astype(np.float64) @ (target / cost[:, None]))
    return both[:-1].astype(np.float32), both[-1].astype(np.float64)


def _chance(margin: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Chance that a classifier's margin gives to the bits."""
    return 1 / (1 + np.exp(-4 * margin * bits))


def fit(x: np.ndarray, y: np.ndarray, langs: list[str]) -> Model:
    """Ridge classifiers of all bits, in which all languages weigh alike, and the mean chance that those of the other folds give to a language's bits."""
    code = codewords(len(langs))
    target, share = code[y], np.bincount(y, minlength=len(langs))
    cost = share[y] * len(langs) / len(y)
    sure = np.zeros(code.shape)
    fold = np.arange(len(y)) % FOLDS
    for k in range(FOLDS):
        rest = fold != k
        if rest.any() and not rest.all():
            weights, bias = _ridge(x[rest], target[rest], cost[rest])
            np.add.at(sure, y[~rest], _chance(x[~rest] @ weights + bias, target[~rest]))
    trust = (sure + 0.5) / (share[:, None] + 1)
    return Model(langs, code, *_ridge(x, target, cost), trust / trust.sum(1, keepdims=True))


def train(docs: DataFrame, per_lang: int = PER_LANG) -> Model | None:
    """Learn from at most ``per_lang`` documents of each language (fewer if there are many languages), none of them held out; None if there are none.

    Documents are drawn by a hash of id and text, so ids that many rows share
    don't come or go together; of equal rows of one id one counts.  Every
    language with a text that has a letter is learned.
    """
    text = F.col("text").cast("string")
    usable = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.regexp_like(text, F.lit(r"\p{L}"))).select("lang", text.alias("text"), F.xxhash64("doc_id", text, F.lit(5)).alias("key"))
    counts = usable.groupBy("lang").agg(F.approx_count_distinct("key").alias("count")).collect()  # a row for each language
    if not counts:
        return None
    per_lang = min(per_lang, max(1, LEARNED // len(counts)))
    most = math.ceil(1.2 * per_lang) + 8
    langs = sorted(r["lang"] for r in counts)
    # rows of a language come with this chance, so many that fewer than most of them don't happen
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(1.0, 1.5 * (most + 30) / r["count"]))])
    drawn = usable.withColumn("u", F.pmod("key", F.lit(1 << 30)) / F.lit(float(1 << 30))).where(F.col("u") < share[F.col("lang")]).dropDuplicates(["lang", "key"])
    sample = drawn.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("u", "key"))).where(F.col("place") <= most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", ROWS):
                data, at = text_buffers(part.column("text"))
                x = features(data, at).astype(np.float16)
                ok = has_letter(part.column("text"), data, at)
                yield pa.RecordBatch.from_arrays([part.column("u").filter(pa.array(ok)), part.column("lang").filter(pa.array(ok)), pa.array([r.tobytes() for r in x[ok]], pa.binary())], ["u", "lang", "x"])

    rows = sample.select("u", "lang", "text").transform(in_batches(run, "u double, lang string, x binary")).collect()
    rows.sort(key=lambda r: (r["u"], r["lang"], bytes(r["x"])))
    kept, seen = [], dict.fromkeys(langs, 0)
    for r in rows:
        if seen[r["lang"]] < per_lang:
            seen[r["lang"]] += 1
            kept.append(r)
    if not kept:
        return None
    langs = [x for x in langs if seen[x]]
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in kept]).astype(np.float32)
    return fit(x, np.array([langs.index(r["lang"]) for r in kept]), langs)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, lang_pred, score, ambiguous`` for each row of (doc_id, text).

    Texts that are null or have no letter, and all texts where nothing could
    be learned, are ``und`` with score 0.  Rows may repeat; further columns
    are ignored; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for part in slices(batch, "text", ROWS):
                data, at = text_buffers(part.column("text"))
                known = has_letter(part.column("text"), data, at) if m else np.zeros(part.num_rows, bool)
                lang, score, doubt = np.full(part.num_rows, "und", object), np.zeros(part.num_rows), np.ones(part.num_rows, bool)
                if known.any():
                    best, p, flag = m.predict(features(data, at))
                    lang[known], score[known], doubt[known] = np.array(m.langs, object)[best[known]], p[known], flag[known]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(doubt)], ["doc_id", "lang_pred", "score", "ambiguous"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).transform(in_batches(run, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of documents."""
    docs = read_table(spark, sf_dir, "documents")
    return identify(docs, train(docs)).withColumn("held_out", held_out(F.col("doc_id")))
