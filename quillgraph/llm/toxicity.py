"""Toxicity scores from gradient-boosted trees over dense features.

A lexicon of words and word beginnings is mined from labelled texts.  Whole
texts give dense features: lexicon densities (plain and after undoing
look-alike characters), lexicon hits near second-person words, shares of
capitals and punctuation, rates of obfuscated words.  Boosted trees of small
depth score them and isotonic regression on out-of-fold scores calibrates.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, draw, held_out, in_batches, read_table, slices, text_buffers, within, words, written

#: Labelled documents of each class that are learned from at most, drawn by id and text.
PER_CLASS = 6000
#: Lexicon entries at most; beginnings of words from 4 to 8 letters stand for all words that begin so.
LEXICON = 400
STEMS = range(4, 9)
TREES, DEPTH, RATE, BINS, FOLDS = 60, 3, 0.15, 32, 4

#: Insults that count without having been seen in a label.
SEED_WORDS = frozenset("idiot idiots moron morons stupid dumb loser losers scum trash worthless pathetic disgusting clown imbecile jerk bastard bitch asshole fuck fucking shit dumbass retard".split())
SECOND_PERSON = frozenset("you your yours youre yourself u ur tu te ti tú usted ustedes vosotros vos du dich dir dein deine ihr euch toi ton ta tes vous votre vos".split())
NEAR = 6

_WORD = re.compile(r"\w+")
_LOOKALIKE = str.maketrans("01345789@$!|", "oieastbgasil")
_DROP = str.maketrans("", "", ".-_*+~'’·")
_table = lambda chars: np.isin(np.arange(256), list(chars)).astype(np.uint8)
_UPPER = _table(range(65, 91))
_LETTER = _table([*range(65, 91), *range(97, 123), *range(128, 256)])
_BANG, _QUERY, _PUNCT, _DIGIT = _table(b"!"), _table(b"?"), _table(b".,;:!?-\"'()"), _table(b"0123456789")
_ODD = _table(b"0123456789@$!*.-_+~|")

NAMES = (
    "log_words", "seed_density", "seed_hits", "mined_density", "mined_weight", "mined_hits", "top_weight", "near_second_person", "second_person_density",
    "upper_share", "all_caps_share", "bang_density", "query_density", "punct_density", "digit_density", "obfuscated_density", "obfuscated_hits",
)


#: Words whose weights a task remembers before it starts over; about 15 MB.
CACHED = 100_000


#: Longer words stand in the lexicon as a digest, so that counting them takes no more memory than others.
LONG_WORD = 40


def whole(word: str) -> str:
    """A word's own entry in the lexicon, as against that of its beginnings."""
    return (word if len(word) <= LONG_WORD else hashlib.blake2b(word.encode(), digest_size=16).hexdigest()) + "$"


class Lexicon:
    """Weights of words, looked up through a bounded cache."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights
        self.cache: dict[str, float] = {}

    def fresh(self) -> Lexicon:
        """With a cache of its own, which goes with the task."""
        return Lexicon(self.weights)

    def weight(self, word: str) -> float:
        return max([self.weights.get(whole(word), 0.0), *[self.weights.get(word[:n], 0.0) for n in STEMS if n <= len(word)]])

    def __call__(self, word: str) -> float:
        if len(word) > LONG_WORD:
            return self.weight(word)  # not remembered, so that the cache stays small
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) >= CACHED:
                self.cache.clear()
            found = self.cache[word] = self.weight(word)
        return found


def features(part: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """One row of NAMES for each text; a null text counts as empty."""
    data, at = text_buffers(part)
    n = len(at) - 1
    x = np.zeros((n, len(NAMES)))
    sums = lambda table: within(at, np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)]))
    start, end, n_words = words(data, at)
    first = np.concatenate([[0], np.cumsum(n_words)])
    some, letters = np.maximum(n_words, 1), np.maximum(sums(_LETTER), 1)
    upper = np.concatenate([[0], np.cumsum(_UPPER[data], dtype=np.int64)])
    letter = np.concatenate([[0], np.cumsum(_LETTER[data], dtype=np.int64)])
    caps = (upper[end] - upper[start] == letter[end] - letter[start]) & (upper[end] - upper[start] > 1)
    caps_sums = np.concatenate([[0], np.cumsum(caps)])
    x[:, 0] = np.log1p(n_words)
    x[:, 9] = sums(_UPPER) / letters
    x[:, 10] = (caps_sums[first[1:]] - caps_sums[first[:-1]]) / some
    for k, table in ((11, _BANG), (12, _QUERY), (13, _PUNCT), (14, _DIGIT)):
        x[:, k] = sums(table) / some
    # a sign or digit between letters: the word may be a disguised one
    if len(data) > 2:
        odd = np.flatnonzero(_ODD[data[1:-1]] & _LETTER[data[:-2]] & (_LETTER[data[2:]] | _ODD[data[2:]])) + 1
        odd_word = np.unique(np.searchsorted(start, odd, "right") - 1)
        odd_word = odd_word[(odd_word >= 0) & (odd_word < len(start))]
        odd_doc = np.searchsorted(first, odd_word, "right") - 1
        x[:, 15] = np.bincount(odd_doc, minlength=n)[:n] / some
        for w, doc in zip(odd_word, odd_doc):
            raw = bytes(data[start[w] : end[w]]).decode("utf-8", "replace").lower()
            plain = raw.translate(_DROP).translate(_LOOKALIKE).strip("\"'()[]{},;:?")
            if plain in SEED_WORDS or lexicon(plain) > 0:
                x[doc, 16] += 1
    weight, cache = lexicon, lexicon.cache
    for i, text in enumerate(part.to_pylist()):
        if not text:
            continue
        found = _WORD.findall(text.lower())
        hits = []
        for k, w in enumerate(found):
            if (v := cache.get(w)) is None:
                v = weight(w)
            if v:
                hits.append((k, v))
        if not hits:
            continue
        seed = sum(found[k] in SEED_WORDS for k, _ in hits)
        you = sum(map(SECOND_PERSON.__contains__, found))
        mined = [(k, v) for k, v in hits if v < SEED_ONLY]
        x[i, 1], x[i, 2] = seed / len(found), seed
        x[i, 3], x[i, 4], x[i, 5] = len(mined) / len(found), sum(v for _, v in mined), len(mined)
        x[i, 6] = max(v for _, v in hits)
        x[i, 7] = sum(any(w in SECOND_PERSON for w in found[max(0, k - NEAR) : k + NEAR + 1]) for k, _ in hits)
        x[i, 8] = you / len(found)
    return x


#: Token counts that a task holds before it hands them on, to be summed later.
COUNTED = 200_000
#: Log odds and likelihood ratio that a mined token needs.
LEAST_ODDS, LEAST_RATIO = 2.5, 20.0
#: Weight of a word that only the seed list knows.
SEED_ONLY = 100.0


def _choose(found: list[tuple[str, int, int]], p: int, n: int) -> Lexicon:
    """The lexicon from (token, toxic texts, other texts) out of p and n texts."""
    weights = {w + "$": SEED_ONLY for w in SEED_WORDS}
    least, share, scored = max(3, math.ceil(0.004 * p)), p / max(1, p + n), []
    for token, pos, neg in found:
        odds = math.log((pos + 0.5) / (p + 1)) - math.log((neg + 0.5) / (n + 1))
        # likelihood ratio against the token telling nothing
        ratio = 2 * sum(c * math.log(c / ((pos + neg) * s)) for c, s in ((pos, share), (neg, 1 - share)) if c)
        if pos >= least and odds > LEAST_ODDS and ratio > LEAST_RATIO:
            scored.append((-odds * math.sqrt(pos), token, odds))
    # of nested beginnings the better one stays and stands for the longer ones
    kept: list[str] = []
    for _, token, odds in sorted(scored):
        if len(kept) == LEXICON:
            break
        if not any(token.rstrip("$").startswith(k) for k in kept if not k.endswith("$")):
            kept.append(token)
            weights[token] = min(weights.get(token, SEED_ONLY), odds)
    return Lexicon(weights)


def mine(rows: DataFrame) -> tuple[Lexicon, list[Lexicon]]:
    """Words (``word$``) and word beginnings that toxic texts have far more often, from rows of (text, toxic, fold).

    Also gives for each fold the lexicon of the other folds: on those the
    trees learn how far a mined word can be trusted in unseen texts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [Counter() for _ in range(2 * FOLDS)]

        def so_far() -> pa.RecordBatch:
            tokens = list(set().union(*seen))
            return pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), *(pa.array([c[w] for w in tokens], pa.int64()) for c in seen)], ["token", *names])

        for batch in batches:
            for part in slices(batch, "text"):
                for text, toxic, fold in zip(*(part.column(c).to_pylist() for c in ("text", "toxic", "fold"))):
                    found = set(_WORD.findall((text or "").lower()))
                    seen[2 * fold + toxic].update({whole(w) for w in found} | {w[:n] for w in found for n in STEMS if n <= len(w)})
                if sum(map(len, seen)) > COUNTED:
                    yield so_far()
                    for c in seen:
                        c.clear()
        yield so_far()

    names = [f"{kind}{k}" for k in range(FOLDS) for kind in ("neg", "pos")]
    totals = {(r["fold"], r["toxic"]): r["count"] for r in rows.groupBy("fold", "toxic").count().collect()}
    p, n = (sum(v for (_, y), v in totals.items() if y == k) for k in (1, 0))
    if not p or not n:
        return _choose([], p, n), [_choose([], p, n)] * FOLDS
    sums = rows.transform(in_batches(count, "token string, " + ", ".join(f"{c} long" for c in names))).groupBy("token").agg(*[F.sum(c).alias(c) for c in names])
    pos, neg = (sum(F.col(f"{kind}{k}") for k in range(FOLDS)) for kind in ("pos", "neg"))
    odds = F.log((pos + 0.5) / (p + 1)) - F.log((neg + 0.5) / (n + 1))
    found = sums.where((pos >= max(3, math.ceil(0.003 * p))) & (odds > 0.8 * LEAST_ODDS)).orderBy(F.desc(odds * F.sqrt(pos)), "token").limit(40 * LEXICON).collect()
    every = [(r["token"], sum(r[f"pos{k}"] for k in range(FOLDS)), sum(r[f"neg{k}"] for k in range(FOLDS))) for r in found]
    parts = [_choose([(t, a - r[f"pos{k}"], b - r[f"neg{k}"]) for (t, a, b), r in zip(every, found)], p - totals.get((k, 1), 0), n - totals.get((k, 0), 0)) for k in range(FOLDS)]
    return _choose(every, p, n), parts


@dataclass
class Trees:
    """Boosted trees of full depth; node k has the children 2 k + 1 and 2 k + 2."""

    edges: list[np.ndarray]
    start: float
    feature: np.ndarray  # tree x node
    cut: np.ndarray
    leaf: np.ndarray

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, out, rows = self.bins(x), np.full(len(x), self.start), np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (b[rows, f[node]] > c[node])
            out += leaf[node - len(f)]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Trees by second-order steps on the log loss, with histograms of the features."""
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS)[1:-1])) if len(x) else np.zeros(0) for k in range(x.shape[1])]
    # a rare feature has one quantile, zero; values above it are told apart evenly
    edges = [np.unique(np.concatenate([e, np.quantile(v, np.linspace(0, 1, 9)[:-1]) - 1e-9])) if len(v := x[:, k][x[:, k] > 0]) else e for k, e in enumerate(edges)]
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    inner, model = 2**DEPTH - 1, Trees(edges, float(np.log(rate / (1 - rate))), np.zeros((0, 0), int), np.zeros((0, 0), int), np.zeros((0, 0)))
    b, score, width = model.bins(x), np.full(len(x), model.start), BINS + 16
    flat = b + np.arange(x.shape[1]) * width
    trees = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        node, feature, cut = np.zeros(len(x), np.int64), np.zeros(inner, int), np.full(inner, width)
        for k in range(inner):
            mine_ = np.flatnonzero(node == k)
            if len(mine_) >= 8:
                size = x.shape[1] * width
                gs = np.stack([np.bincount(flat[mine_].ravel(), np.repeat(v[mine_], x.shape[1]), size).reshape(-1, width).cumsum(1) for v in (g, h)])
                total = gs[:, :1, -1:]
                left, right = gs, total - gs
                gain = left[0] ** 2 / (left[1] + 1) + right[0] ** 2 / (right[1] + 1) - total[0] ** 2 / (total[1] + 1)
                gain[(left[1] < 0.5) | (right[1] < 0.5)] = -1
                best = int(gain.argmax())
                if gain.ravel()[best] > 1e-6:
                    feature[k], cut[k] = best // width, best % width
            node[mine_] = 2 * k + 1 + (b[mine_, feature[k]] > cut[k])
        place = node - inner
        leaf = -RATE * np.bincount(place, g, inner + 1) / (np.bincount(place, h, inner + 1) + 1)
        score += leaf[place]
        trees.append((feature, cut, leaf))
    model.feature, model.cut, model.leaf = (np.stack(v) for v in zip(*trees))
    return model


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: scores and the rising probabilities there."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of y, count, sum of scores
    for s, v in zip(score[order], y[order].astype(float)):
        blocks.append([v, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + c for a, c in zip(blocks[-1], last)]
    # half an observation of either label keeps the ends off 0 and 1
    return np.array([s / c for _, c, s in blocks]), np.array([(v + 0.05) / (c + 0.1) for v, c, _ in blocks])


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    at: np.ndarray
    level: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.where(x[:, 2] + x[:, 16] > 0, 0.9, 0.05)
        raw = self.trees.raw(x)
        # the trees' own order breaks ties inside a pooled block
        calibrated = np.interp(raw, self.at, self.level)
        return np.clip(0.98 * calibrated + 0.02 / (1 + np.exp(-raw)), 0, 1)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Learn from at most ``per_class`` labelled documents of each class, none of them held out.

    Null labels and texts teach nothing; of several labels of a document the
    larger one counts.  An id of several texts teaches each of them, drawn by
    a hash of id and text where they are too many; of equal rows of one id one
    counts.  Without both classes the seed list alone decides.
    """
    usable = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    drawn = usable.withColumn("u", draw(F.col("doc_id"), 6)).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(61)), F.lit(FOLDS)).cast("int"))
    # at most 2 * per_class rows of four numbers: under 1 MB, so it is broadcast and no text is shuffled
    one = lambda y: drawn.where((F.col("toxic") == y) & (F.col("u") <= min(1.0, 1.2 * per_class / max(1, counts.get(y, 0))))).orderBy("u", "doc_id").limit(per_class)
    sample = one(1).unionByName(one(0))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(sample), "doc_id")
    texts = written(texts.withColumn("key", F.xxhash64("doc_id", "text")), "toxic-texts")
    # the keys drawn last, a number for each class
    ends = [texts.where(F.col("toxic") == y).select("key").distinct().orderBy("key").limit(per_class).agg(F.max("key")).first()[0] for y in (0, 1)]
    drawn = F.col("key") <= F.when(F.col("toxic") == 0, F.lit(ends[0]).cast("long")).otherwise(F.lit(ends[1]).cast("long"))
    rows = written(texts.where(drawn).dropDuplicates(["toxic", "key"]).drop("key"), "toxic-sample")
    discard(texts)
    lexicon, others = mine(rows.select("text", "toxic", "fold"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicons = [x.fresh() for x in others]
        for batch in batches:
            for piece in slices(batch, "text"):
                folds = piece.column("fold").to_numpy()
                for k in range(FOLDS):
                    part = piece.filter(pa.array(folds == k))
                    x = features(part.column("text"), lexicons[k])
                    yield pa.RecordBatch.from_arrays([part.column("u"), part.column("toxic"), part.column("fold"), pa.array(list(x), pa.list_(pa.float64()))], ["u", "toxic", "fold", "x"])

    got = rows.select("u", "toxic", "fold", "text").transform(in_batches(run, "u double, toxic int, fold int, x array<double>")).collect()
    got.sort(key=lambda r: (r["u"], r["toxic"], r["x"]))
    y = np.array([r["toxic"] for r in got], float)
    if not len(y) or y.min() == y.max():
        return Model(lexicon, None, np.zeros(1), np.zeros(1))
    x, fold = np.array([r["x"] for r in got]), np.array([r["fold"] for r in got])
    out = np.zeros(len(y))
    for k in range(FOLDS):
        rest = fold != k
        if rest.any() and not rest.all():
            out[~rest] = boost(x[rest], y[rest]).raw(x[~rest])
    return Model(lexicon, boost(x, y), *isotonic(out, y))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of (doc_id, text).

    Row by row, without a shuffle.  Null texts count as empty and get the
    score of an empty text; ids may be null or repeated; further columns are
    ignored; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, lexicon = sent.value, sent.value.lexicon.fresh()
        for batch in batches:
            for part in slices(batch, "text"):
                s = m.score(features(part.column("text"), lexicon))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", F.col("text").cast("string").alias("text")).transform(in_batches(run, f"doc_id {kind}, score double, predicted int"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, all columns as they are, whatever their names.

    Each row is judged by its own text, so ids may be null or repeated; a null
    text counts as an empty one, and long ones are read as a whole; an empty
    table gives no rows.
    """
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, lexicon = sent.value, sent.value.lexicon.fresh()
        for batch in batches:
            for part in slices(batch, at):
                yield part.filter(pa.array(m.score(features(part.column(at), lexicon)) < 0.5))

    return docs.transform(in_batches(run, docs.schema))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents."""
    docs = read_table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, read_table(spark, sf_dir, "labels")))
