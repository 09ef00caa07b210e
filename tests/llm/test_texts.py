"""Operators on whole texts: repetition rules, toxicity, languages, tokens, URLs, top-k."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import bpe, langid, repetition, topk, toxicity, urls
from quillgraph.llm.common import text_buffers

SF = "/root/testdata/sf0.01"
EDGES = [(1, ""), (2, None), (3, " \n\t"), (4, "a"), (4, "a"), (None, "x y z"), (5, "word " * 30000), (6, "é中 \u00a0<|>#\n" * 3)]


def edges(spark):
    """Odd rows with columns whose names clash with those of results."""
    return spark.createDataFrame(EDGES, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("id", "score", "n_words", "kept", "held_out", "ids", "n", "lang", "source")})


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def plain_repetition(t):
    w, out = words(t), {}
    out["n_words"], out["word_chars"], out["n_symbols"] = len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or ""))
    seen, out["n_dup_lines"] = set(), 0
    for line in (t or "").split("\n"):
        if words(line):
            out["n_dup_lines"] += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = Counter(grams)
    out["n_repeat_words"] = len({i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(3)})
    for n in repetition.NGRAM_LIMITS:
        seen, inside = set(), set()
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            if g in seen:
                inside |= set(range(i, i + n))
            seen.add(g)
        out[f"dup_{n}gram_chars"] = sum(len(w[i]) for i in inside)
    return out


def test_repetition_counts(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(300).collect()] + [t for _, t in EDGES] + ["a b c d e f\n" * 4 + "x", "\n\n", "a\na\n\na b a b a b"]
    found = repetition.measure(*text_buffers(pa.array(texts)))
    for i, t in enumerate(texts):
        for name, value in plain_repetition(t).items():
            assert found[name][i] == value, (name, i)


def test_repetition_query(spark):
    rows = repetition.judge_documents(edges(spark)).collect()
    assert len(rows) == len(EDGES) and all(r["base_failed"] and not r["kept"] for r in rows if r["n_words"] < 50)
    clean = " ".join(f"word{k}" for k in range(100))
    one = repetition.judge_documents(spark.createDataFrame([(1, clean), (2, clean + "\n" + "x y z u v w " * 40)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["kept"] for r in one} == {1: True, 2: False}
    assert repetition.judge_documents(edges(spark).limit(0)).count() == 0


def test_toxicity(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, model).join(labels, "doc_id").collect()}
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["predicted"] == r["toxic"] for r in held) / len(held) > 0.93
    assert sum(r["predicted"] for r in got.values() if not r["toxic"]) <= 0.01 * len(got)
    odd = toxicity.score_documents(edges(spark), model).collect()
    assert len(odd) == len(EDGES) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in odd)
    kept = toxicity.without_toxic(edges(spark), model)
    assert kept.columns == edges(spark).columns and kept.count() == sum(1 - r["predicted"] for r in odd)


def test_toxicity_without_labels(spark):
    docs = edges(spark)
    model = toxicity.train(docs, spark.createDataFrame([(1, None)], "doc_id long, toxic int"))
    rows = toxicity.score_documents(spark.createDataFrame([(1, "you stupid idiot"), (2, "a fine day"), (3, "you 1d1ot")], "doc_id long, text string"), model).collect()
    assert [r["predicted"] for r in rows] == [1, 0, 1]
    assert toxicity.score_documents(docs.limit(0), model).count() == 0


def test_isotonic_rises():
    rng = np.random.default_rng(0)
    s = rng.normal(size=500)
    at, level = toxicity.isotonic(s, (rng.random(500) < 1 / (1 + np.exp(-3 * s))).astype(float))
    assert (np.diff(at) > 0).all() and (np.diff(level) > -0.05).all()


def test_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs)
    rows = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").withColumn("held", langid.held_out(F.col("doc_id"))).collect()
    held = [r for r in rows if r["held"]]
    assert len(held) > 100 and sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.97
    odd = {(r["doc_id"], r["lang_pred"]) for r in langid.identify(edges(spark), model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= odd and (4, "und") not in odd
    assert langid.train(docs.where("lang is null")) is None
    assert {r["lang_pred"] for r in langid.identify(docs.limit(5), None).collect()} == {"und"}


def plain_language_features(text):
    """Square roots of hashed n-gram counts at unit length, gram by gram."""
    data = [b + 32 if 65 <= b <= 90 else b for b in text.encode()]
    x = np.zeros(langid.DIM)
    for n in langid.NGRAMS:
        for i in range(len(data) - n + 1):
            h = data[i]
            for b in data[i + 1 : i + n]:
                h = (h * 0x01000193 ^ b) & 0xFFFFFFFF
            x[(h * 0x9E3779B1 & 0xFFFFFFFF) >> 20] += 1
    x = np.sqrt(x)
    return x / max(np.linalg.norm(x), 1e-9)


def test_languages_are_decoded_by_weighted_loss(spark):
    """Held-out texts against features gram by gram and codewords one by one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs)
    assert len(np.unique(model.trust.round(6))) > 1 and np.allclose(model.trust.sum(1), 1)
    texts = {r["doc_id"]: r["text"] for r in docs.where(langid.held_out(F.col("doc_id"))).limit(120).collect()}
    got = {r["doc_id"]: r for r in langid.identify(docs, model).where(F.col("doc_id").isin(list(texts))).collect()}
    for i, t in texts.items():
        if not any(map(str.isalpha, t)):
            assert got[i]["lang_pred"] == "und"
            continue
        margin = plain_language_features(t) @ model.weights + model.bias
        loss = [sum(w * np.log1p(np.exp(-4 * m * c)) for m, c, w in zip(margin, code, trust)) for code, trust in zip(model.code, model.trust)]
        near = [np.exp(-langid.SHARPNESS * (v - min(loss))) for v in loss]
        assert got[i]["lang_pred"] == model.langs[int(np.argmin(loss))]
        assert got[i]["score"] == pytest.approx(max(near) / sum(near), abs=1e-4)


def test_a_hundred_languages():
    """Every language keeps a share of the sample; rows and features give the same classifiers, and trust tells bits apart."""
    rng = np.random.default_rng(4)
    means = rng.random((100, 60)) ** 6
    y = np.repeat(np.arange(100), 12)
    x = np.sqrt(rng.poisson(80 * means[y])).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    shuffled = rng.permutation(len(y))
    model = langid.fit(x[shuffled], y[shuffled], [f"l{k}" for k in range(100)])
    fresh = np.sqrt(rng.poisson(80 * means[y])).astype(np.float32)
    best, _, _ = model.predict(fresh / np.linalg.norm(fresh, axis=1, keepdims=True))
    assert (best == y).mean() > 0.9
    assert len(np.unique(model.trust.round(4))) > 50
    cost, code = np.ones(len(y)), model.code[y]
    by_features = langid._ridge(x, code, cost)
    by_rows = langid._ridge(np.hstack([x, np.zeros((len(x), 2000), np.float32)]), code, cost)
    assert np.allclose(by_features[0], by_rows[0][:60], atol=2e-2) and np.allclose(by_features[1], by_rows[1], atol=2e-2)


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "LEARNED", 600)
    rows = [(100 * k + i, f"{chr(0x4E00 + 40 * k)}{chr(0x4E01 + 40 * k)}{chr(0x4E02 + 40 * k)} " * 9, f"l{k}") for k in range(300) for i in range(4)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) == 300


@pytest.mark.parametrize("n", [1, 2, 3, 6, 7, 40])
def test_codewords_are_apart(n):
    code = langid.codewords(n)
    assert len(np.unique(code, axis=0)) == n


def test_bpe_is_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    own = bpe.WordBpe(bpe.load_spec(path))
    rng = random.Random(3)
    alphabet = "abAB'sStTreveLlLmMdD  \n\t.,!?123²éÉßΣσčЖ中<|>_-́ \x1c"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += ["x" * 5000 + "é" * 300, "a<|endoftext|>b<|startoftext|>", "", "ΑΣ ΣΑΣ. İI'LL", "ab" * 60]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(200).collect()]
    for t, (ids, decoded), want in zip(texts, own.encode_batch(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert ids == " ".join(map(str, want.ids)), t
        assert decoded == library.decode(want.ids, skip_special_tokens=False)
        assert own.decode(want.ids) == decoded
    rows = bpe.encode_documents(edges(spark), bpe.load_spec(path), ids=True).collect()
    assert len(rows) == len(EDGES) and all(r["n_tokens"] == len(r["ids"]) for r in rows)


def test_bpe_merges_alike():
    import public_tokenizers

    own = bpe.WordBpe(bpe.load_spec(public_tokenizers.path("word_bpe_49k.json")))
    rng = random.Random(1)
    ws = ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(1, 24))) for _ in range(2000)]
    many = own.merge_many(ws)
    for w, ids in zip(ws, many):
        assert own.merge(w) == ids == tuple(own._merge_long(own.symbols(w)))


def test_urls_by_stated_rules(spark):
    cases = {
        "https://a.example.org/es/x?y": ("a.example.org", "/es/x", "example.org/es/", "block"),
        "HTTP://EXAMPLE.ORG/en/12#t": ("example.org", "/en/12", "example.org/en/1", "block"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "http://x.com/fr/1": ("x.com", "/fr/1", "com/fr/", "allow"),
        "http://x.com/de/1": ("x.com", "/de/1", "com/de/", "block"),
        "http://x.com?/de/1": ("x.com", "", None, "allow"),
        "x.org/": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(cases)] + [(None, None, "clash")], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df, df.select("url", F.lit(None).cast("boolean").alias("blocked"))).collect()}
    assert got == dict(enumerate(cases.values())) | {None: ("", "", None, "allow")}


def test_urls_by_mined_rules(spark):
    rng = random.Random(8)
    rows = []
    for i in range(600):
        bad = i % 6 == 0
        host, path = ("spam.net", "win/now") if bad else (f"h{rng.randrange(9)}.net", rng.choice(["win", "now", "a/b"]))
        rows.append((i, f"https://{host}/{path}/{i}", bad if rng.random() > 0.02 else not bad))
    df = spark.createDataFrame(rows, "page_id long, url string, blocked boolean")
    rules = urls.mine_rules(df)
    tokens = {r["page_id"]: set(r["t"]) for r in df.select("page_id", urls.url_tokens(F.col("url")).alias("t")).collect()}
    mined = [set(r["tokens"]) for r in rules.collect()]
    assert mined and not any(a < b for a in mined for b in mined)
    # support and confidence by counting
    for r in rules.collect():
        fits = [row for row in rows if set(r["tokens"]) <= tokens[row[0]]]
        assert sum(x[2] for x in fits) / len(fits) == pytest.approx(r["confidence"]) and r["confidence"] >= urls.MIN_CONFIDENCE
    got = {r["page_id"]: r["verdict"] for r in urls.judge(df, df).collect()}
    assert got == {i: "block" if any(m <= t for m in mined) else "allow" for i, t in tokens.items()}
    assert urls.judge(df.limit(0), df.limit(0)).count() == 0


def plain_rules(rows):
    """All telling tokens, and all minimal telling sets of the other tokens where those of the same blocked urls go together."""
    least, n, base = max(urls.MIN_PAGES, math.ceil(urls.MIN_SUPPORT * len(rows))), len(rows), sum(b for _, b in rows) / len(rows)

    def counts(tokens):
        hits = [b for t, b in rows if tokens <= t]
        return len(hits), sum(hits)

    def telling(tokens, tests):
        m, b = counts(tokens)
        if b < least or b / m < urls.MIN_CONFIDENCE or b / m <= base:
            return False
        p = b / m
        return m * (p * math.log(p / base) + ((1 - p) * math.log((1 - p) / (1 - base)) if p < 1 else 0)) >= math.log(tests / urls.CHANCE)

    every = {x for t, _ in rows for x in t if counts({x})[1] >= least}
    found = [{x} for x in every if telling({x}, len(every))]
    items = {}
    for x in every - set().union(*found):
        items.setdefault(tuple(k for k, (t, b) in enumerate(rows) if b and x in t), set()).add(x)
    sets = [set().union(*c) for n in range(1, len(items) + 1) for c in itertools.combinations(items.values(), n)]
    sets = [s for s in sets if len(s) > 1 and counts(s)[1] >= least]
    several = [s for s in sets if telling(s, len(every) + len(sets))]
    return found + [s for s in several if not any(o < s for o in several)]


def test_rules_are_those_of_a_plain_miner(spark):
    rng = random.Random(12)
    rows = []
    for i in range(700):
        # neither the host nor the section tells, both together do
        host, part = rng.choice("abc"), rng.choice(["x", "y", "z"])
        bad = (host, part) == ("a", "x") if rng.random() > 0.03 else rng.random() < 0.1
        extra = "/promo/deal" if rng.random() < (0.6 if bad else 0.25) else ""
        rows.append((i, f"http://{host}.net/{part}{extra}/{i}", bad))
    df = spark.createDataFrame(rows, "page_id long, url string, blocked boolean")
    tokens = {r["page_id"]: set(r["t"]) for r in df.select("page_id", urls.url_tokens(F.col("url")).alias("t")).collect()}
    want = plain_rules([(tokens[i], b) for i, _, b in rows])
    got = [frozenset(r["tokens"]) for r in urls.mine_rules(df).collect()]
    assert sorted(map(sorted, got)) == sorted(map(sorted, want)) and any(len(w) > 1 for w in want)
    assert all(sum(b for i, _, b in rows if r <= tokens[i]) >= urls.MIN_PAGES for r in got)


def test_no_rules_by_chance(spark):
    """Labels that don't follow the urls give no rule, and all pages without a stated rule are allowed."""
    rng = random.Random(2)
    rows = [(i, f"https://h{i % 60}.net/p{rng.randrange(200)}/{i}", rng.random() < 0.15) for i in range(3000)]
    df = spark.createDataFrame(rows, "page_id long, url string, blocked boolean")
    assert urls.mine_rules(df).count() == 0
    few = spark.createDataFrame([(i, f"http://only.net/{'bad' if i < 4 else 'good'}", i < 4) for i in range(40)], "page_id long, url string, blocked boolean")
    assert urls.mine_rules(few).count() == 0


@pytest.mark.parametrize("drop", [0, 1])
def test_long_shared_paths_end(spark, drop):
    """Twenty segments in all blocked urls, or in all but one in turn, are no explosion of combinations."""
    segments = [f"s{chr(97 + k)}" for k in range(20)]
    rng = random.Random(1)
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        some = [s for k, s in enumerate(segments) if not (drop and k == i // 4 % 20)] if bad else rng.sample(segments, 14)
        rows.append((i, f"http://h.net/{'/'.join(some)}", bad))
    df = spark.createDataFrame(rows, "page_id long, url string, blocked boolean")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(df, df).collect()}
    assert all(got[i] == "block" for i, _, b in rows if b)


def test_urls_without_labels_and_long_ones(spark):
    rows = [(1, "http://a.net/" + "x/" * 20000, "u"), (1, "http://a.net/" + "x/" * 20000, "u"), (2, None, "u"), (3, "http://e.org/q", "u")]
    df = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    none = df.select("url", F.lit(True).alias("blocked")).limit(0)
    got = sorted((r["page_id"], len(r["path"]), r["rule"], r["verdict"]) for r in urls.judge(df, none).collect())
    assert got == [(1, 40001, None, "allow"), (1, 40001, None, "allow"), (2, 0, None, "allow"), (3, 2, "org/", "allow")]


@pytest.mark.parametrize("blocks", [(1 << 17, 1 << 12), (70, 9)])
def test_topk_is_exact(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "BLOCK_ROWS", blocks[0])
    monkeypatch.setattr(topk, "BLOCK_QUERIES", blocks[1])
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(20)]
    codes = {i: base[i % 20] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) if i % 3 else base[0] for i in range(400)}
    rows = [(i, f"{c:016x}", "clash") for i, c in codes.items()] + [(None, "0" * 16, "clash"), (500, None, "clash"), (3, f"{codes[3]:016x}", "clash")]
    df = spark.createDataFrame(rows, "vec_id long, code string, distance string")
    got = {}
    for r in topk.top_k(df, df.where("vec_id % 20 = 0"), k=7).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["distance"], r["neighbor_id"]))
    assert set(got) == {i for i in codes if i % 20 == 0}
    for q, found in got.items():
        want = sorted((bin(codes[q] ^ c).count("1"), i) for i, c in codes.items() if i != q)[:7]
        assert sorted(found) == [(k + 1, *w) for k, w in enumerate(want)]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_sign_codes(spark):
    df = spark.createDataFrame([([1.0, -1.0, None, float("nan")] * 4,), ([1.0],), (None,)], "v array<float>")
    assert [r["c"] for r in df.select(topk.sign_code(F.col("v"), 16).alias("c")).collect()] == ["8888", None, None]


def test_topk_of_repeated_ids_and_a_hot_code(spark):
    """An id's smallest code counts; a code that most rows have gives its smallest ids."""
    rows = [(i, "f" * 16) for i in range(500)] + [(700, "0" * 16), (700, "f" * 16), (701, "0" * 15 + "1"), (702, "f" * 15 + "e"), (3, "f" * 15 + "0")]
    df = spark.createDataFrame(rows, "vec_id long, code string")
    got = {}
    for r in topk.top_k(df, df.where("vec_id in (0, 3, 700)"), k=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["neighbor_id"], r["distance"]))
    assert sorted(got[0]) == [(1, 1, 0), (2, 2, 0), (3, 4, 0), (4, 5, 0), (5, 6, 0)]
    assert sorted(got[3]) == [(1, 702, 3), (2, 0, 4), (3, 1, 4), (4, 2, 4), (5, 4, 4)]
    assert sorted(got[700])[:1] == [(1, 701, 1)] and sorted(got[700])[1][1:] == (3, 60)


def plain_toxicity_features(text, lexicon):
    """The features of one text, one by one."""
    ws = words(text)
    raw = (text or "").encode()
    letters = [b for b in raw if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128]
    found = re.findall(r"\w+", (text or "").lower())
    hits = [(k, w, lexicon.weight(w)) for k, w in enumerate(found) if lexicon.weight(w)]
    mined = [v for _, _, v in hits if v < toxicity.SEED_ONLY]
    n, you = max(len(ws), 1), toxicity.SECOND_PERSON
    upper = sum(65 <= b <= 90 for b in raw)
    x = dict.fromkeys(toxicity.NAMES, 0.0)
    x["log_words"], x["upper_share"] = math.log1p(len(ws)), upper / max(len(letters), 1)
    caps = lambda w: sum(65 <= b <= 90 for b in w.encode())
    x["all_caps_share"] = sum(caps(w) > 1 and caps(w) == sum(65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in w.encode()) for w in ws) / n
    for name, chars in (("bang_density", "!"), ("query_density", "?"), ("punct_density", ".,;:!?-\"'()"), ("digit_density", "0123456789")):
        x[name] = sum((text or "").count(c) for c in chars) / n
    if hits:
        x["seed_hits"] = sum(w in toxicity.SEED_WORDS for _, w, _ in hits)
        x["seed_density"] = x["seed_hits"] / len(found)
        x["mined_density"], x["mined_weight"], x["mined_hits"], x["top_weight"] = len(mined) / len(found), sum(mined), len(mined), max(v for _, _, v in hits)
        x["near_second_person"] = sum(any(w in you for w in found[max(0, k - toxicity.NEAR) : k + toxicity.NEAR + 1]) for k, _, _ in hits)
        x["second_person_density"] = sum(w in you for w in found) / len(found)
    return x


def test_toxicity_features_one_by_one(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(300).collect()] + [t for _, t in EDGES if t is not None] + ["You IDIOT! you are a fool, FOOL? (yes)", "idiots", "THE END."]
    lexicon = toxicity.Lexicon({w + "$": toxicity.SEED_ONLY for w in toxicity.SEED_WORDS} | {"fool": 3.0, "lore$": 2.6})
    got = toxicity.features(pa.array(texts), lexicon)
    plain = [n for n in toxicity.NAMES if not n.startswith("obfuscated")]
    for t, row in zip(texts, got):
        want = plain_toxicity_features(t, lexicon)
        assert {n: row[toxicity.NAMES.index(n)] for n in plain} == pytest.approx({n: want[n] for n in plain}), t
    odd = toxicity.features(pa.array(["you 1d1ot and m.o.r.o.n", "a-b c", "no"]), lexicon)
    assert odd[:, toxicity.NAMES.index("obfuscated_hits")].tolist() == [2, 0, 0]


def test_trees_one_by_one():
    """Scores by walking each tree, and the first cut by trying all."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, len(toxicity.NAMES)))
    y = (x[:, 3] + 0.5 * x[:, 9] + 0.3 * rng.normal(size=400) > 0).astype(float)
    model = toxicity.boost(x, y)
    bins = model.bins(x)
    for i in range(0, 400, 37):
        score = model.start
        for feature, cut, leaf in zip(model.feature, model.cut, model.leaf):
            node = 0
            for _ in range(toxicity.DEPTH):
                node = 2 * node + (2 if bins[i, feature[node]] > cut[node] else 1)
            score += leaf[node - len(feature)]
        assert model.raw(x[i : i + 1])[0] == pytest.approx(score)
    p = np.full(400, y.mean())
    g, h = p - y, p * (1 - p)

    def gain(f, c):
        left = bins[:, f] <= c
        part = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
        return part(left) + part(~left) - part(np.ones(400, bool)) if min(h[left].sum(), h[~left].sum()) >= 0.5 else -1

    best = max(((gain(f, c), f, c) for f in range(x.shape[1]) for c in range(bins[:, f].max() + 1)), key=lambda v: v[0])
    assert gain(model.feature[0][0], model.cut[0][0]) == pytest.approx(best[0]) and model.feature[0][0] == 3
    assert ((model.raw(x) > 0) == (y > 0)).mean() > 0.95


def test_toxicity_of_conflicting_labels(spark):
    """The larger label of a document counts, whatever the order of the rows."""
    docs = spark.createDataFrame([(i, f"word{i % 7} text {'vile' if i % 2 else 'kind'} thing") for i in range(200)], "doc_id long, text string")
    labels = [(i, i % 2) for i in range(200)] + [(i, 0) for i in range(200)]
    one, two = (toxicity.train(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, labels[::-1]))
    scores = [[r["score"] for r in toxicity.score_documents(docs, m).orderBy("doc_id").collect()] for m in (one, two)]
    assert scores[0] == scores[1] and min(scores[0][1::2]) > 0.5 > max(scores[0][::2])


def repeated_ids():
    """20,000 rows of 50 ids: texts of their own, a thousand equal ones among them."""
    rows = [(i % 50, f"{'vile foul' if i % 2 else 'kind good'} text number {i % 19000}", i % 2, "de" if i % 2 else "en") for i in range(19000)]
    return rows + [(7, "the very same vile foul text", 1, "de")] * 1000


def test_toxicity_learns_a_bounded_sample_of_repeated_ids(spark, monkeypatch):
    df = spark.createDataFrame(repeated_ids(), "doc_id long, text string, toxic int, lang string")
    labels = df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")).distinct()
    seen = []
    boost = toxicity.boost
    monkeypatch.setattr(toxicity, "boost", lambda x, y: seen.append((len(y), int(y.sum()))) or boost(x, y))
    model = toxicity.train(df, labels, per_class=200)
    assert seen[-1] == (400, 200)
    got = {r["doc_id"] % 2: r["score"] for r in toxicity.score_documents(df.where("text like '%number%'"), model).collect()}
    assert got[1] > 0.5 > got[0]


def test_languages_are_learned_from_repeated_ids(spark, monkeypatch):
    rows = [(i, t, l) for i, t, _, l in repeated_ids()] + [(3, "ein einziger Satz", "rare"), (4, "...", "none"), (4, None, "none"), (4, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    fit = langid.fit
    monkeypatch.setattr(langid, "fit", lambda x, y, langs: seen.append((langs, np.bincount(y).tolist())) or fit(x, y, langs))
    model = langid.train(df, per_lang=20)
    assert seen == [(["de", "en", "rare"], [20, 20, 1])]
    got = langid.identify(df.where("lang in ('de', 'en')"), model).join(df.select("doc_id", "text", "lang").distinct(), "doc_id").collect()
    assert got and {r["lang_pred"] for r in got} >= {"de", "en"}


def test_long_words_count(spark):
    """A word of 60 letters is learned and told apart, plain and with look-alike signs."""
    word = "x" * 30 + "y" * 30
    docs = spark.createDataFrame([(i, f"some {word if i % 2 else 'x' * 30 + 'z' * 30} text {i}") for i in range(300)], "doc_id long, text string")
    model = toxicity.train(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")))
    assert toxicity.whole(word) in model.lexicon.weights and len(toxicity.whole(word)) < 40
    x = toxicity.features(pa.array([f"a {word[:40] + '.' + word[40:]} b"]), model.lexicon)
    assert x[0, toxicity.NAMES.index("obfuscated_hits")] == 1
