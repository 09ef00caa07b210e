"""The corpus pipeline: every stage does its work on what the one before kept."""

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillgraph.llm import mixing, neardup, toxicity
from quillgraph.llm.common import written

SF = "/root/testdata/sf0.001"


def plain_cut(rows):
    """(id, text) without the bytes that a 50-byte string of a smaller id's text covers; a character that loses a byte goes, and so does a text of which nothing is left."""
    first, out = {}, []
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(i, first.get(b[p : p + 50], i))
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        at, left = 0, []
        for c in t or "":
            n = len(c.encode())
            if not any(gone[at : at + n]):
                left.append(c)
            at += n
        if not b or left:
            out.append((i, t if not any(gone) else "".join(left)))
    return sorted(out, key=str)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_substrings", "mix_sources", "bpe"]
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    clean = {r["doc_id"] for r in toxicity.score_documents(docs, model).collect() if not r["predicted"]}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, SF), "test-stage")
        kept[name] = docs
        if name != "bpe":
            assert docs.schema == before.schema
        if name == "toxicity":
            assert {r["doc_id"] for r in docs.collect()} == clean
        if name == "near_duplicates":
            want = {r["component_id"] for r in neardup.near_duplicates(before, percent=corpus_pipeline.SIMILAR).collect()}
            assert {r["doc_id"] for r in docs.collect()} == want
        if name == "repeated_substrings":
            longer = docs.alias("a").join(before.alias("b"), "doc_id").where("length(a.text) > length(b.text)")
            assert longer.count() == 0
            assert {r["doc_id"] for r in docs.collect()} <= {r["doc_id"] for r in before.collect()}
            got = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str)
            assert got == plain_cut([(r["doc_id"], r["text"]) for r in before.collect()])
        if name == "mix_sources":
            taken = {r["doc_id"]: r["taken"] for r in mixing.mix(before).collect()}
            got = docs.groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("n")).collect()
            assert {r["doc_id"]: r["n"] for r in got} == {k: v for k, v in taken.items() if v}
    assert kept["bpe"].count() == kept["mix_sources"].count() > 0
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    mixed = [(r["doc_id"], r["text"] or "") for r in kept["mix_sources"].collect()]
    ids = [e.ids for e in library.encode_batch([t for _, t in mixed], add_special_tokens=False)]
    assert sorted((r["doc_id"], r["ids"]) for r in kept["bpe"].collect()) == sorted((d, i) for (d, _), i in zip(mixed, ids))


ODD = [
    (1, "", "x", "en", 0), (2, None, None, None, None), (3, " \n\t", "x", "en", 3), (4, "a", "y", "en", 1), (4, "a", "y", "en", 1), (4, "b c", "y", "de", 3), (None, "x y z", "x", None, 5),
    (5, "word " * 30000, "y", "en", 150000), (6, "é中 <|endoftext|> #\n" * 3, "x", "fr", 60), (7, "you stupid idiot, you moron", "x", "en", 27), (8, "one two three four five six seven", "x", "en", 33), (9, "One two three four five six seven", "x", "en", 33),
]


def odd(spark, n=None):
    """Odd rows with columns whose names clash with those that stages use."""
    df = spark.createDataFrame(ODD[:n], "doc_id long, text string, source string, lang string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in ("id", "n", "score", "taken", "size", "chunk", "kept", "c0", "_size", "component_id", "ids")})


def test_stages_of_odd_rows(spark):
    docs, columns = odd(spark), odd(spark).columns
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "test-odd")
        left[name] = docs.collect()
        if name != "bpe":
            assert docs.columns == columns
    ids = lambda name: sorted((r["doc_id"] for r in left[name]), key=str)
    assert ids("toxicity") == sorted((r[0] for r in ODD if r[0] != 7), key=str)
    # of the texts that are alike but for a capital the smaller id stays; rows of one id are one document
    assert ids("near_duplicates") == ids("repeated_substrings") == sorted((r[0] for r in ODD if r[0] not in (7, 9)), key=str)
    assert all(r["n_tokens"] == len(r["ids"]) for r in left["bpe"])


def test_stages_of_nothing(spark):
    docs = odd(spark, 1).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "test-none")
        assert docs.count() == 0
