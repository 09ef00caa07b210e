"""A corpus pipeline: toxic documents go, one of each near-duplicate group stays, repeated passages are cut, sources are mixed to weights, and what is left is encoded.

Each stage works on all that the one before kept and returns the columns of
documents; the last one returns token ids.  Documents may have further columns
of any names.  Null or repeated ids, null, empty and very long texts and empty
tables are defined for each stage by the operator that it calls: null and empty
texts pass all stages, rows of one id are one document to the second stage and
are judged, mixed and encoded one by one by the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import bpe, mixing, neardup, substrings, toxicity
from quillgraph.llm.common import discard, read_table, written

#: Percent of common five-word shingles from which on two documents are near-duplicates.
SIMILAR = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from these documents and the labels, doesn't reject; a null text counts as an empty one."""
    return toxicity.without_toxic(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each near-duplicate group, linked from SIMILAR percent of common shingles on; texts without words and null ids all stay."""
    return neardup.one_of_each(docs, SIMILAR)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that stand in a document of smaller id; a text of which nothing is left goes."""
    return substrings.cut_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document, cut texts where it takes a part; documents without words stay once, a null source is a source."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and digests of each row; a null or empty text has none."""
    import public_tokenizers

    return bpe.encode_documents(docs, bpe.load_spec(public_tokenizers.path("word_bpe_49k.json")), ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_substrings", cut_repeats),
    ("mix_sources", mix_sources),
    ("bpe", encode),
]

#: The learned model and the suffix arrays have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
