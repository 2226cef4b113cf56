"""From raw documents to token ids: five stages over the whole collection.

Each stage is a function ``(spark, docs, sf_dir) -> DataFrame``; what it returns is
written and read again as the documents of the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagworth.llm import line_dedup, mixing, near_dedup, quality_kn, sentencepiece_viterbi
from tagworth.llm.common import stage

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_kn.quality_scores(docs, labels).where("kept").select(*DOCUMENT)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that three or more of them share; none is dropped."""
    out = line_dedup.line_dedup(docs, min_chars=20, min_docs=3)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*DOCUMENT)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup.one_per_group(docs, percent=75).select(*DOCUMENT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of nine tenths of the tokens, towards the target shares."""
    return mixing.mix(docs, keep=0.9).where("selected").select(*DOCUMENT)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents that are left, and whether they decode to the text."""
    return sentencepiece_viterbi.encoded_and_checked(docs).select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids", "round_trip")


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("MinHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", encoded),
]

# SQL cannot state the classifier and the encoder; tests/llm holds every stage against a
# brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, fn in STAGES:
        docs = stage(fn(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
    return docs
