"""A training corpus from the documents: filter, deduplicate, mix, encode.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's ``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm import byte_bpe, minmax, mixing, suffix_dedup, toxicity
from panelloom.llm.common import table
from panelloom.session import scratch_path

TOXIC_FROM = 0.3
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
# Repeated passages of more than 50 words go.
PASSAGE_WORDS = 51


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose toxicity score reaches ``TOXIC_FROM``; the lexicon is learned from the labels."""
    lexicon = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, lexicon, TOXIC_FROM)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the least doc_id."""
    return minmax.one_of_each(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that come up more than once go from every document, and so do strings of 400 bytes with
    fewer words; the documents stay."""
    return suffix_dedup.shortened(docs, words=PASSAGE_WORDS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them."""
    return mixing.mix(docs)


def stored(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    path = scratch_path(spark, "pipeline")
    df.write.parquet(path)
    return spark.read.parquet(path)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, n_tokens, ids, round_trip``: the identifiers, and whether they decode to the text's bytes.

    Each step is written: chained, every task would hold one Python worker for each of them, and Spark keeps them all.
    """
    keyed = docs.select("doc_id", "source", "text", F.expr("sha2(CAST(coalesce(text, '') AS BINARY), 256)").alias("digest"))
    packed = stored(spark, byte_bpe.encode(keyed, ["doc_id", "source", "digest"])).withColumn("packed", F.col("ids"))
    decoded = byte_bpe.decode(packed, ["doc_id", "source", "digest", "n_tokens", "packed"])
    checked = decoded.selectExpr("doc_id", "source", "n_tokens", "packed AS ids", "sha2(decoded, 256) = digest AS round_trip")
    return byte_bpe.unpacked(stored(spark, checked))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("mixing to target weights", mix_sources),
    ("byte-level BPE", encode),
]

# The stages learn, hash and encode; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(spark, stage(spark, docs, sf_dir))
    return docs
