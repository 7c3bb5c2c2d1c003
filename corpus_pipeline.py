"""The corpus pipeline: stages over the documents table, each written as Parquet and read again by the next.

Toxic documents go, lines that many documents share stay in one of them, one document of each near-duplicate group stays, sources
are repeated or thinned to their target weights, and what is left is encoded. Every stage works on all rows that the one
before it kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import bpe, chosen_path, line_dedup, mixing, toxicity
from lacuna.llm.common import arrow_rows, stage, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, trained on the learning folds of the labels, scores below the threshold."""
    net = toxicity.trained(docs, table(spark, sf_dir, "labels"), toxicity.learning_rows(F.col("doc_id")))
    return toxicity.scored(docs, net).where(F.col("__score") < toxicity.THRESHOLD).select(*[docs[c] for c in docs.columns])


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them; every document stays, with what is left of its text."""
    out = line_dedup.dedup_lines(docs)
    return out.select(*[out[c] for c in docs.columns])


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, and all documents outside groups."""
    return chosen_path.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that each source comes near its target."""
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the digest of the bytes that they decode to: doc_id, source, n_tokens, ids and decoded_sha256.

    Ids are written before they are decoded: in one plan each core would hold two Python workers. Texts go to them in small batches."""
    with arrow_rows(spark, 500):
        ids = stage(bpe.encode_documents(docs.select("doc_id", "source", "text")).select("doc_id", "source", "__ids"), "ids")
    out = bpe.decode_documents(ids, "__ids")
    return out.select("doc_id", "source", F.size("__ids").cast("long").alias("n_tokens"), F.col("__ids").alias("ids"), F.sha2("__bytes", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_shared_lines),
    ("ngram_join", without_near_copies),
    ("mixing", mixed),
    ("byte_bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name)
    return docs


#: The first stage scores with a trained network, which SQL can't express; the tests hold each stage against plain Python.
ORACLE_SQL = None
