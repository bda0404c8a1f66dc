"""The corpus pipeline: language ID, near-dedup, mixing, BPE.

Rows that share an id, or have none, are documents of their own in every stage; a null text has no language
and goes in the first. Extra columns are kept up to the last stage. Empty tables pass through."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import bpe, jaccard, langid, mixing
from gleaner.llm.common import materialize, partitions, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that have no language: null texts and those without a letter."""
    return langid.reject_unknown(docs, langid.learn(docs, folds=5))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of each group of near-duplicates (Jaccard similarity of five-word shingles 0.8 or more), the document with
    the smallest id: SimHash links by the trie join first, then a prefix join for the links that 64 bits can't show."""
    return jaccard.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix does (0 to 3 times), in shards, shuffled within."""
    return mixing.mixed(docs, shards=partitions(spark))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes each row: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    # Workers still hold what earlier stages loaded, so the table of words is kept smaller.
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), max_words=250_000)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("mix", mix), ("bpe", encode)]

#: Cross-parsing, XXH64 links and BPE have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each stage's rows written as Parquet and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
