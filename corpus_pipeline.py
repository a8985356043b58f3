"""Corpus pipeline: stages from raw documents to training input, in order.

Each stage works on all that the one before kept and returns the columns of
``documents`` (the last one token ids and the text they decode to). ``run``
writes every stage's result to the shared folder and reads it back, so a lost
executor costs no more than a stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.llm import langid, mixing, pieces, simhash, toxicity
from logtide.llm.batches import documents
from logtide.session import work_dir

#: Near-duplicates in the pipeline: the operator's four-word shingles, at most six of 64 bits apart.
SHINGLE, DISTANCE = 4, 6


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go; learned from all labels."""
    return toxicity.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))


def drop_unclear_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a clear language go."""
    return langid.accepted(docs, F.lit(True))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays."""
    return simhash.keep_one(docs, SHINGLE, DISTANCE)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the text they decode to."""
    return pieces.code_texts(docs, public_tokenizers.path("piece_bpe_32k.model"), with_text=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unclear_language),
    ("near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("sentencepiece", tokenize),
]

#: SQL has no language models, compression, XXH64 or subword codec; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = documents(spark, sf_dir), work_dir(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
