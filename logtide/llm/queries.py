"""The registered queries of this package; each reads its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.llm import (
    exact, langid, licenses, mixing, mjpeg, negatives, phrases, pieces, resampling, shards, simhash, token_counts, toxicity)
from logtide.llm.batches import documents, fold


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.code_texts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op2_media_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mjpeg.store_texts(documents(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(4) == 2
    return langid.identify(documents(spark, sf_dir), ~held_out, held_out=held_out)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(documents(spark, sf_dir))


def op5_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.compare_with_next(documents(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(3) == 1
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score(documents(spark, sf_dir), labels, ~held_out, held_out=held_out)


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(documents(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.near_duplicates(documents(spark, sf_dir), width=4, distance=4)
    return classes.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.keep_one(documents(spark, sf_dir))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q for q in (
        op1_sentencepiece, op2_media_avi, op3_language_id, op4_mixing, op5_phrase_fingerprints, op6_toxicity, op7_shards,
        op8_token_counts, op9_license_scan, op10_simhash, op11_exact_dedup, op12_hard_negatives, op13_resampling)
}
ORACLES: dict[str, str] = {
    "op4_mixing": mixing.ORACLE, "op11_exact_dedup": exact.ORACLE, "op12_hard_negatives": negatives.ORACLE,
    "op13_resampling": resampling.ORACLE,
}
