"""Queries of the corpus operators, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from scholia.llm import decontamination, embeddings, lattice, licences, minhash, oracles, packing, pii, quality, sharding, substring
from scholia.sources.tables import table

PIECES = public_tokenizers.path("piece_bpe_32k.model")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def surrogate_key(spark: SparkSession) -> str:
    """The key of the surrogates: a deployment sets ``spark.scholia.surrogates.key``; test tables need no secret."""
    return spark.conf.get("spark.scholia.surrogates.key", "for test tables only")


def op1_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, folder, "embeddings"), threshold=0.93)


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring.without_repeats(table(spark, folder, "documents"), window=20)


def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), TOKENIZER)


def op4_pii_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    done = pii.pseudonymised(table(spark, folder, "documents").select("doc_id", "text"), surrogate_key(spark))
    return done.select("doc_id", "pii_count", "pii_kinds", "text")


def op5_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality.fit_quality(docs, table(spark, folder, "labels"))
    return quality.score_quality(docs, model)


def op6_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op7_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"), words=3, threshold=Fraction(85, 100))


def op8_lattice_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lattice.lattice_scores(table(spark, folder, "documents"), PIECES)


def op9_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licences.licence_report(table(spark, folder, "documents"))


def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_report(table(spark, folder, "documents"), shards=40)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_pii_surrogates": op4_pii_surrogates,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_lattice_scoring": op8_lattice_scoring,
    "op9_licence_scan": op9_licence_scan,
    "op10_sharding": op10_sharding,
}
#: The others rest on learned weights, a tokenizer, alignments or random draws, and are
#: tested against plain versions, round trips and held-out documents.
ORACLES: dict[str, str] = {
    "op1_embedding_near_dedup": oracles.OP1,
    "op2_substring_dedup": oracles.OP2,
    "op7_minhash_near_dedup": oracles.OP7,
}
