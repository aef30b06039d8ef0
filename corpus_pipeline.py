"""A corpus pipeline: quality, near-duplicates, benchmark leaks, personal data, packing.

Each stage takes what its predecessor kept, written as Parquet and read again. All but
the last return the columns of ``docs``, whatever their names and values, and treat
repeated rows alike; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm import decontamination, minhash, packing, pii, quality
from scholia.llm.catalogue import surrogate_key
from scholia.plans.durable import durable
from scholia.sources.tables import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labels of the folder.

    Null and empty texts are scored as one empty passage. Labels with a null document or
    value do not count; without labels every score is 0.5 and nothing is rejected.
    """
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group that shares 0.8 of its five-word shingles.

    Documents without words or without an id are in no group and stay; rows that repeat
    an id stay together.
    """
    groups = minhash.near_duplicates(docs, words=5, threshold=Fraction(4, 5))
    gone = durable(groups.where(~F.col("kept")).select("doc_id").distinct(), "copies")
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item, told by text, so that a null id does not hide one.

    Null and empty texts stay; null, empty and one-word items reject nothing.
    """
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data; their length is counted again where the text changed.

    Null and empty texts stay as they are.
    """
    done = pii.pseudonymised(docs, surrogate_key(spark))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = F.col("pii_count") > 0
        done = done.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(kind))
    return done.select(*[F.col(f"`{c}`") for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens.

    Null and empty texts are the end token alone; documents without an id and repeated
    rows are packed row by row.
    """
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Learned weights and alignments have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = durable(docs, name)
    return docs
