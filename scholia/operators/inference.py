"""Batch inference with pluggable models: resume, repair, dedupe, split on failure (ML-08 to ML-12, JN-06)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Model = Callable[[list[str]], list[str]]


def answered(rows: DataFrame, key: str, text: str, model: Model, batch: int = 8, out: str = "raw_output") -> DataFrame:
    """Raw answers for every row; blank texts give null and are not sent."""
    kind = dict(rows.dtypes)[key]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in parts:
            result = pd.Series([None] * len(b), index=b.index, dtype=object)
            asked = b.index[b[text].fillna("").str.strip() != ""]
            for i in range(0, len(asked), batch):
                some = asked[i : i + batch]
                result.loc[some] = model(b.loc[some, text].tolist())
            yield pd.DataFrame({key: b[key], out: result})

    return rows.select(key, text).mapInPandas(run, f"{key} {kind}, {out} string")


def resumed(rows: DataFrame, done: DataFrame | None, key: str) -> DataFrame:
    """STM-01: rows whose key has no result yet."""
    return rows if done is None else rows.join(done.select(key).distinct(), key, "left_anti")


def with_checkpoint(rows: DataFrame, done: DataFrame, key: str, defaults: dict) -> DataFrame:
    """JN-06: results beside their rows, defaults where there is none."""
    return rows.join(done, key, "left").na.fill(defaults)


def on_distinct(rows: DataFrame, inputs: Sequence[str], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """ML-09, memoised calls: evaluate on distinct inputs and join the results back."""
    return rows.join(run(rows.select(*inputs).distinct()), list(inputs), "left")


def concurrent_batches(rows: DataFrame, key: str, text: str, model: Model, default: str, batch: int = 20, workers: int = 16) -> DataFrame:
    """ML-09: batches sent side by side within a task; a batch that fails is halved, a lone failure gets the default."""
    kind = dict(rows.dtypes)[key]

    def ask(texts: list[str]) -> list[str]:
        try:
            found = model(texts)
            if len(found) == len(texts):
                return found
        except Exception:  # any failure of a remote model halves the batch
            pass
        if len(texts) == 1:
            return [default]
        half = len(texts) // 2
        return ask(texts[:half]) + ask(texts[half:])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(workers) as pool:
            for b in parts:
                texts = b[text].fillna("").tolist()
                found = pool.map(ask, [texts[i : i + batch] for i in range(0, len(texts), batch)])
                yield pd.DataFrame({key: b[key], "result": [x for part in found for x in part]})

    return rows.select(key, text).mapInPandas(run, f"{key} {kind}, result string")


def repaired(rows: DataFrame, key: str, text: str, raw: str, parse: Callable, model: Model, rounds: int = 3) -> DataFrame:
    """ML-10: labels from stored answers, then from up to ``rounds`` new answers for those that cannot be read.

    ``parse`` turns a column of answers into labels. Each round's rows are kept in the
    shared folder, so no answer is asked for twice.
    """
    from scholia.plans.durable import durable

    current = durable(rows.select(key, text, raw).withColumn("label", parse(F.col(raw))).withColumn("round", F.lit(0)), "answers")
    done = current.where("label is not null")
    open_rows = current.where("label is null")
    for k in range(1, rounds + 1):
        if open_rows.isEmpty():
            break
        fresh = answered(open_rows, key, text, model, out="_new")
        current = open_rows.select(key, text, raw).join(fresh, key, "left")
        current = durable(
            current.select(key, text, F.coalesce("_new", raw).alias(raw)).withColumn("label", parse(F.col(raw))).withColumn("round", F.lit(k)), "answers"
        )
        done = done.unionByName(current.where("label is not null"))
        open_rows = current.where("label is null")
    return done.unionByName(open_rows).select(key, raw, "label", "round", F.col("label").isNotNull().alias("parse_ok"))


def named_topics(topics: DataFrame, model: Model) -> DataFrame:
    """ML-12: a short name for each topic from its words by a pluggable model."""
    words = topics.groupBy("topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda e: e.term), ", ").alias("words"))
    return answered(words, "topic", "words", model, out="name")
