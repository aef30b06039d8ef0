"""Dynamic topics: assignment, words, shares, growth, selection (ML-06, ML-07, ML-13, AGG-40, AGG-65)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.operators import metrics, textmine, vectors


def topic_model(docs: DataFrame, key: str, vector: str, terms: str, k: int, words: int = 10, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """ML-06: documents with topics, and topics with their words.

    Density clustering of a learned layout has no distributed form here; k-means on
    the vectors stands in, and words come from TF-IDF means, as documented.
    """
    placed = vectors.kmeans(docs, key, vector, [k], [seed]).withColumnRenamed("cluster", "topic")
    weights = textmine.tfidf(docs, key, terms, min_df=2, max_df=0.85)
    return placed, textmine.top_terms(weights, placed, key, "topic", words).select("topic", "term", "rank")


def shares_by_year(placed: DataFrame, topic: str = "topic", year: str = "year", incomplete: Sequence[int] = ()) -> DataFrame:
    """AGG-10, FLT-12, JN-10: share of each topic in each year, without outliers (-1) and incomplete years if any other is left."""
    rows = placed.where((F.col(topic) != -1) & F.col(year).isNotNull())
    if incomplete:
        whole = rows.where(~F.col(year).isin(list(incomplete)))
        rows = rows if whole.isEmpty() else whole
    return metrics.shares(rows, [year], topic).withColumn("share", F.col("n") / F.col("total"))


def shown_topics(shares: DataFrame, n: int, least: int = 100) -> DataFrame:
    """SRT-05: the largest topics, ``max(8, n // 2)`` of them, then the fastest growing of at least ``least`` documents."""
    totals = shares.groupBy("topic").agg(F.sum("n").alias("total_n"))
    rise = metrics.topic_growth(shares).join(totals, "topic")
    big = metrics.top_per_group(rise.withColumn("_", F.lit(1)), ["_"], [F.desc("total_n"), "topic"], max(8, n // 2))
    fast = metrics.top_per_group(rise.where(F.col("total_n") >= least).withColumn("_", F.lit(1)), ["_"], [F.desc("growth_ratio"), "topic"], n)
    return metrics.ordered_union([big, fast], "topic", n)


def selection_score(n_topics: float, outlier_rate: float, coherence: float, diversity: float, wanted: tuple[int, int] = (20, 80)) -> float:
    """AGG-65: coherence and diversity, less outliers and distance from the wanted number of topics."""
    low, high = wanted
    off = max(0.0, (low - n_topics) / low, (n_topics - high) / high)
    return coherence + 0.5 * diversity - 0.5 * outlier_rate - 0.25 * off


def leaderboard(grid: dict[str, Iterable], run) -> list[dict]:
    """ML-07: results of ``run(**parameters)`` for each combination, best ``selection_score`` first, errors last."""
    rows = []
    for values in product(*grid.values()):
        parameters = dict(zip(grid, values, strict=True))
        try:
            rows.append(parameters | run(**parameters) | {"error": None})
        except Exception as e:  # one bad setting does not end the search
            rows.append(parameters | {"selection_score": float("-inf"), "error": str(e)})
    return sorted(rows, key=lambda r: -r["selection_score"])


def topics_over_time(docs: DataFrame, placed: DataFrame, key: str, year: str, terms: str, k: int = 5) -> DataFrame:
    """ML-13: the leading terms of each topic in each year."""
    both = placed.join(docs.select(key, year), key).withColumn("cell", F.struct("topic", year))
    weights = textmine.tfidf(docs, key, terms, min_df=2)
    return textmine.top_terms(weights, both, key, "cell", k).select("cell.*", "term", "rank", "mean_w")
