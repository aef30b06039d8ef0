"""Vectors: centroids, cosine, prototypes, silhouettes, clustering, projection (NUM-03, ML-*, AGG-42, JN-22, WIN-13)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: str | Column, b: str | Column) -> Column:
    """NUM-03: scalar product in double precision."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: str | Column, floor: float = 1e-12) -> Column:
    """Euclidean length, at least ``floor``."""
    return F.greatest(F.sqrt(dot(a, a)), F.lit(floor))


def unit(a: str | Column) -> Column:
    """The vector by its length."""
    n = norm(a)
    return F.transform(F.col(a) if isinstance(a, str) else a, lambda x: x.cast("double") / n)


def cosine(a: str | Column, b: str | Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def centroids(df: DataFrame, group: str, vector: str, normalise: bool = True) -> DataFrame:
    """Mean vector of each group, of unit vectors on request; components are averaged apart, so aggregates combine early."""
    source = unit(vector) if normalise else F.col(vector)
    parts = df.select(group, F.posexplode(source).alias("i", "x")).groupBy(group, "i").agg(F.avg("x").alias("x"))
    return parts.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e.x).alias("centroid"))


def centroid_cosines(df: DataFrame, group: str, vector: str) -> DataFrame:
    """AGG-42: cosine similarity and distance of each two groups' centroids; there are few groups."""
    c = centroids(df, group, vector)
    a = c.select(F.col(group).alias("group_a"), F.col("centroid").alias("ca"))
    b = c.select(F.col(group).alias("group_b"), F.col("centroid").alias("cb"))
    both = a.join(b, F.col("group_a") < F.col("group_b"))
    return both.select("group_a", "group_b", cosine("ca", "cb").alias("similarity")).withColumn("distance", 1 - F.col("similarity"))


def nearest_prototypes(df: DataFrame, key: str, vector: str, prototypes: Sequence[tuple[str, Sequence[float]]]) -> DataFrame:
    """JN-22, ML-11, WIN-13: best prototype by cosine, its score, and the margin to the second.

    Prototypes are a fixed list in the plan, so nothing is shuffled.
    """
    own = unit(vector)
    scores = []
    for name, p in prototypes:
        size = max(sum(float(x) ** 2 for x in p) ** 0.5, 1e-12)
        scores.append(F.struct(dot("_u", F.array(*[F.lit(float(x) / size) for x in p])).alias("score"), F.lit(name).alias("label")))
    ranked = df.withColumn("_u", own).withColumn("_s", F.sort_array(F.array(*scores), asc=False))
    return ranked.select(
        key, F.get("_s", 0)["label"].alias("label"), F.get("_s", 0)["score"].alias("score"),
        (F.get("_s", 0)["score"] - F.get("_s", 1)["score"]).alias("margin"),
    )


def cosine_silhouettes(df: DataFrame, key: str, vector: str, group: str) -> DataFrame:
    """ML-03: silhouette of each vector under cosine distance, from group sums alone, no pairs.

    The mean distance to a group is one less the product with its mean unit vector.
    All groups travel as one array in one row, so no vector is copied or shuffled.
    """
    units = df.select(key, group, unit(vector).alias("u"))
    sums = centroids(units, group, "u", normalise=False).join(units.groupBy(group).agg(F.count("*").alias("n")), group)
    groups = sums.agg(F.collect_list(F.struct(F.col(group).alias("g"), "centroid", "n")).alias("gs"))
    near = units.crossJoin(F.broadcast(groups))  # one row
    distance = lambda s: 1 - dot("u", s["centroid"])
    inside = F.filter("gs", lambda s: (s["g"] == F.col(group)) & (s["n"] > 1))
    outside = F.filter("gs", lambda s: s["g"] != F.col(group))
    a = F.get(F.transform(inside, lambda s: distance(s) * s["n"] / (s["n"] - 1)), F.lit(0))
    both = near.select(key, group, a.alias("a"), F.array_min(F.transform(outside, distance)).alias("b"))
    return both.withColumn(
        "silhouette", F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    )


def silhouette(df: DataFrame, vector: str, group: str, distance: str = "cosine") -> float:
    """ML-03 through Spark's evaluator: ``cosine`` or ``squaredEuclidean``."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    ready = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), F.col(group).cast("double").alias("prediction"))
    return ClusteringEvaluator(distanceMeasure=distance).evaluate(ready)


def kmeans(df: DataFrame, key: str, vector: str, ks: Sequence[int], seeds: Sequence[int] = tuple(range(42, 52))) -> DataFrame:
    """ML-02: clusters for the ``k`` with the best silhouette, each the lowest cost of ten starts."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    ready = df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    best, score = None, -2.0
    for k in ks:
        fits = [KMeans(k=k, seed=s).fit(ready) for s in seeds]
        out = min(fits, key=lambda m: m.summary.trainingCost).transform(ready)
        found = ClusteringEvaluator().evaluate(out)
        if found > score:
            best, score = out, found
    return best.select(key, F.col("prediction").alias("cluster"))


def pca(df: DataFrame, key: str, vector: str, k: int = 2) -> DataFrame:
    """ML-04: centred principal components; the largest part of each axis is positive."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    ready = df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="v", outputCol="c").fit(ready).transform(ready)
    model = PCA(k=k, inputCol="c", outputCol="p").fit(centred)
    axes = model.pc.toArray()
    sign = [1.0 if axes[abs(axes[:, j]).argmax(), j] >= 0 else -1.0 for j in range(k)]
    out = model.transform(centred).select(key, vector_to_array("p").alias("p"))
    return out.select(key, *[(F.get("p", j) * sign[j]).alias(f"pc{j + 1}") for j in range(k)])


def truncated_svd(df: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """ML-05: the first ``k`` left singular directions times their values, from the small Gram matrix."""
    import numpy as np


    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One partial Gram matrix a task, added up batch by batch."""
        total = None
        for x in batches:
            if len(x):
                m = np.stack(x["v"].to_numpy()).astype(np.float64)
                total = m.T @ m if total is None else total + m.T @ m
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "row": list(total)})

    cells = df.select(F.col(vector).cast("array<double>").alias("v")).where("v is not null").mapInPandas(grams, "i int, row array<double>")
    total = cells.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("s")).toPandas()  # width squared
    gram = np.zeros((total["i"].max() + 1,) * 2)
    gram[total["i"], total["j"]] = total["s"]
    values, axes = np.linalg.eigh(gram)
    axes = axes[:, np.argsort(-values)[:k]]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), range(axes.shape[1])] >= 0, 1.0, -1.0)
    return df.select(key, F.array(*[dot(vector, F.array(*[F.lit(float(x)) for x in a])) for a in axes.T]).alias("reduced"))


def embedded(df: DataFrame, text: str, out: str, model: Callable[[list[str]], Sequence[Sequence[float]]], batch: int = 64) -> DataFrame:
    """ML-01: unit vectors of texts by a pluggable encoder, in Arrow batches."""
    import numpy as np

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            found = []
            for i in range(0, len(texts), batch):
                v = np.asarray(model(texts.iloc[i : i + batch].fillna("").tolist()), dtype=np.float32)
                found += list(v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12))
            yield pd.Series(found)

    return df.withColumn(out, run(text))
