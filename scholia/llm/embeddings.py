"""Near-duplicate vectors within labels.

Method: spherical k-means assigns vectors to cells, blocked cosine products compare
within cells, and one representative per group is kept. The cells lose no pair. For
two vectors within the threshold whose home cells differ, the line between the cells
cuts the stretch between them, which is at most ``reach`` long, so one of the two lies
within half of ``reach`` of that line: a vector visits every cell whose line is that
near, and the pair meets in the home of the other. A pair that meets in both homes
counts in the lower one. Equal vectors are compared once. A cell is compared in blocks,
whose tasks return counts and a spanning forest, never pairs.

The cells are fitted on a bounded sample (``SAMPLE`` vectors, the smallest by a hash
of their ids); they decide speed, not results. Their number grows with the square root
of the vectors of a label, from ``LEAST_CELLS`` to ``MOST_CELLS``. Vectors in clusters
visit about one cell each; vectors that spread evenly in many dimensions lie near many
lines, and then the work of a label is a share of all its pairs, as no exact method
by distances can avoid.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.operators.components import connected_components
from scholia.plans.durable import durable

SAMPLE = 20_000
LEAST_CELLS, MOST_CELLS = 16, 1_024
BLOCK = 1_024
#: Vectors that a task deals to their cells at a time.
DEALT = 500


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """Unit centroids of unit rows, from farthest-first seeds."""
    draw = np.random.default_rng(seed)
    centres = [x[draw.integers(len(x))]]
    near = x @ centres[0]
    for _ in range(1, k):
        gap = np.maximum(1 - near, 0) + 1e-12
        centres.append(x[draw.choice(len(x), p=gap / gap.sum())])
        near = np.maximum(near, x @ centres[-1])
    c = np.stack(centres)
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.maximum(norm, 1e-300), c)
    return c


def visits(near: np.ndarray, centres: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Own cell of each vector, and which cells it must be in, from its cosines to the centres."""
    spread = np.sqrt(np.maximum(0, 2 - 2 * (centres @ centres.T)))
    own = near.argmax(axis=1)
    best = near[np.arange(len(near)), own]
    goes = (best[:, None] - near) <= reach / 2 * spread[own] + 1e-9
    goes[np.arange(len(near)), own] = True
    return own, goes


def reach_of(threshold: float) -> float:
    """How far unit vectors within the threshold may lie apart."""
    return float(np.sqrt(max(0.0, 2 - 2 * threshold)))


def cells_for(n: int, labels: int) -> int:
    """Number of cells for ``n`` vectors of ``labels`` labels."""
    return int(min(MOST_CELLS, max(LEAST_CELLS, np.sqrt(n / max(1, labels)) / 2)))


def _units(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, digest, unit`` of the vectors that can be linked; vectors of another length are another label."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, label, v in zip(b["vec_id"], b["label"], b["embedding"], strict=True):
                v = np.array([np.nan if c is None else c for c in v], dtype=np.float64)
                top = np.abs(v).max() if len(v) else 0.0
                if np.isfinite(v).all() and top > 0:
                    v = v / top  # no overflow in the norm
                    v = v / np.sqrt(v @ v)
                    rows.append((i, f"{len(v)}:{label}", xxhash.xxh3_128_digest(v.tobytes()), v))
            yield pd.DataFrame(rows, columns=["vec_id", "label", "digest", "unit"])

    usable = vectors.where("vec_id is not null and label is not null and embedding is not null")
    return usable.mapInPandas(run, "vec_id long, label string, digest binary, unit array<double>")


def _dealt(units: DataFrame, centres: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """Each vector once in its own cell and once in each cell that it must visit, with all its cells."""
    reach = reach_of(threshold)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = [p.iloc[i : i + DEALT] for _, p in b.groupby(b["unit"].map(len)) for i in range(0, len(p), DEALT)]
            for part in parts:  # a vector may have many copies
                width = len(part["unit"].iloc[0])
                own, goes = visits(np.stack(part["unit"].to_numpy()) @ centres[width].T, centres[width], reach)
                row, cell = np.nonzero(goes)
                out = part.iloc[row].copy()
                out["cell"], out["home"] = cell.astype(np.int32), own[row].astype(np.int32)
                lists = [np.flatnonzero(g).astype(np.int32) for g in goes]
                out["cells"] = [lists[r] for r in row]
                yield out

    return units.mapInPandas(run, "rep long, label string, m long, unit array<double>, cell int, home int, cells array<int>")


def forest(left: np.ndarray, right: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges from each linked vector to the smallest of its component within a block pair."""
    rows, cols = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
    if not len(rows):
        return []
    part = linked[np.ix_(rows, cols)]
    a, b = left[rows].copy(), right[cols].copy()
    top = np.iinfo(np.int64).max
    while True:
        new_b = np.minimum(b, np.where(part, a[:, None], top).min(axis=0))
        new_a = np.minimum(a, np.where(part, new_b[None, :], top).min(axis=1))
        if (new_a == a).all() and (new_b == b).all():
            break
        a, b = new_a, new_b
    pairs = np.concatenate((np.stack((left[rows], a), 1), np.stack((right[cols], b), 1)))
    return [tuple(p) for p in np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)]


def near_vectors(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", blocks_of: int = BLOCK, cells: int | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every vector.

    Vectors of one label are linked when their cosine in double precision is at least
    ``threshold``; vectors of different lengths never are. Vectors that are null,
    empty, zero or hold null or non-finite components, and vectors without a label,
    have no links, are their own component and are kept, and so is a row without an id. Rows that repeat an id are one vector if their vectors
    are equal, and are reported row by row; different vectors under one id are one node
    with the links of both. An empty table gives none; other columns play no part.
    """
    vectors = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(vector_col).cast("array<double>").alias("embedding"),
        F.col(label_col).cast("string").alias("label"),
    )
    units = durable(_units(vectors), "units")
    distinct = units.groupBy("label", "digest", "vec_id").agg(F.first("unit").alias("unit"))
    reps = durable(
        distinct.groupBy("label", "digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"), F.first("unit").alias("unit")), "distinct"
    )
    sample = reps.select("rep", "unit").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).toPandas()
    centres = {}
    if len(sample):
        n, labels = reps.agg(F.count("*"), F.count_distinct("label")).first()
        wanted = cells or cells_for(n, labels)
        for width, part in sample.groupby(sample["unit"].map(len)):
            centres[width] = spherical_kmeans(np.stack(part["unit"].to_numpy()), min(wanted, len(part)))
        # A length that the sample misses is one cell.
        for r in reps.select(F.size("unit").alias("w")).distinct().collect():  # a row a length
            centres.setdefault(r["w"], np.full((1, r["w"]), 1 / np.sqrt(r["w"])))
    dealt = durable(_dealt(reps.select("rep", "label", "m", "unit"), centres, threshold), "dealt")
    at_home = F.col("cell") == F.col("home")
    sizes = dealt.groupBy("label", "cell").agg(
        F.ceil(F.count_if(at_home) / F.lit(blocks_of)).cast("int").alias("homes"), F.ceil(F.count("*") / F.lit(blocks_of)).cast("int").alias("alls")
    )
    sized = dealt.join(sizes.where("homes > 0"), ["label", "cell"])
    hashed = F.xxhash64("rep")
    columns = ["label", "cell", "rep", "m", "unit", "home", "cells"]
    left = sized.where(at_home).select(
        *columns, F.lit(True).alias("left"),
        F.pmod(hashed, "homes").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("alls") - 1)).alias("j"),
    )
    right = sized.select(
        *columns, F.lit(False).alias("left"),
        F.explode(F.sequence(F.lit(0), F.col("homes") - 1)).alias("i"), F.pmod(F.shiftright(hashed, 7), "alls").cast("int").alias("j"),
    )

    def compare(b: pd.DataFrame) -> pd.DataFrame:
        a, z = b[b["left"]], b[~b["left"]]
        empty = pd.DataFrame({"rep": [], "other": [], "n": []}, dtype="int64")
        if not len(a) or not len(z):
            return empty
        cell = int(b["cell"].iloc[0])
        one, two = a["rep"].to_numpy(), z["rep"].to_numpy()
        linked = np.stack(a["unit"].to_numpy()) @ np.stack(z["unit"].to_numpy()).T >= threshold
        linked &= one[:, None] != two[None, :]
        if not linked.any():
            return empty
        # A visitor meets a vector here and, where that one visits back, in the visitor's home too: the lower cell counts.
        homes = z["home"].to_numpy()
        visitor = homes != cell
        for h in np.unique(homes[visitor & (homes < cell) & linked.any(axis=0)]):
            back = np.array([h in c for c in a["cells"]])
            linked[np.ix_(back, homes == h)] = False
        n = linked @ z["m"].to_numpy()
        back_n = a["m"].to_numpy() @ linked[:, visitor]
        rows = [(int(u), int(u), int(k)) for u, k in zip(one, n, strict=True) if k]
        rows += [(int(u), int(u), int(k)) for u, k in zip(two[visitor], back_n, strict=True) if k]
        rows += [(u, v, 0) for u, v in forest(one, two, linked)]
        return pd.DataFrame(rows, columns=["rep", "other", "n"], dtype="int64")

    # Blocks are dealt one by one; by label and cell alone, as they were counted, a hot cell would be one task.
    blocks = left.unionByName(right).repartition("label", "cell", "i", "j")
    found = durable(
        blocks.groupBy("label", "cell", "i", "j").applyInPandas(compare, "rep long, other long, n long"),
        "found",
    )
    counted = found.groupBy("rep").agg(F.sum("n").alias("n"))
    parts = connected_components(found.select("rep", "other"), "rep", "other").withColumnRenamed("node", "rep")
    named = durable(
        reps.select("label", "digest", "rep", "m").join(counted, "rep", "left").join(parts, "rep", "left")
        .select("label", "digest", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")),
        "named",
    )
    linkable = units.select("vec_id", "label", "digest").join(named, ["label", "digest"])
    placed = linkable.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    return (
        vectors.select("vec_id")
        .join(placed, "vec_id", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
