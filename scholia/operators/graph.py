"""Pairs, projections, PMI, communities and their measures (GRF-*, JN-20, JN-21, AGG-43 to AGG-50).

Edges are ``src < dst`` with a weight; partitions are ``node, community``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

from scholia.operators import communities
from scholia.operators.components import connected_components
from scholia.operators.dedup import dense_numbers
from scholia.plans.durable import durable

#: Nodes up to which Louvain's vectors go to every task: 1 GB each there.
VECTOR_NODES = 50_000_000


def pairs(df: DataFrame, group: str, item: str, min_weight: int = 1, max_group: int | None = None) -> DataFrame:
    """JN-20, JN-21: ``src, dst, weight``: how many groups hold both items.

    Items count once a group. ``max_group`` leaves out larger groups on request; it is
    off by default, so results are whole.
    """
    rows = df.where(F.col(item).isNotNull()).select(group, item).distinct()
    if max_group is not None:
        rows = rows.withColumn("_n", F.count("*").over(Window.partitionBy(group))).where(F.col("_n") <= max_group).drop("_n")
    return pair_rows(rows, group, item).groupBy("src", "dst").agg(F.count("*").alias("weight")).where(F.col("weight") >= min_weight)


def pair_rows(rows: DataFrame, group: str, item: str) -> DataFrame:
    """``src, dst``: a row for each group that holds both of a pair of items; ``rows`` are distinct."""
    a, b = rows.withColumnRenamed(item, "src"), rows.withColumnRenamed(item, "dst")
    return a.join(b, group).where("src < dst").select("src", "dst")


def item_counts(df: DataFrame, group: str, item: str) -> DataFrame:
    """The diagonal of a co-occurrence matrix: groups of each item."""
    return df.where(F.col(item).isNotNull()).groupBy(F.col(item).alias("node")).agg(F.count_distinct(group).alias("n"))


def pmi(edges: DataFrame, counts: DataFrame, groups: int | DataFrame, eps: float = 1e-12, normalised: bool = True) -> DataFrame:
    """AGG-43: pointwise mutual information of pairs, divided by ``-log p(x, y)`` if normalised.

    ``groups`` is their number or a one-row frame with ``n_groups``; 0 where a probability is 0.
    """
    a = counts.select(F.col("node").alias("src"), F.col("n").alias("na"))
    b = counts.select(F.col("node").alias("dst"), F.col("n").alias("nb"))
    both = edges.join(a, "src").join(b, "dst")
    both = both.withColumn("n_groups", F.lit(groups)) if isinstance(groups, int) else both.crossJoin(F.broadcast(groups))  # one row
    p, q = F.col("weight") / F.col("n_groups"), F.col("na") * F.col("nb") / (F.col("n_groups") * F.col("n_groups"))
    value = F.log(p / q + eps)
    if normalised:
        value = value / -F.log(p + eps)
    return both.withColumn("pmi", F.when((p > 0) & (q > 0), value).otherwise(0.0)).drop("na", "nb", "n_groups")


def over_threshold(edges: DataFrame, threshold: float, weight: str = "weight") -> DataFrame:
    """FLT-13, GRF-02: edges strictly over a threshold, no loops."""
    return edges.where((F.col(weight) > threshold) & (F.col("src") != F.col("dst")))


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """GRF-08: ``node, degree, strength``; with ``nodes`` also those without an edge."""
    ends = edges.select(F.col("src").alias("node"), "weight").unionByName(edges.select(F.col("dst").alias("node"), "weight"))
    found = ends.groupBy("node").agg(F.count("*").alias("degree"), F.sum("weight").cast("double").alias("strength"))
    return found if nodes is None else nodes.join(found, "node", "left").na.fill(0, ["degree", "strength"])


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """GRF-01, GRF-03: ``node, component`` by smallest node; with ``nodes`` also lone ones."""
    found = connected_components(edges)
    return found if nodes is None else nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def network_summary(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """AGG-44: nodes, edges, components, giant size and fraction, mean degree, density, in one row."""
    sizes = components(edges, nodes).groupBy("component").agg(F.count("*").alias("size"))
    parts = sizes.agg(F.count("*").alias("components"), F.max("size").alias("giant_size"), F.sum("size").alias("nodes"))
    n, m = F.col("nodes"), F.col("edges")
    return (
        parts.crossJoin(edges.agg(F.count("*").alias("edges")))  # one row each
        .withColumn("giant_fraction", F.col("giant_size") / n)
        .withColumn("mean_degree", 2 * m / n)
        .withColumn("density", F.when(n > 1, 2 * m / (n * (n - 1))).otherwise(0.0))
    )


def network_over_time(df: DataFrame, group: str, item: str, year: str) -> DataFrame:
    """WIN-11: nodes, edges and mean degree of the graph up to each year, from each one's first year."""
    rows = df.where(F.col(item).isNotNull()).groupBy(group, item).agg(F.min(year).alias("year"))
    a = rows.withColumnRenamed(item, "src")
    b = rows.select(group, F.col(item).alias("dst"), F.col("year").alias("_y"))
    born = a.join(b, group).where("src < dst").groupBy("src", "dst").agg(F.min(F.greatest("year", "_y")).alias("year"))
    new = (
        rows.groupBy(item).agg(F.min("year").alias("year")).groupBy("year").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("m"))
    ).unionByName(born.groupBy("year").agg(F.lit(0).cast("long").alias("n"), F.count("*").alias("m")))
    yearly = new.groupBy("year").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    w = Window.orderBy("year").rowsBetween(Window.unboundedPreceding, 0)  # one row a year
    return yearly.select("year", F.sum("n").over(w).alias("nodes"), F.sum("m").over(w).alias("edges")).withColumn(
        "mean_degree", 2 * F.col("edges") / F.col("nodes")
    )


def community_graph(edges: DataFrame, partition: DataFrame) -> tuple[DataFrame, DataFrame]:
    """AGG-45: communities with ``size, internal_weight``, and weights between communities."""
    a = partition.select(F.col("node").alias("src"), F.col("community").alias("ca"))
    b = partition.select(F.col("node").alias("dst"), F.col("community").alias("cb"))
    named = edges.join(a, "src").join(b, "dst")
    inside = named.where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum("weight").cast("double").alias("internal_weight"))
    sizes = partition.groupBy("community").agg(F.count("*").alias("size")).join(inside, "community", "left").na.fill(0, ["internal_weight"])
    between = (
        named.where("ca <> cb")
        .groupBy(F.least("ca", "cb").alias("src"), F.greatest("ca", "cb").alias("dst"))
        .agg(F.sum("weight").cast("double").alias("weight"))
    )
    return sizes, between


def collapsed(sizes: DataFrame, between: DataFrame, n: int, least: int = 0) -> tuple[DataFrame, DataFrame]:
    """AGG-46: the ``n`` largest communities, all others (of at least ``least``) as ``other`` -1."""
    ranked = sizes.where(F.col("size") >= least)
    top = ranked.orderBy(F.desc("size"), "community").limit(n).select("community", F.col("community").alias("into"))
    named = ranked.select("community", "size", "internal_weight").join(F.broadcast(top), "community", "left")
    named = named.withColumn("into", F.coalesce("into", F.lit(-1)))
    key = named.select("community", "into")
    edges = (
        between.join(key.select(F.col("community").alias("src"), F.col("into").alias("a")), "src")
        .join(key.select(F.col("community").alias("dst"), F.col("into").alias("b")), "dst")
        .select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "weight")
    )
    within = edges.where("src = dst").groupBy(F.col("src").alias("into")).agg(F.sum("weight").alias("w"))
    nodes = named.groupBy("into").agg(F.sum("size").alias("size"), F.sum("internal_weight").alias("internal_weight"))
    nodes = nodes.join(within, "into", "left").select(
        F.col("into").alias("community"), "size", (F.col("internal_weight") + F.coalesce("w", F.lit(0.0))).alias("internal_weight")
    )
    return nodes, edges.where("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def community_summary(partition: DataFrame, counts: DataFrame, k: int = 10) -> DataFrame:
    """GRF-06: labels of each community from the most frequent on, the first ``k`` and all."""
    named = partition.join(counts, "node", "left")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.coalesce("n", F.lit(0))).alias("o"), "node"))), lambda e: e.node)
    return (
        named.groupBy("community")
        .agg(F.count("*").alias("n_labels"), ordered.alias("_all"))
        .select("community", "n_labels", F.array_join(F.slice("_all", 1, k), "; ").alias("top_labels"), F.array_join("_all", "; ").alias("all_labels"))
    )


def community_examples(partition: DataFrame, counts: DataFrame, rows: DataFrame, group: str, item: str, labels: int = 5, ids: int = 5, most: int = 20) -> DataFrame:
    """GRF-07: ids of the first groups of each community's first labels, without repeats."""
    top = partition.join(counts, "node").withColumn("_r", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("n"), "node")))
    firsts = rows.select(F.col(item).alias("node"), F.col(group).alias("id")).distinct()
    firsts = firsts.withColumn("_i", F.row_number().over(Window.partitionBy("node").orderBy("id"))).where(F.col("_i") <= ids)
    joined = top.where(F.col("_r") <= labels).join(firsts, "node")
    return joined.groupBy("community").agg(F.slice(F.array_sort(F.collect_set("id")), 1, most).alias("examples"))


def community_sizes(partition: DataFrame) -> DataFrame:
    """AGG-48: one row on community sizes: number, tiny (up to 5), large (from 100), median, cover of the top 10 and 20."""
    sizes = partition.groupBy("community").agg(F.count("*").alias("size"))
    ranked = sizes.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("size"), "community")))
    cover = lambda k: F.sum(F.when(F.col("_r") <= k, F.col("size")).otherwise(0)) / F.sum("size")
    return ranked.agg(
        F.count("*").alias("communities"), F.count_if(F.col("size") <= 5).alias("tiny"), F.count_if(F.col("size") >= 100).alias("large"),
        F.median("size").alias("median_size"), cover(10).alias("top10_cover"), cover(20).alias("top20_cover"),
    )


def modularity(edges: DataFrame, partition: DataFrame, resolution: float = 1.0) -> DataFrame:
    """AGG-50: weighted modularity of a partition, one row."""
    strength = degrees(edges).join(partition, "node").groupBy("community").agg(F.sum("strength").alias("k"))
    inside = community_graph(edges, partition)[0].select("community", "internal_weight")
    total = edges.agg(F.sum("weight").cast("double").alias("m"))
    terms = strength.join(inside, "community", "left").crossJoin(F.broadcast(total))  # one row
    one = F.coalesce("internal_weight", F.lit(0.0)) / F.col("m") - resolution * F.pow(F.col("k") / (2 * F.col("m")), 2)
    return terms.agg(F.sum(one).alias("modularity"))


def modularities(edges: DataFrame, partitions: DataFrame, resolution: float = 1.0) -> DataFrame:
    """AGG-50 of several partitions in one pass, one row: ``partitions`` has the node and a community of each, of one type."""
    names = [c for c in partitions.columns if c != "node"]
    # Edges are many beside nodes: they are joined unsorted.
    ends = [partitions.select(F.col("node").alias(e), *[F.col(c).alias(f"{e}_{c}") for c in names]).hint("shuffle_hash") for e in ("src", "dst")]
    named = edges.select("src", "dst", F.col("weight").cast("double").alias("w")).join(ends[0], "src", "left").join(ends[1], "dst", "left")
    sides = [(c, F.col(f"{e}_{c}"), F.when(F.col(f"src_{c}") == F.col(f"dst_{c}"), F.col("w") / 2).otherwise(0.0)) for c in names for e in ("src", "dst")]
    halves = named.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), of.alias("c"), F.col("w").alias("k"), i.alias("inside")) for c, of, i in sides])))
    sums = halves.groupBy("name", "c").agg(F.sum("k").alias("k"), F.sum("inside").alias("inside"))
    m = F.sum("k").over(Window.partitionBy("name")) / 2
    terms = sums.withColumn("m", m).where("c is not null").withColumn("q", F.col("inside") / F.col("m") - resolution * F.pow(F.col("k") / (2 * F.col("m")), 2))
    return terms.agg(*[F.sum(F.when(F.col("name") == c, F.col("q"))).alias(c) for c in names])


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """AGG-49: adjusted Rand index of two labelings, one row; 1 for two trivial ones."""
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    ij = cells.agg(two("n").alias("ij"), F.sum("n").alias("t"))
    ai = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(two("n").alias("ai"))
    bj = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(two("n").alias("bj"))
    expected = F.col("ai") * F.col("bj") / (F.col("t") * (F.col("t") - 1) / 2)
    most = (F.col("ai") + F.col("bj")) / 2
    return ij.crossJoin(ai).crossJoin(bj).select(  # one row each
        F.when(most == expected, 1.0).otherwise((F.col("ij") - expected) / (most - expected)).alias("ari")
    )


def louvain(edges: DataFrame, resolution: float = 1.0, seed: int = 0, levels: int = 5, rounds: int = 12) -> DataFrame:
    """GRF-04, GRF-05: ``node, community`` by local moves and aggregation.

    In each round every node looks for the neighbouring community with the largest
    gain; a seeded half of the nodes moves, which keeps two neighbours from swapping
    for ever. A level ends when nothing gains, the search when a level changes nothing.
    Vectors of the nodes, 20 bytes each, are in the driver and in every task; nodes that
    are no integers are numbered for that, and over ``VECTOR_NODES`` all is joined.
    """
    if isinstance(edges.schema["src"].dataType, IntegralType):
        found = communities.placed(edges, resolution, seed, levels, rounds, VECTOR_NODES)
        return louvain_by_joins(edges, resolution, seed, levels, rounds) if found is None else found
    edges = durable(edges, "louvain")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).where("node is not null").distinct()
    numbers = durable(dense_numbers(nodes, "node", "_id"), "louvain")
    numbered = edges.join(numbers.toDF("src", "_a"), "src").join(numbers.toDF("dst", "_b"), "dst")
    found = louvain(numbered.select(F.col("_a").alias("src"), F.col("_b").alias("dst"), "weight"), resolution, seed, levels, rounds)
    return found.toDF("_id", "_c").join(numbers, "_id").select("node", "_c").join(numbers.toDF("community", "_c"), "_c").select("node", "community")


def louvain_by_joins(edges: DataFrame, resolution: float = 1.0, seed: int = 0, levels: int = 5, rounds: int = 12) -> DataFrame:
    """``louvain`` all in frames, for graphs whose nodes do not fit a vector; much slower."""
    weight = edges.groupBy("src", "dst").agg(F.sum("weight").cast("double").alias("weight"))
    total = weight.agg(F.sum("weight")).first()[0] or 0.0
    nodes = weight.select(F.col("src").alias("node")).union(weight.select("dst")).distinct()
    placed = durable(nodes.withColumn("community", F.col("node")), "louvain")
    if not total:
        return placed
    level_edges, loops = durable(weight, "louvain"), None
    for level in range(levels):
        sym = level_edges.unionByName(level_edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
        k = sym.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("k"))
        if loops is not None:
            k = k.unionByName(loops.select("node", (2 * F.col("weight")).alias("k"))).groupBy("node").agg(F.sum("k").alias("k"))
        k = durable(k, "louvain")
        part = durable(k.select("node", F.col("node").alias("community")), "louvain")
        moved_any = False
        for turn in range(rounds):
            sums = part.join(k, "node").groupBy("community").agg(F.sum("k").alias("total"))
            to = (
                sym.join(part.select(F.col("node").alias("dst"), "community"), "dst")
                .groupBy(F.col("src").alias("node"), "community").agg(F.sum("weight").alias("w"))
            )
            own = part.withColumnRenamed("community", "own").join(k, "node")
            gain = (
                to.join(own, "node").join(sums, "community")
                .withColumn("rest", F.col("total") - F.when(F.col("community") == F.col("own"), F.col("k")).otherwise(0.0))
                .withColumn("gain", F.col("w") - resolution * F.col("k") * F.col("rest") / (2 * total))
            )
            stay = own.join(sums.withColumnRenamed("community", "own"), "own").select(
                "node", F.col("own").alias("community"), (-resolution * F.col("k") * (F.col("total") - F.col("k")) / (2 * total)).alias("gain"), F.lit(0.0).alias("w")
            )
            choice = gain.select("node", "community", "gain", "w").unionByName(stay)
            best = choice.groupBy("node").agg(F.max(F.struct(F.round("gain", 9).alias("gain"), (F.col("w") > 0).alias("linked"), "community")).alias("b"))
            current = choice.join(own.select("node", F.col("own").alias("community")), ["node", "community"]).groupBy("node", "community").agg(F.max("gain").alias("g"))
            turned = F.pmod(F.xxhash64("node", F.lit(seed), F.lit(level), F.lit(turn)), F.lit(2)) == 0
            decided = durable(
                current.join(best, "node").select(
                    "node", F.col("community").alias("old"),
                    F.when((F.col("b.gain") > F.col("g") + 1e-7), F.col("b.community")).otherwise(F.col("community")).alias("want"),
                ).withColumn("community", F.when(turned, F.col("want")).otherwise(F.col("old"))),
                "louvain",
            )
            wants = decided.agg(F.count_if(F.col("want") != F.col("old")), F.count_if(F.col("community") != F.col("old"))).first()
            part = decided.select("node", "community")
            moved_any = moved_any or wants[1] > 0
            if not wants[0]:
                break
        if not moved_any:
            break
        placed = durable(
            placed.withColumnRenamed("community", "_c").join(part.select(F.col("node").alias("_c"), "community"), "_c").select("node", "community"), "louvain"
        )
        named = level_edges.join(part.select(F.col("node").alias("src"), F.col("community").alias("a")), "src").join(
            part.select(F.col("node").alias("dst"), F.col("community").alias("b")), "dst"
        )
        inner = named.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("weight"))
        if loops is not None:
            kept = loops.join(part, "node").select(F.col("community").alias("node"), "weight")
            inner = inner.unionByName(kept).groupBy("node").agg(F.sum("weight").alias("weight"))
        loops = durable(inner, "louvain")
        level_edges = durable(
            named.where("a <> b").groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.sum("weight").alias("weight")), "louvain"
        )
        if level_edges.isEmpty():
            break
    return placed


def repeated_louvain(edges: DataFrame, seeds: list[int], select: str = "last", resolution: float = 1.0) -> DataFrame:
    """GRF-04: the ``last`` of several runs, or the one of ``best_modularity``."""
    runs = [louvain(edges, resolution, s) for s in (seeds if select != "last" else seeds[-1:])]
    if len(runs) == 1:
        return runs[0]
    return max(runs, key=lambda p: modularity(edges, p, resolution).first()[0])
