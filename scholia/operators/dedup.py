"""Staged record deduplication (AGG-01 to AGG-09): evidence, clusters, scores, winners, patches, changes.

A record occurrence is named by ``id`` and ``file``. Nothing is collected: clusters
come from distributed components, winners and patches from aggregates and windows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scholia.operators.components import connected_components

#: Record fields from the most to the least telling.
RANKED_COLUMNS = [
    "id", "date_imported_gbq", "year", "doi", "isbn", "title", "abstract", "category_for", "reference_ids", "type", "researcher_ids",
    "authors", "patent_ids", "journal", "concepts", "funding_details", "funder_orgs", "research_orgs", "altmetrics", "citations",
    "citations_count", "volume", "issue", "pages", "subtitles", "date", "date_online", "book_title", "document_type",
    "funder_countries", "concepts_relevant", "date_print", "source_id", "date_accepted", "date_submitted", "categories",
    "book_series_title", "proceedings_title", "parent_id", "conference", "supporting_grant_ids", "repository_dois", "arxiv_id",
    "open_access_categories", "open_access_categories_v2", "pmid", "pmcid", "date_normal", "date_inserted", "eisbn", "publisher",
    "event", "editors", "resulting_publication_doi", "mesh_headings", "mesh_terms", "category_bra", "category_hra", "category_hrcs_hc",
    "category_hrcs_rac", "category_icrp_cso", "category_icrp_ct", "category_rcdc", "category_sdg", "category_uoa",
    "copyright_statement", "acknowledgements", "clinical_trial_ids", "pubmed", "metrics", "source", "journal_lists", "funding_section",
    "research_org_cities", "research_org_city_names", "research_org_countries", "research_org_country_names",
    "research_org_state_codes", "research_org_state_names",
]
NODE = ["id", "file"]


def presence_weights(columns: Sequence[str] = RANKED_COLUMNS, zero_id: bool = False) -> dict[str, float]:
    """Weights from the number of columns down to 1; the id may count nothing."""
    found = {c: float(len(columns) - k) for k, c in enumerate(columns)}
    return found | {"id": 0.0} if zero_id else found


def star_edges(evidence: DataFrame, keys: Sequence[str], min_size: int = 2, drop_null_keys: bool = False) -> DataFrame:
    """AGG-02, FLT-03: rows with equal keys, each linked to the smallest of its group.

    Null keys are equal unless dropped. A group counts its rows, so one occurrence
    listed twice is a group of its own.
    """
    if drop_null_keys:
        evidence = evidence.dropna(subset=list(keys))
    node = F.struct(*NODE)
    rows = evidence.select(*[F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)], node.alias("node"))
    names = [f"k{i}" for i in range(len(keys))]
    groups = rows.groupBy(*names).agg(F.min("node").alias("head"), F.count("*").alias("n")).where(F.col("n") >= min_size)
    same = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(groups[c]) for c in names])
    return rows.join(groups, same).select("node", "head")


def clusters(edges: Sequence[DataFrame]) -> DataFrame:
    """AGG-01: ``id, file, cluster_id`` over all evidence; ids are dense from 0 in the order of the smallest member."""
    links = reduce(DataFrame.unionByName, edges)
    found = connected_components(links, "node", "head").select("node", F.col("component").alias("head"))
    alone = links.select("node").distinct().join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("head"))
    both = found.unionByName(alone)
    # Cluster heads are few beside members; they are numbered in ranges, not in one task.
    heads = dense_numbers(both.select("head").distinct(), "head", "cluster_id")
    return both.join(heads, "head").select("node.id", "node.file", "cluster_id")


def dense_numbers(df: DataFrame, order: str | Sequence[str | Column], name: str) -> DataFrame:
    """Number rows from 0 in an order, without one task that sorts all of them."""
    from scholia.plans.durable import durable

    order = [order] if isinstance(order, str) else list(order)
    ranged = durable(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "ranged"
    ).withColumn("_part", F.shiftright("_id", 33))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.join(F.broadcast(starts), "_part").select(*df.columns, (F.col("_start") + within).alias(name))  # a row a range


def wanted_by_file(found: DataFrame) -> DataFrame:
    """AGG-03: the distinct ids to read from each file."""
    return found.groupBy("file").agg(F.array_sort(F.collect_set("id")).alias("ids")).withColumn("n_ids", F.size("ids").cast("long"))


def routed(wanted: DataFrame, existing: DataFrame, base: str = "", ext: str = ".parquet") -> tuple[DataFrame, DataFrame]:
    """JN-02, PRJ-06: files to touch with their paths, and files that are missing."""
    paths = wanted.withColumn("path", F.concat(F.lit(base), F.lit("/"), F.col("file"), F.lit(ext))).select("file", "path", "n_ids")
    return paths.join(existing, "file", "left_semi"), paths.join(existing, "file", "left_anti")


def presence_score(columns: Sequence[str], weights: dict[str, float]) -> Column:
    """AGG-04: sum of the weights of fields that are not null; empty text and lists are present."""
    parts = [F.when(F.col(c).isNotNull(), F.lit(weights[c])).otherwise(F.lit(0.0)) for c in columns if c in weights]
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def scored(records: DataFrame, members: DataFrame, weights: dict[str, float]) -> DataFrame:
    """JN-01: records of clusters with ``_score``."""
    return records.join(members, NODE).withColumn("_score", presence_score(records.columns, weights))


def _rank() -> Window:
    return Window.partitionBy("cluster_id").orderBy(F.desc("_score"), F.asc("file"), F.asc("id"))


def winners(rows: DataFrame) -> DataFrame:
    """AGG-05: the best record of each cluster by score, file, id, and the members found."""
    best = F.min_by(F.struct("id", "file", "_score"), F.struct(-F.col("_score"), "file", "id"))
    return rows.groupBy("cluster_id").agg(best.alias("b"), F.count("*").alias("total_members")).select(
        "cluster_id",
        F.col("b.id").alias("canonical_id"),
        F.col("b.file").alias("canonical_file"),
        F.col("b._score").alias("best_score"),
        "total_members",
    )


def losers(rows: DataFrame, won: DataFrame) -> DataFrame:
    """JN-04, AGG-07: members that are not their cluster's winner."""
    other = ~((F.col("id") == F.col("canonical_id")) & (F.col("file") == F.col("canonical_file")))
    return rows.join(won, "cluster_id").where(other).select("cluster_id", "id", "file")


def merge_patches(rows: DataFrame, won: DataFrame, scalars: Sequence[str], lists: Sequence[str], cap: int = 1000) -> DataFrame:
    """AGG-06, ARR-02: what each winner gains from its losers.

    A scalar is the first filled loser value, by score, file and id, where the winner
    has none. A list is the winner's and then the losers' elements without repeats, up
    to ``cap``, if that differs from the winner's and there is a loser. Each patched
    field names its sources as ``id:file``.
    """
    keys = ["cluster_id", "canonical_id", "canonical_file"]
    joined = rows.join(won.select(*keys), "cluster_id")
    own = (F.col("id") == F.col("canonical_id")) & (F.col("file") == F.col("canonical_file"))
    rank = F.struct(F.when(own, 0).otherwise(1).alias("o"), (-F.col("_score")).alias("s"), "file", "id")
    joined = joined.withColumn("_own", own).withColumn("_rank", rank).withColumn("_source", F.concat("id", F.lit(":"), "file"))
    # Scalars and counts combine early; no member is gathered for them.
    parts = [F.count_if(~F.col("_own")).alias("_others")]
    for c in scalars:
        gives = ~F.col("_own") & F.col(c).isNotNull()
        parts += [
            F.count_if(F.col("_own") & F.col(c).isNotNull()).alias(f"_has_{c}"),
            F.min_by(F.when(gives, F.struct(F.col(c).alias("v"), F.col("_source").alias("f"))), F.when(gives, F.col("_rank"))).alias(f"_first_{c}"),
        ]
    out = joined.groupBy(*keys).agg(*parts)
    for c in scalars:
        need = (F.col(f"_has_{c}") == 0) & F.col(f"_first_{c}").isNotNull()
        out = out.withColumns({c: F.when(need, F.col(f"_first_{c}.v")), f"{c}_from": F.when(need, F.array(F.col(f"_first_{c}.f")))})
        out = out.drop(f"_has_{c}", f"_first_{c}")
    for c in lists:
        out = _merged_list(out, joined, keys, c, cap)
    return out.select(*keys, *[x for c in (*scalars, *lists) for x in (c, f"{c}_from")])


def _merged_list(out: DataFrame, joined: DataFrame, keys: list[str], c: str, cap: int) -> DataFrame:
    """Add a list field and its sources: elements are made distinct and ranked before any are gathered."""
    mine = joined.where("_own").select("cluster_id", F.col(c).alias("_mine"))
    cells = joined.where(F.col(c).isNotNull()).select("cluster_id", "_own", "_rank", "_source", F.posexplode(c).alias("_i", "_x"))
    # A null element is an element, so elements are compared as structs.
    firsts = cells.groupBy("cluster_id", F.struct("_x").alias("_e")).agg(F.min(F.struct("_rank", "_i")).alias("_o"))
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy("_o"))
    kept = firsts.withColumn("_k", place).where(F.col("_k") <= cap)
    merged = kept.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_e"))), lambda e: e["_e"]["_x"]).alias("_all"))
    owned = cells.where("_own").select("cluster_id", F.struct("_x").alias("_e")).distinct().withColumn("_has", F.lit(True))
    given = cells.where("not _own").select("cluster_id", "_rank", "_source", F.struct("_x").alias("_e")).join(owned, ["cluster_id", "_e"], "left")
    givers = given.where("_has is null").select("cluster_id", "_rank", "_source").distinct()
    sources = givers.groupBy("cluster_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_rank", "_source"))), lambda e: e["_source"]).alias("_from")
    )
    both = out.join(mine, "cluster_id", "left").join(merged, "cluster_id", "left").join(sources, "cluster_id", "left")
    need = (F.col("_others") > 0) & F.col("_all").isNotNull() & ~F.col("_all").eqNullSafe(F.col("_mine"))
    none = F.array().cast("array<string>")
    return both.withColumns({c: F.when(need, F.col("_all")), f"{c}_from": F.when(need, F.coalesce("_from", none))}).drop("_mine", "_all", "_from")


def patch_json(patches: DataFrame, fields: Sequence[str]) -> DataFrame:
    """JSN-07: patches as JSON text: the patch, the fields filled, and the sources."""
    filled = F.filter(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in fields]), lambda x: x.isNotNull())
    sources = F.array_sort(F.array_distinct(F.flatten(F.filter(F.array(*[F.col(f"{c}_from") for c in fields]), lambda a: a.isNotNull()))))
    return patches.select(
        "cluster_id",
        "canonical_id",
        "canonical_file",
        F.to_json(F.struct(*fields)).alias("patch_json"),
        F.to_json(filled).alias("columns_filled_json"),
        F.to_json(sources).alias("merged_from_json"),
    )


def shards_to_process(lost: DataFrame, won: DataFrame, only: str | None = None) -> DataFrame:
    """AGG-09, SET-02: files that hold a loser or a winner, or one forced file."""
    files = lost.select("file").union(won.select("canonical_file")).distinct()
    return files.where(F.col("file") == only) if only else files


def applied(records: DataFrame, lost: DataFrame, patches: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Stage E: records without losers, winners with their patches."""
    side = patches.select(F.col("canonical_id").alias("id"), F.col("canonical_file").alias("file"), *[F.col(c).alias(f"__p_{c}") for c in fields])
    kept = records.join(lost.select(*NODE).distinct(), NODE, "left_anti").join(side, NODE, "left")
    return kept.withColumns({c: F.coalesce(f"__p_{c}", c) for c in fields}).select(*records.columns)


def changelog(records: DataFrame, lost: DataFrame, won: DataFrame) -> DataFrame:
    """AGG-08: rows before, losers found, winners found, and rows after, of each touched file."""
    gone = lost.select(*NODE).distinct().withColumn("_lost", F.lit(1))
    top = won.select(F.col("canonical_id").alias("id"), F.col("canonical_file").alias("file")).distinct().withColumn("_won", F.lit(1))
    marked = records.select(*NODE).join(gone, NODE, "left").join(top, NODE, "left").join(shards_to_process(lost, won), "file", "left_semi")
    return (
        marked.groupBy("file")
        .agg(
            F.count("*").alias("num_rows_before"),
            F.count("_lost").alias("num_deleted_present"),
            F.count("_won").alias("num_patched_present"),
        )
        .withColumn("num_rows_after", F.col("num_rows_before") - F.col("num_deleted_present"))
    )
