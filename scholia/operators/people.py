"""Authors, papers and places: long tables, summaries, lookups, country counts (AGG-34, -35, -55 to -57, -62 to -64, JN-08)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions.entity import main_affiliation
from scholia.functions.text import full_name, name_key
from scholia.operators import metrics


def author_papers(pubs: DataFrame) -> DataFrame:
    """The author-paper long table: one row per paper and author slot, with the main affiliation.

    ``pubs`` has ``id, year, times_cited`` and ``authors``, an array of structs with
    ``researcher_id, first_name, last_name, corresponding, current_organization_id,
    affiliations``. An author without an id is named by their names.
    """
    a = F.col("a")
    rows = pubs.select(F.col("id").alias("paper_id"), "year", "times_cited", F.explode("authors").alias("a"))
    main = main_affiliation(a["affiliations"], a["current_organization_id"])
    return rows.select(
        "paper_id", "year", "times_cited",
        F.coalesce(F.nullif(F.trim(a["researcher_id"]), F.lit("")), name_key(a["first_name"], a["last_name"])).alias("author_id"),
        a["first_name"].alias("first_name"), a["last_name"].alias("last_name"), full_name(a["first_name"], a["last_name"]).alias("full_name"),
        F.coalesce(a["corresponding"], F.lit(False)).alias("is_corresponding"),
        F.size(F.coalesce(a["affiliations"], F.array())).alias("n_affiliations"),
        a["current_organization_id"].alias("current_org_id"),
        main["affiliation"]["name"].alias("org_name"), main["affiliation"]["id"].alias("org_grid"),
        main["affiliation"]["country"].alias("country"), main["affiliation"]["country_code"].alias("country_code"), main["source"].alias("aff_source"),
    ).dropDuplicates(["paper_id", "author_id"])


def lookup(df: DataFrame, key: str, values: Sequence[str], keep: str = "common", order: str | None = None) -> DataFrame:
    """AGG-55: one value per key: the most ``common`` (smallest among equals), or the ``first`` or ``last`` in an order."""
    rows = df.where(F.col(key).isNotNull())
    if keep == "common":
        found = rows.select(key).distinct()
        for v in values:
            found = found.join(metrics.mode_by(rows, key, v).select(key, F.col("mode").alias(v)), key, "left")
        return found
    pick = F.min_by if keep == "first" else F.max_by
    return rows.groupBy(key).agg(*[pick(v, order).alias(v) for v in values])


def paper_fields(df: DataFrame, paper: str, code: str, label: Column | str) -> DataFrame:
    """AGG-56: distinct two- and four-digit fields of each paper; a four-digit code brings its parent."""
    rows = df.select(paper, F.col(code).alias("c"), (F.col(label) if isinstance(label, str) else label).alias("l"))
    two = F.when(F.length("c") == 2, F.col("c")).when(F.length("c") == 4, F.substring("c", 1, 2))
    return rows.groupBy(paper).agg(
        F.array_sort(F.collect_set(two)).alias("for_l2"), F.array_sort(F.collect_set(F.when(F.length("c") == 4, F.col("c")))).alias("for_l4")
    )


def author_summary(ap: DataFrame, author: str, paper: str, cites: str, year: str, field: str, org: str, current: str) -> DataFrame:
    """AGG-57: papers, citations, years active, modal field and home organisation of each author.

    Citations count once a paper. Home is the current organisation, else the modal one.
    """
    once = ap.groupBy(author, paper).agg(F.max(cites).alias("_c"), F.min(year).alias("_y"))
    base = once.groupBy(author).agg(F.count("*").alias("papers"), F.sum("_c").alias("citations"), F.min("_y").alias("first_year"), F.max("_y").alias("last_year"))
    for column, name in ((field, "modal_field"), (current, "_current"), (org, "_org")):
        base = base.join(metrics.mode_by(ap, author, column).select(author, F.col("mode").alias(name)), author, "left")
    return base.withColumn("home", F.coalesce("_current", "_org")).drop("_current", "_org")


def country_counts(df: DataFrame, countries: str) -> DataFrame:
    """AGG-34: how often each country stands in a list column."""
    return df.select(F.explode(countries).alias("country")).groupBy("country").agg(F.count("*").alias("n"))


def country_papers(df: DataFrame, paper: str, countries: str) -> DataFrame:
    """AGG-35: papers of each country, one per paper and country."""
    return df.select(paper, F.explode(F.array_distinct(countries)).alias("country")).dropDuplicates().groupBy("country").agg(F.count_distinct(paper).alias("papers"))


def dominant(df: DataFrame, group: str, value: str, weight: str) -> DataFrame:
    """AGG-62: the value of the largest weight of each group, the smallest among equals."""
    summed = df.groupBy(group, value).agg(F.sum(weight).alias("_w"))
    return summed.groupBy(group).agg(F.min_by(value, F.struct(-F.col("_w"), value)).alias("dominant"), F.max("_w").alias("weight"))


def home_and_others(df: DataFrame, by: str, country: str, home: str, weight: Column | None = None) -> DataFrame:
    """AGG-63: weighted counts of one country and of all others by year or stage."""
    w = weight if weight is not None else F.lit(1.0)
    own = F.coalesce(F.col(country) == home, F.lit(False))
    return df.groupBy(by).agg(F.sum(F.when(own, w).otherwise(0.0)).alias("home"), F.sum(F.when(own, 0.0).otherwise(w)).alias("others"))


def mentions(alt: DataFrame, pubs: DataFrame, doi: str, counts: Sequence[str], by: str) -> DataFrame:
    """JN-08, AGG-64: mention counts joined by normalised DOI (best cited record of each), nulls as 0, summed by group."""
    from scholia.functions.text import normalised_doi
    from scholia.operators.columns import keep_first

    a = alt.withColumn("_doi", normalised_doi(doi)).where(F.col("_doi").isNotNull())
    p = keep_first(pubs.withColumn("_doi", normalised_doi(doi)).where(F.col("_doi").isNotNull()), ["_doi"], [F.desc("times_cited"), doi])
    both = a.join(p.select("_doi", by), "_doi", "left").na.fill(0, list(counts))
    return both.groupBy(by).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in counts])


def percent_growth_fields(df: DataFrame, field: str, year: str, base: int, last: int, summary: DataFrame, n: int = 10) -> DataFrame:
    """JN-12: the fastest growing fields with their summaries."""
    return metrics.growth(df, field, year, base, last, n).join(summary, field, "inner")
