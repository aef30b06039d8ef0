"""Citation indices, summaries, modes, shares, fractional counts, growth (AGG-10 to AGG-40, AGG-51 to AGG-66)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def citation_indices(df: DataFrame, key: str | Sequence[str], cites: str) -> DataFrame:
    """AGG-14, -15, -16: ``h_index, g_index, i10_index`` of each key over one row per paper.

    Papers are ranked within a key by citations; no list of them is gathered. Ranks are
    long, since their squares pass an int from the 46,341st paper of a key on.
    """
    keys = [key] if isinstance(key, str) else list(key)
    ranked = df.select(*keys, F.coalesce(cites, F.lit(0)).alias("_c"))
    down = Window.partitionBy(*keys).orderBy(F.desc("_c"))
    ranked = ranked.withColumn("_i", F.row_number().over(down).cast("long")).withColumn(
        "_s", F.sum("_c").over(down.rowsBetween(Window.unboundedPreceding, 0))
    )
    return ranked.groupBy(*keys).agg(
        F.count_if(F.col("_c") >= F.col("_i")).alias("h_index"),
        F.coalesce(F.max(F.when(F.col("_s") >= F.col("_i") * F.col("_i"), F.col("_i"))), F.lit(0)).cast("long").alias("g_index"),
        F.count_if(F.col("_c") >= 10).alias("i10_index"),
    )


def fair_skew(c: str) -> Column:
    """AGG-13: bias-corrected skewness, null under three values."""
    n = F.count(c)
    return F.when(n >= 3, F.skewness(c) * F.sqrt(n * (n - 1.0)) / (n - 2))


def metric_table(df: DataFrame, key: str, paper: str, cites: str) -> DataFrame:
    """AGG-17, -18: papers, citations and their distribution, uncited share, and share of all citations.

    The share's denominator covers all rows; rows without a key are then dropped.
    """
    total = df.agg(F.sum(cites).alias("_all"))
    keyed = df.where(F.col(key).isNotNull())
    table = keyed.groupBy(key).agg(
        F.count_distinct(paper).alias("papers"),
        F.sum(cites).alias("total_cites"),
        F.avg(cites).alias("mean_cites"),
        F.max(cites).alias("max_cites"),
        F.var_pop(cites).alias("var_cites"),
        fair_skew(cites).alias("skew_cites"),
        F.avg((F.coalesce(cites, F.lit(0)) == 0).cast("double")).alias("uncited_share"),
    )
    indices = citation_indices(keyed, key, cites)
    return (
        table.join(indices, key)
        .join(median_by(keyed, key, cites), key, "left")
        .crossJoin(F.broadcast(total))  # one row
        .withColumn("h_per_paper", F.col("h_index") / F.col("papers"))
        .withColumn("cite_share", F.col("total_cites") / F.col("_all"))
        .drop("_all")
    )


def median_by(df: DataFrame, key: str, value: str, name: str = "median_cites") -> DataFrame:
    """Exact median of each key from counts of distinct values, which combine early; nulls do not count."""
    counted = df.where(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(key)
    upto = F.sum("_n").over(w.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.withColumns({"_upto": upto, "_all": F.sum("_n").over(w)})
    # The values that hold the two middle ranks, which are one where the count is odd.
    low = F.floor((F.col("_all") + 1) / 2)
    high = F.floor(F.col("_all") / 2) + 1
    holds = lambda r: (F.col("_upto") >= r) & (F.col("_upto") - F.col("_n") < r)
    return placed.groupBy(key).agg(
        ((F.max(F.when(holds(low), F.col("_v"))) + F.max(F.when(holds(high), F.col("_v")))) / 2.0).cast("double").alias(name)
    )


def collaborators(df: DataFrame, paper: str, org: str) -> DataFrame:
    """AGG-19, -20: distinct partners, mean organisations a paper, and papers alone, of each organisation."""
    pairs = df.select(paper, org).distinct()
    sized = pairs.withColumn("_n", F.count("*").over(Window.partitionBy(paper)))
    other = pairs.withColumnRenamed(org, "_other")
    partners = pairs.join(other, paper).where(F.col(org) != F.col("_other")).groupBy(org).agg(F.count_distinct("_other").alias("partners"))
    means = sized.groupBy(org).agg(F.avg("_n").alias("mean_orgs"), F.count_if(F.col("_n") == 1).alias("papers_alone"))
    return means.join(partners, org, "left").na.fill(0, ["partners"])


def mode_by(df: DataFrame, key: str | Sequence[str], value: str, tie: str = "smallest", order: str | None = None) -> DataFrame:
    """AGG-21 to -23: the most frequent value; ties go to the ``smallest`` or to the ``first`` in an order."""
    keys = [key] if isinstance(key, str) else list(key)
    seen = F.min(order) if tie == "first" and order else F.lit(0)
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"), seen.alias("_o"))
    return counted.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), "_o", value)).alias("mode"), F.max("_n").alias("mode_n"))


def field_summary(df: DataFrame, field: str, cites: str, person: str, org: str) -> DataFrame:
    """AGG-24: rows, citations, h-index, modal and distinct people and organisations of each field."""
    base = df.groupBy(field).agg(
        F.count("*").alias("papers"),
        F.sum(cites).alias("total_cites"),
        F.avg(cites).alias("mean_cites"),
        F.count_distinct(person).alias("people"),
        F.count_distinct(org).alias("orgs"),
    )
    person_mode, org_mode = (mode_by(df, field, c).select(field, F.col("mode").alias(f"modal_{n}")) for c, n in ((person, "person"), (org, "org")))
    indices = citation_indices(df, field, cites).select(field, "h_index")
    return base.join(indices, field).join(person_mode, field, "left").join(org_mode, field, "left")


def growth(df: DataFrame, group: str, year: str, base: int, last: int, n: int | None = 10) -> DataFrame:
    """AGG-25: percentage growth between two years where the base is over 0; the ``n`` fastest."""
    counted = df.groupBy(group).agg(F.count_if(F.col(year) == base).alias("n_base"), F.count_if(F.col(year) == last).alias("n_last"))
    grown = counted.where("n_base > 0").withColumn("growth_pct", 100.0 * (F.col("n_last") - F.col("n_base")) / F.col("n_base"))
    return grown.orderBy(F.desc("growth_pct"), group).limit(n) if n else grown


def shares(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """JN-10, AGG-54, AGG-66: rows of each value and their percentage within the group, without a join."""
    counted = df.groupBy(*group, value).agg(F.count("*").alias("n"))
    return counted.withColumn("total", F.sum("n").over(Window.partitionBy(*group))).withColumn("pct", 100.0 * F.col("n") / F.col("total"))


def topic_growth(shares_by_year: DataFrame, topic: str = "topic", year: str = "year", share: str = "share") -> DataFrame:
    """AGG-40: first and last share, their ratio, and the least-squares slope (0 under two years)."""
    return shares_by_year.groupBy(topic).agg(
        F.min(year).alias("first_year"),
        F.max(year).alias("last_year"),
        F.min_by(share, year).alias("first_share"),
        F.max_by(share, year).alias("last_share"),
        F.when(F.count_distinct(year) >= 2, F.regr_slope(share, F.col(year).cast("double"))).otherwise(0.0).alias("share_slope"),
    ).withColumn("growth_ratio", (F.col("last_share") + 1e-6) / (F.col("first_share") + 1e-6))


def fractional(df: DataFrame, paper: str, unit: str) -> DataFrame:
    """AGG-31: units weighed by one over the rows of their paper, counted before rows without a unit go."""
    weighed = df.withColumn("_w", 1.0 / F.count("*").over(Window.partitionBy(paper)))
    return weighed.where(F.col(unit).isNotNull()).groupBy(unit).agg(
        F.sum("_w").alias("frac"), F.count("*").alias("slots"), F.count_distinct(paper).alias("papers")
    )


def fractional_split(df: DataFrame, paper: str, unit: str, parts: str, none: str = "Unclassified") -> DataFrame:
    """AGG-32: fractional weights split equally over a list column; an empty list is one part of its own."""
    weighed = df.withColumn("_w", 1.0 / F.count("*").over(Window.partitionBy(paper))).where(F.col(unit).isNotNull())
    whole = F.when(F.size(F.coalesce(parts, F.array())) > 0, F.col(parts)).otherwise(F.array(F.lit(none)))
    split = weighed.withColumn("_parts", whole).withColumn("_w", F.col("_w") / F.size("_parts"))
    return split.select(unit, F.explode("_parts").alias("part"), "_w").groupBy(unit, "part").agg(F.sum("_w").alias("frac"))


def fractional_matrix(df: DataFrame, rows: str, columns: str, k: int) -> DataFrame:
    """AGG-33: column values by list elements of ``rows``, each worth one over the list's length, top ``k`` of both."""
    cells = df.where(F.size(rows) > 0).select(F.explode(rows).alias("r"), F.col(columns).alias("c"), (1.0 / F.size(rows)).alias("w"))
    summed = cells.groupBy("r", "c").agg(F.sum("w").alias("w"))
    for side in ("r", "c"):
        top = summed.groupBy(side).agg(F.sum("w").alias("t")).orderBy(F.desc("t"), side).limit(k)
        summed = summed.join(F.broadcast(top.select(side)), side, "left_semi")
    return summed


def pivoted(df: DataFrame, row: str | Sequence[str], column: str, values: Sequence, measure: Column | None = None) -> DataFrame:
    """AGG-36: one column per value, 0 where there is nothing; the values are given, so no job looks for them."""
    rows = [row] if isinstance(row, str) else list(row)
    return df.groupBy(*rows).pivot(column, list(values)).agg(measure if measure is not None else F.count(F.lit(1))).na.fill(0)


def top_or_other(df: DataFrame, value: str, k: int, other: str = "Other") -> DataFrame:
    """AGG-38, -39: row counts of the ``k`` most frequent values, and of all others as one."""
    counted = df.groupBy(value).agg(F.count("*").alias("n"))
    top = counted.orderBy(F.desc("n"), value).limit(k).select(value, F.lit(True).alias("_top"))
    named = counted.join(F.broadcast(top), value, "left")
    return named.groupBy(F.when(F.col("_top"), F.col(value)).otherwise(other).alias(value)).agg(F.sum("n").alias("n"))


def folded_matrix(df: DataFrame, row: str, column: str, value: str, k: int, other: str = "Other") -> DataFrame:
    """AGG-39: sums by row and column, one column for each of the ``k`` largest and one for all others, 0 where there is nothing."""
    sums = df.groupBy(row, column).agg(F.sum(value).alias("_w"))
    largest = sums.groupBy(column).agg(F.sum("_w").alias("_t")).orderBy(F.desc("_t"), column).limit(k)
    names = [str(r[0]) for r in largest.collect()]  # k names
    folded = sums.withColumn("_c", F.when(F.col(column).cast("string").isin(names), F.col(column).cast("string")).otherwise(other))
    return pivoted(folded, row, "_c", [*names, other], F.sum("_w"))


def value_shares(df: DataFrame, group: str, member: str, value: str, missing: str, missing_last: bool = False) -> DataFrame:
    """AGG-47: per group the distinct members of each value, their share of the group's members, and the rank.

    A null value counts as ``missing``. Values rank by members; among equals, or with
    ``missing_last`` before all else, the missing value comes last, then names decide.
    """
    pairs = df.select(group, F.coalesce(F.col(value).cast("string"), F.lit(missing)).alias(value), member).where(F.col(member).isNotNull()).distinct()
    counted = pairs.groupBy(group, value).agg(F.count("*").alias("n"))
    totals = df.groupBy(group).agg(F.count_distinct(member).alias("group_n"))
    unknown = (F.col(value) == missing).cast("int")
    order = [unknown, F.desc("n"), value] if missing_last else [F.desc("n"), unknown, value]
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.join(totals, group).withColumn("share", F.col("n") / F.col("group_n"))


def most_common(df: DataFrame, value: str, order: str, k: int) -> DataFrame:
    """SRT-06: the ``k`` most frequent values, among equals the one seen first in an order."""
    counted = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"), F.min(order).alias("_o"))
    return counted.orderBy(F.desc("n"), "_o", value).limit(k).drop("_o")


def head_and_tail(df: DataFrame, order: Sequence[Column], reverse: Sequence[Column], k: int) -> DataFrame:
    """SRT-07: the first and the last ``k`` rows of a ranking with their ``side``; ``reverse`` is the order turned round."""
    head = df.orderBy(*order).limit(k).withColumn("side", F.lit("head"))
    return head.unionByName(df.orderBy(*reverse).limit(k).withColumn("side", F.lit("tail")))


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """SRT-04, WIN-04: the first ``k`` rows of each group with their ``rank``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def ordered_union(lists: Sequence[DataFrame], key: str, n: int) -> DataFrame:
    """SRT-05: keys of several ranked lists (``key, rank``), earlier lists first, without repeats, cut at ``n``."""
    tagged = [d.select(key, F.lit(i).alias("_l"), "rank") for i, d in enumerate(lists)]
    both = tagged[0]
    for d in tagged[1:]:
        both = both.unionByName(d)
    first = both.groupBy(key).agg(F.min(F.struct("_l", "rank")).alias("_at"))
    cut = first.orderBy("_at", key).limit(n)
    return cut.select(key, F.row_number().over(Window.orderBy("_at", key)).alias("position"))  # n rows


def pairwise_agreement(df: DataFrame, raters: Sequence[str]) -> DataFrame:
    """AGG-28: for each two raters the rows that both rated, and the percentage on which they agree."""
    pairs = [
        F.struct(F.lit(a).alias("rater_a"), F.lit(b).alias("rater_b"), (F.col(a) == F.col(b)).alias("same"))
        for i, a in enumerate(raters)
        for b in raters[i + 1 :]
    ]
    rows = df.select(F.inline(F.array(*pairs))).where(F.col("same").isNotNull())
    return rows.groupBy("rater_a", "rater_b").agg(F.count("*").alias("n"), F.round(100.0 * F.avg(F.col("same").cast("int")), 4).alias("agree_pct"))


def voted(df: DataFrame, raters: Sequence[str]) -> DataFrame:
    """AGG-29, PRJ-10, PRJ-11: votes of raters with 1, 0 or null labels: counts, unanimity, signature and group."""
    count = lambda test: sum((F.coalesce(test(F.col(r)), F.lit(False)).cast("int") for r in raters), F.lit(0))
    n = len(raters)
    sign = lambda r: F.when(F.col(r) == 1, "T").when(F.col(r) == 0, "F").otherwise("NA")
    out = df.withColumns(
        {
            "n_models_parsed": count(lambda c: c.isNotNull()),
            "n_true_votes": count(lambda c: c == 1),
            "n_false_votes": count(lambda c: c == 0),
            "vote_signature": F.concat_ws(" | ", *[F.concat(F.lit(f"{r}="), sign(r)) for r in raters]),
        }
    )
    t, f, p = F.col("n_true_votes"), F.col("n_false_votes"), F.col("n_models_parsed")
    group = F.when(t == n, "all_true").when(f == n, "all_false")
    for k in range(n - 1, 0, -1):
        group = group.when(t == k, f"{k}_true")
    return out.withColumns(
        {"all_agree_true": t == n, "all_agree_false": f == n, "consensus_group": group.when(p > 0, "none_true").otherwise("unparsed")}
    )


def best_metadata(df: DataFrame, key: str = "id") -> DataFrame:
    """AGG-30: the row of each id with the most text, a year counting as 100 characters."""
    score = F.length(F.coalesce("title", F.lit(""))) + F.length(F.coalesce("abstract", F.lit(""))) + F.when(F.col("year").isNotNull(), 100).otherwise(0)
    w = Window.partitionBy(key).orderBy(F.desc("_score"), F.desc_nulls_last("year"), "title", "abstract")
    return df.withColumn("_score", score).withColumn("_at", F.row_number().over(w)).where("_at = 1").drop("_score", "_at")


def open_access_of(c: str | Column) -> Column:
    """AGG-53: whether a list of access kinds does not say closed; a null list is not open."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(~F.array_contains(F.transform(c, lambda x: F.lower(x)), "closed") & (F.size(c) > 0), F.lit(False))


def female_share(gender: str, known_only: bool) -> Column:
    """AGG-51, -52: share of women among all names, or among names of known gender."""
    women = F.count_if(F.col(gender) == "female")
    base = F.count_if(F.col(gender).isin("female", "male")) if known_only else F.count("*")
    return F.when(base > 0, women / base)


def quality_report(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """AGG-58, -59: (metric, value) rows: how many rows pass each check."""
    counts = df.agg(F.count("*").alias("rows"), *[F.count_if(c).alias(k) for k, c in checks.items()])
    names = ["rows", *checks]
    return counts.select(F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(f"`{k}`").alias("value")) for k in names])))
