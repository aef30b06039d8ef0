"""Ordered analytics over time (WIN-*, JN-23)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def daily_counts(df: DataFrame, date: str, by: Sequence[str] = ()) -> DataFrame:
    """WIN-09: ``day, n`` for every day from the first to the last, 0 where there is nothing."""
    by = list(by)
    counted = df.where(F.col(date).isNotNull()).groupBy(*by, F.to_date(date).alias("day")).agg(F.count("*").alias("n"))
    bounds = counted.groupBy(*by).agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = bounds.select(*by, F.explode(F.sequence("a", "b")).alias("day"))
    return days.join(counted, [*by, "day"], "left").na.fill(0, ["n"])


def trailing_sum(daily: DataFrame, days: int = 180, by: Sequence[str] = ()) -> DataFrame:
    """WIN-01: ``rolling``, the sum over the ``days`` days that end with each day, partial at the start."""
    at = F.datediff("day", F.lit("1970-01-01"))
    w = Window.partitionBy(*by).orderBy(at).rangeBetween(-(days - 1), 0)
    return daily.withColumn("rolling", F.sum("n").over(w))


def running_sum(df: DataFrame, by: Sequence[str], order: str, value: str, name: str = "running") -> DataFrame:
    """WIN-02."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(value).over(w))


def cumulative_distinct(df: DataFrame, by: str, year: str, value: str) -> DataFrame:
    """WIN-03: distinct values seen up to each year, for every year that the table has."""
    first = df.groupBy(by, value).agg(F.min(year).alias("year"))
    new = first.groupBy(by, "year").agg(F.count("*").alias("new"))
    grid = df.select(by).distinct().crossJoin(F.broadcast(df.select(F.col(year).alias("year")).distinct()))  # a few years
    both = grid.join(new, [by, "year"], "left").na.fill(0, ["new"])
    return running_sum(both, [by], "year", "new", "seen").select(by, "year", "seen")


def running_pct(df: DataFrame, value: str, order: Sequence[Column | str]) -> DataFrame:
    """WIN-07: percentage of the total, rounded, and the running sum of rounded percentages."""
    whole = df.withColumn("pct", F.round(100.0 * F.col(value) / F.sum(value).over(Window.partitionBy()), 2))
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return whole.withColumn("cum_pct", F.round(F.sum("pct").over(w), 2))


def smoothed(df: DataFrame, by: Sequence[str], order: str, value: str, sigma: float = 1.0, least: int = 3) -> DataFrame:
    """WIN-08: Gaussian smoothing with reflected edges, to four deviations; short series stay as they are.

    A row sees ``radius`` neighbours to either side by ``lag`` and ``lead``; the edges
    are reflected from the first and last ``2 * radius + 1`` values, so no row carries its series.
    """
    radius = int(4 * sigma + 0.5)
    weight = [2.718281828459045 ** (-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    total = sum(weight)
    w = Window.partitionBy(*by)
    ordered = w.orderBy(order)
    near = F.array(*[F.lag(value, -k).over(ordered) for k in range(-radius, radius + 1)])
    place = df.withColumns({"_n": F.count("*").over(w).cast("int"), "_at": F.row_number().over(ordered) - 1, "_near": near})
    # Values within a radius of an edge, once a series.
    edge = (F.col("_at") < radius) | (F.col("_at") >= F.col("_n") - radius)
    ends = place.where(edge).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_at", F.col(value).cast("double")))).alias("_ends"))
    # A table without groups is one series, whose ends are one row.
    out = place.join(ends, by, "left") if by else place.crossJoin(F.broadcast(ends))

    def reflected(i: Column) -> Column:
        turn = F.pmod(i, 2 * F.col("_n"))
        return F.when(turn < F.col("_n"), turn).otherwise(2 * F.col("_n") - 1 - turn)

    def at(k: int) -> Column:
        i = F.col("_at") + k
        return F.when((i >= 0) & (i < F.col("_n")), F.get("_near", F.lit(k + radius)).cast("double")).otherwise(
            F.try_element_at("_ends", reflected(i).cast("int"))
        )

    mixed = sum((at(k) * (v / total) for k, v in zip(range(-radius, radius + 1), weight, strict=True)), F.lit(0.0))
    return out.withColumn("smooth", F.when(F.col("_n") >= least, mixed).otherwise(F.col(value))).drop("_n", "_at", "_near", "_ends")


def interpolated(events: DataFrame, probes: DataFrame, key: str, ts: str, value: str, at: str, bucket_seconds: int = 86_400) -> DataFrame:
    """JN-23, WIN-10: the value of a series at each probe's instant, linear in time between its neighbours.

    Series and probes are merged and cut into buckets of time, so that a hot series
    splits. Within a bucket two running windows find the neighbours, one in either
    direction; beyond it they are the last and first points of other buckets, which
    the same two windows find over one row a bucket.
    """
    e = events.select(key, F.col(ts).alias("_t"), F.col(value).cast("double").alias("_v"), F.lit(0).alias("_p"))
    p = probes.select(key, F.col(at).alias("_t"), F.lit(None).cast("double").alias("_v"), F.lit(1).alias("_p"))
    both = e.unionByName(p).withColumn("_b", F.floor(_micros("_t") / F.lit(bucket_seconds * 1_000_000)))
    point = F.when(F.col("_p") == 0, F.struct("_t", "_v"))

    def swept(by: list[str], up: list, down: list, up_to: int) -> tuple[Window, Window]:
        rows = (Window.unboundedPreceding, up_to)
        return Window.partitionBy(*by).orderBy(*up).rowsBetween(*rows), Window.partitionBy(*by).orderBy(*down).rowsBetween(*rows)

    forward, back = swept([key, "_b"], ["_t", "_p"], [F.desc("_t"), F.asc("_p")], 0)
    near = both.withColumns({"_a": F.last(point, ignorenulls=True).over(forward), "_z": F.last(point, ignorenulls=True).over(back)})
    ends = both.where("_p = 0").groupBy(key, "_b").agg(
        F.max(F.struct("_t", "_v")).alias("_last"), F.min(F.struct("_t", "_v")).alias("_first")
    )
    known = ends.unionByName(both.where("_p = 1").select(key, "_b").distinct(), allowMissingColumns=True)
    known = known.groupBy(key, "_b").agg(F.max("_last").alias("_last"), F.min("_first").alias("_first"))
    before, after = swept([key], ["_b"], [F.desc("_b")], -1)
    beyond = known.select(
        F.col(key).alias("_k"), F.col("_b").alias("_kb"),
        F.last("_last", ignorenulls=True).over(before).alias("_before"), F.last("_first", ignorenulls=True).over(after).alias("_after"),
    )
    found = near.where("_p = 1").join(beyond, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_kb")))
    found = found.select(key, "_t", F.coalesce("_a", "_before").alias("_a"), F.coalesce("_z", "_after").alias("_z"))
    share = (_micros("_t") - _micros("_a._t")) / (_micros("_z._t") - _micros("_a._t"))
    value_at = F.when(F.col("_a._t") == F.col("_t"), F.col("_a._v")).when(
        F.col("_a").isNotNull() & F.col("_z").isNotNull(), F.col("_a._v") + share * (F.col("_z._v") - F.col("_a._v"))
    )
    return found.select(key, F.col("_t").alias(at), value_at.alias("interpolated"))


def seen_before(df: DataFrame, key: str, order: Sequence[Column | str]) -> DataFrame:
    """WIN-12: whether a key stood in an earlier row of a total order."""
    return df.withColumn("seen_before", F.row_number().over(Window.partitionBy(key).orderBy(*order)) > 1)


def scaled(df: DataFrame, c: str, low: float, high: float, name: str = "scaled") -> DataFrame:
    """WIN-14: a column mapped to an output range, the middle if all values are equal; the bounds are one row."""
    bounds = df.agg(F.min(c).alias("_a"), F.max(c).alias("_z"))
    a, z = F.col("_a"), F.col("_z")
    mapped = F.when(z > a, low + (F.col(c) - a) * (high - low) / (z - a)).otherwise((low + high) / 2)
    return df.crossJoin(F.broadcast(bounds)).withColumn(name, mapped).drop("_a", "_z")


def right_closed_bin(c: str, edges: Sequence[float]) -> Column:
    """WIN-15: the bin ``(a, b]`` of a value as text, the last one open, null outside."""
    out = F.when(F.lit(False), "")
    for a, b in zip(edges, edges[1:], strict=False):
        out = out.when((F.col(c) > a) & (F.col(c) <= b), f"({a:g},{b:g}]")
    return out.when(F.col(c) > edges[-1], f">{edges[-1]:g}")


def sessions(events: DataFrame, user: str, ts: str, gap_minutes: int) -> DataFrame:
    """STM-05 in batch: sessions of a user, cut where the gap is over ``gap_minutes``."""
    w = Window.partitionBy(user).orderBy(ts)
    new = F.coalesce(_micros(ts) - F.lag(_micros(ts)).over(w) > gap_minutes * 60_000_000, F.lit(True))
    numbered = events.withColumn("_new", new.cast("int")).withColumn(
        "session", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0))
    )
    return numbered.groupBy(user, "session").agg(
        F.count("*").alias("events"), F.min(ts).alias("started"), F.max(ts).alias("ended")
    )
