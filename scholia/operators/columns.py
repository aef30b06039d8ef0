"""Column inference, defaults, overlays and row filters (PRJ-*, FLT-*)."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_existing(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    """PRJ-01: the first candidate that is a column."""
    return next((c for c in candidates if c in columns), None)


def plain_name(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_")


def infer_column(columns: Sequence[str], candidates: Sequence[str], override: str | None = None, required: bool = False, label: str = "") -> str | None:
    """PRJ-02: a column by candidate names, equal first and then contained either way; an override must exist."""
    if override:
        if override not in columns:
            raise KeyError(f"no column {override!r}")
        return override
    by_name = {plain_name(c): c for c in reversed(list(columns))}
    wanted = [plain_name(c) for c in candidates]
    for w in wanted:
        if w in by_name:
            return by_name[w]
    for w in wanted:
        for c in columns:
            if (name := plain_name(c)) and (w in name or name in w):
                return c
    if required:
        raise KeyError(f"no column for {label or candidates[0]!r}")
    return None


def key_columns(columns: Sequence[str], ignored: Sequence[str] = ("id", "file", "columns")) -> list[str]:
    """PRJ-03: the columns of an evidence table that are keys."""
    found = [c for c in columns if c not in ignored]
    if not found:
        raise ValueError("an evidence table needs a key column")
    return found


def columns_with(columns: Sequence[str], words: Sequence[str], preferred: str = "author") -> list[str]:
    """PRJ-04: columns whose name has one of the words; those that also have ``preferred``, if any."""
    found = [c for c in columns if any(w in c.lower() for w in words)]
    return [c for c in found if preferred in c.lower()] or found


def as_strings(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """PRJ-05: columns as text; arrays and records as JSON."""
    kinds = dict(df.dtypes)
    nested = lambda c: kinds[c].startswith(("array", "struct", "map"))
    return df.withColumns({c: F.to_json(c) if nested(c) else F.col(c).cast("string") for c in columns})


def with_missing(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """PRJ-07: absent columns as typed nulls."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fail early with all missing names."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}")
    return df


def patched(df: DataFrame, patch: DataFrame, on: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """PRJ-08, JN-05: values of a patch win over existing ones; rows without a patch stay."""
    keys = [on] if isinstance(on, str) else list(on)
    side = patch.select(*keys, *[F.col(c).alias(f"__patch_{c}") for c in columns])
    out = df.join(side, keys, "left").withColumns({c: F.coalesce(f"__patch_{c}", c) for c in columns})
    return out.select(*df.columns)


def filled_or(own: str | Column, other: str | Column) -> Column:
    """PRJ-09: the own text unless it is blank."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (own, other))
    return F.coalesce(F.when(F.trim(a) != "", a), b)


def recoded(c: str, values: Mapping[str, str], keep: bool = True) -> Column:
    """PRJ-13: values by a table; others stay, or become null."""
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    found = F.try_element_at(table, F.col(c))
    return F.coalesce(found, c) if keep else found


def positions(df: DataFrame, order: Sequence[str | Column], start: int = 0, stop: int | None = None) -> DataFrame:
    """PRJ-16: rows ``start:stop`` of an order, negative positions counted from the end; ranges are numbered apart."""
    from scholia.operators.dedup import dense_numbers

    numbered = dense_numbers(df, order, "_at")
    n = numbered.count() if min(start, stop or 0) < 0 else 0
    low, high = (start + n * (start < 0)), None if stop is None else stop + n * (stop < 0)
    out = numbered.where(F.col("_at") >= low)
    return (out if high is None else out.where(F.col("_at") < high)).drop("_at")


def filled_text(c: str | Column) -> Column:
    """FLT-01: a text that is neither null nor blank."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.trim(c) != "", F.lit(False))


def valid_year(c: str | Column, low: int = 1900, high: int = 2035) -> Column:
    """FLT-04: a year within bounds, else null."""
    year = (F.col(c) if isinstance(c, str) else c).cast("string").try_cast("double").cast("int")
    return F.when(year.between(low, high), year)


def within_years(df: DataFrame, year: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """FLT-05: rows from a first to a last year, either of which may be open; a null year is in neither."""
    bounds = [F.col(year) >= low] * (low is not None) + [F.col(year) <= high] * (high is not None)
    for b in bounds:
        df = df.where(b)
    return df


def positive(df: DataFrame, *measures: str) -> DataFrame:
    """FLT-07: rows on which every measure is over zero."""
    for m in measures:
        df = df.where(F.col(m) > 0)
    return df


def split_label(test: Column, yes: str, no: str) -> Column:
    """PRJ-12: one of two labels; an unknown test is no."""
    return F.when(test, yes).otherwise(no)


def year_month(c: str | Column | None = None) -> Column:
    """DAT-03: the stamp ``yyyyMM`` of a date, of today without one."""
    return F.date_format(F.current_date() if c is None else c, "yyyyMM")


def marker_size(c: str | Column, scale: float = 1.0) -> Column:
    """NUM-02: a size whose area grows with the value, 0 below zero."""
    return scale * F.sqrt(F.greatest(F.col(c) if isinstance(c, str) else c, F.lit(0.0)))


def damped(c: str | Column) -> Column:
    """NUM-02: ``log(1 + x)``."""
    return F.log1p(F.col(c) if isinstance(c, str) else c)


def array_pairs(c: str | Column) -> Column:
    """ARR-08: unordered pairs of a list's distinct elements as structs ``a < b``, inside the row."""
    items = F.array_sort(F.array_distinct(F.filter(F.col(c) if isinstance(c, str) else c, lambda x: x.isNotNull())))
    after = lambda xs, x, i: F.transform(F.slice(xs, i + 2, F.size(xs)), lambda y: F.struct(x.alias("a"), y.alias("b")))
    return F.flatten(F.get(F.transform(F.array(items), lambda xs: F.transform(xs, lambda x, i: after(xs, x, i))), 0))


#: Twelve named categories of biomedical text.
CATEGORIES = {
    "explicit UKB": r"\b(uk\s*biobank|u\.?k\.?\s*biobank|united\s+kingdom\s+biobank|ukb|ukbb)\b",
    "generic biobank": r"\b(biobank|biobanking|biobanks)\b",
    "UK population cue": r"\b(uk|british|england|scotland|wales|united kingdom)\b",
    "cohort / participants": r"\b(cohort|participants|population[- ]based|prospective|baseline assessment)\b",
    "genetics / genomics": r"\b(genetic|genomic|genotype|genotyping|gwas|polygenic|exome|sequencing)\b",
    "imaging": r"\b(imaging|mri|brain imaging|cardiac imaging|radiomics)\b",
    "linked records / EHR": r"\b(linked records|hospital episode statistics|hes|electronic health records|ehr|registry|registries)\b",
    "machine learning": r"\b(machine learning|deep learning|artificial intelligence|neural network|prediction model)\b",
    "cardiometabolic": r"\b(cardiovascular|heart|diabetes|obesity|metabolic|hypertension)\b",
    "cancer": r"\b(cancer|tumou?r|oncology|carcinoma|neoplasm)\b",
    "mental health / brain": r"\b(depression|anxiety|psychiatric|mental health|brain|cognition|dementia)\b",
    "other named biobank": r"\b(china kadoorie|biobank japan|finn?gen|all of us|million veteran|lifelines|decode|cartagene)\b",
}


def matches(c: str | Column, pattern: str) -> Column:
    """FLT-08: whether a pattern occurs, in any case; null text does not match."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.rlike(f"(?i){pattern}"), F.lit(False))


def category_shares(df: DataFrame, text: str, group: Column, categories: Mapping[str, str] = CATEGORIES) -> DataFrame:
    """FLT-09, AGG-26: per group and category the matching rows, all rows, and the percentage."""
    flags = [F.struct(F.lit(k).alias("category"), matches(text, p).cast("int").alias("hit")) for k, p in categories.items()]
    return (
        df.select(group.alias("grp"), F.inline(F.array(*flags)))
        .groupBy("grp", "category")
        .agg(F.sum("hit").alias("hits"), F.count("*").alias("n"))
        .withColumn("pct", F.round(100.0 * F.col("hits") / F.greatest("n", F.lit(1)), 4))
    )


def sampled(df: DataFrame, group: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """FLT-15: at most ``n`` rows of each group, by a seeded hash of the key."""
    w = Window.partitionBy(group).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)
    return df.withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= n).drop("_at")


def reconciled(a: DataFrame, b: DataFrame, on: str, left: str, right: str) -> DataFrame:
    """JN-13: both sides of a full outer join with zeros for missing counts, and their ratio."""
    both = a.select(on, left).join(b.select(on, right), on, "full_outer").na.fill(0, [left, right])
    return both.withColumn("ratio", F.when(F.col(right) != 0, F.col(left) / F.col(right)))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """WIN-06: the first row of each key in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_at", F.row_number().over(w)).where("_at = 1").drop("_at")


def dedupe_filled(df: DataFrame, key: str, order: Sequence[str | Column]) -> DataFrame:
    """SET-08: first row of each filled key; rows without a key all stay."""
    filled = F.col(key).isNotNull()
    return keep_first(df.where(filled), [key], order).unionByName(df.where(~filled))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SET-07: all rows whose key occurs more than once, with ``copies``."""
    return df.withColumn("copies", F.count("*").over(Window.partitionBy(*keys))).where("copies > 1")


def same_sets(a: DataFrame, b: DataFrame) -> bool:
    """SET-05: whether two tables hold the same rows as sets."""
    return a.subtract(b).isEmpty() and b.subtract(a).isEmpty()
