"""Countries, genders and affiliations by rule cascades (GEO-*, GEN-*, ARR-05..07)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: Country names and three-letter codes that are known without a library.
COUNTRY_NAMES = {
    "UNITED KINGDOM": "GB",
    "UNITED STATES": "US",
    "UNITED STATES OF AMERICA": "US",
    "USA": "US",
    "SOUTH KOREA": "KR",
    "REPUBLIC OF KOREA": "KR",
    "KOREA": "KR",
    "JAPAN": "JP",
    "GERMANY": "DE",
    "FRANCE": "FR",
    "CHINA": "CN",
    "PEOPLE'S REPUBLIC OF CHINA": "CN",
    "AUSTRALIA": "AU",
    "CANADA": "CA",
    "ITALY": "IT",
    "SPAIN": "ES",
}
THREE_LETTERS = {"GBR": "GB", "USA": "US", "KOR": "KR", "JPN": "JP", "CHN": "CN"}
#: Marks of a company's home, sure ones and likely ones.
SURE_MARKS = {"주식회사": "KR", "산학협력단": "KR", "재단법인": "KR", "대학교": "KR", "株式会社": "JP", "有限会社": "JP", r"\bplc\b": "GB", r"\bpty\s?ltd\b": "AU", r"\bgmbh\b": "DE"}
LIKELY_MARKS = {r"\binc\.?\b": "US", r"\bllc\b": "US", r"\bltd\b": "GB", r"\bsa\b": "FR"}


_ISO: list[tuple[str, str, str]] = []


def iso_countries(spark: SparkSession | None = None) -> list[tuple[str, str, str]]:
    """Two- and three-letter code and English name of every country in the Java runtime's ISO 3166 table."""
    if not _ISO:
        session = spark or SparkSession.getActiveSession()
        if session is None:
            raise RuntimeError("countries come from the session's Java runtime; start a session first")
        util = session.sparkContext._jvm.java.util
        for code in util.Locale.getISOCountries():
            place = util.Locale.Builder().setRegion(code).build()
            _ISO.append((code, place.getISO3Country(), place.getDisplayCountry(util.Locale.ENGLISH)))
    return _ISO


def country_names() -> dict[str, str]:
    """Upper-case names and their two-letter codes; the fixed names come before the ISO table's."""
    return {name.upper(): code for code, _, name in iso_countries()} | COUNTRY_NAMES


def three_letter_codes() -> dict[str, str]:
    return {three: code for code, three, _ in iso_countries() if three} | THREE_LETTERS


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def iso2(c: str | Column) -> Column:
    """GEO-01: a country as its two-letter code, by code, name, name token, then nearest name.

    Nearest is by edit distance within a fifth of the longer name.
    """
    names, threes = country_names(), three_letter_codes()
    table = _map(names)
    s = F.trim(_c(c))
    key = F.upper(s)
    tokens = F.split(key, r"[,;/\-()\s]+")
    by_token = F.get(F.filter(F.transform(tokens, lambda t: F.try_element_at(table, t)), lambda x: x.isNotNull()), 0)
    known = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(i).alias("i")) for n, i in names.items()])
    near = F.array_min(
        F.filter(
            F.transform(known, lambda e: F.struct(F.levenshtein(key, e.n).alias("d"), F.length(e.n).alias("n"), e.i.alias("i"))),
            lambda e: e.d <= 0.2 * F.greatest(e.n, F.length(key)),
        )
    )
    return (
        F.when(s.rlike(r"^\p{L}{2}$"), key)
        .when(s.rlike(r"^\p{L}{3}$") & F.try_element_at(_map(threes), key).isNotNull(), F.try_element_at(_map(threes), key))
        .when(s != "", F.coalesce(F.try_element_at(table, key), by_token, near["i"]))
    )


def country_of_name(c: str | Column, likely: bool = False) -> Column:
    """GEO-02: country of an organisation's name: marks, then a country at the end, then the whole name."""
    s = F.trim(_c(c))
    marks = SURE_MARKS | (LIKELY_MARKS if likely else {})
    by_mark = F.coalesce(*[F.when(F.lower(s).rlike(p), iso) for p, iso in marks.items()])
    last = F.nullif(F.regexp_extract(s, r"[(\[,] *([A-Za-z '.]+?) *[)\]]?$", 1), F.lit(""))
    return F.coalesce(by_mark, iso2(last), iso2(s))


def assignee_countries(records: str | Column, names: str | Column) -> Column:
    """GEO-03: struct of ``countries``, ``primary`` and ``source`` of a patent's assignees.

    ``records`` is an array of structs with ``name`` and ``country_code``; codes come
    first, then the plain names, then the records' names.
    """
    some = lambda a: F.array_distinct(F.filter(a, lambda x: x.isNotNull()))
    codes = some(F.transform(_c(records), lambda r: iso2(r["country_code"])))
    plain = some(F.transform(_c(names), lambda n: country_of_name(n)))
    own = some(F.transform(_c(records), lambda r: country_of_name(r["name"])))
    none = F.array().cast("array<string>")
    first = lambda a: F.size(F.coalesce(a, none)) > 0
    found = F.when(first(codes), codes).when(first(plain), plain).when(first(own), own).otherwise(none)
    source = F.when(first(codes), "assignees").when(first(plain), "assignee_names").when(first(own), "assignees_name").otherwise("none")
    return F.struct(found.alias("countries"), F.get(found, 0).alias("primary"), source.alias("source"))


def with_iso3(df: DataFrame, countries: DataFrame, code: str = "country_code", name: str = "country") -> DataFrame:
    """GEO-04, JN-16: ``iso3`` by code, else by name, from a small dimension ``iso2, iso3, admin``.

    A dimension code of ``-99`` counts as missing.
    """
    dim = countries.withColumn("iso3", F.nullif(F.col("iso3"), F.lit("-99")))
    by_code = dim.select(F.upper("iso2").alias("_k2"), F.col("iso3").alias("_i2")).dropDuplicates(["_k2"])
    by_name = dim.select(F.upper("admin").alias("_kn"), F.col("iso3").alias("_in")).dropDuplicates(["_kn"])
    return (
        df.join(by_code, F.upper(code) == F.col("_k2"), "left")
        .join(by_name, F.upper(name) == F.col("_kn"), "left")
        .withColumn("iso3", F.coalesce("_i2", "_in"))
        .drop("_k2", "_i2", "_kn", "_in")
    )


def with_gender(df: DataFrame, names: DataFrame, first: str = "first_name", support: int = 30, sure: float = 0.8) -> DataFrame:
    """GEN-01, GEN-02: ``gender`` and ``gender_source`` by forename.

    ``names`` has ``name, gender, n, p_female``; ``mostly_`` genders are collapsed, and
    where the dictionary is silent a statistic with enough support decides.
    """
    key = F.lower(F.get(F.split(F.trim(F.col(first)), r"[\s-]+"), 0))
    dim = names.select(
        F.lower("name").alias("_name"),
        F.regexp_replace("gender", "^mostly_", "").alias("_g"),
        F.when((F.col("n") >= support) & (F.col("p_female") >= sure), "female").when((F.col("n") >= support) & (F.col("p_female") <= 1 - sure), "male").alias("_s"),
    ).dropDuplicates(["_name"])
    known = F.when(F.col("_g").isin("female", "male"), F.col("_g"))
    return (
        df.withColumn("_key", key)
        .join(dim, F.col("_key") == F.col("_name"), "left")
        .withColumn("gender", F.coalesce(known, "_s", F.lit("unknown")))
        .withColumn("gender_source", F.when(known.isNotNull(), "dictionary").when(F.col("_s").isNotNull(), "statistic").otherwise("none"))
        .drop("_key", "_name", "_g", "_s")
    )


def main_affiliation(affiliations: str | Column, current: str | Column) -> Column:
    """ARR-06: the affiliation of the current organisation, else the first, with its ``source``."""
    a = _c(affiliations)
    own = F.get(F.filter(a, lambda x: x["id"] == _c(current)), 0)
    return F.struct(
        F.coalesce(own, F.get(a, 0)).alias("affiliation"),
        F.when(own.isNotNull(), "current").when(F.size(a) > 0, "first").alias("source"),
    )


def enriched(ap: DataFrame, grid: DataFrame) -> DataFrame:
    """JN-15: complete an affiliation from its own grid id, then from the current organisation, with a flag.

    ``grid`` has ``grid, g_name, g_country, g_code``.
    """
    own = grid.select(*[F.col(c).alias(f"o_{c}") for c in ("grid", "g_name", "g_country", "g_code")])
    now = grid.select(*[F.col(c).alias(f"n_{c}") for c in ("grid", "g_name", "g_country", "g_code")])
    blank = F.col("country").isNull()
    none = blank & F.col("org_grid").isNull()
    return (
        ap.join(own, F.col("org_grid") == F.col("o_grid"), "left")
        .join(now, F.col("current_org_id") == F.col("n_grid"), "left")
        .withColumn("aff_enriched", blank & F.coalesce("o_g_country", F.when(none, F.col("n_g_country"))).isNotNull())
        .withColumn("org_name", F.coalesce("org_name", "o_g_name", F.when(none, F.col("n_g_name"))))
        .withColumn("country_code", F.coalesce("country_code", "o_g_code", F.when(none, F.col("n_g_code"))))
        .withColumn("country", F.coalesce("country", "o_g_country", F.when(none, F.col("n_g_country"))))
        .drop(*own.columns, *now.columns)
    )


def picked(indices: str | Column, values: str | Column) -> Column:
    """ARR-07: the values at 0-based indices, in order, without repeats or indices out of bounds."""
    v = _c(values)
    inside = F.filter(F.array_distinct(_c(indices)), lambda i: (i >= 0) & (i < F.size(v)))
    return F.transform(inside, lambda i: F.get(v, i))
