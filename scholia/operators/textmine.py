"""Tokens, n-grams, TF-IDF, discriminative terms, coherence (TXT-*, AGG-41, AGG-65, FLT-14)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words of scholarly prose that topics leave out.
SCHOLARLY_STOPWORDS = [
    "uk", "united", "kingdom", "biobank", "ukb", "study", "studies", "data", "dataset", "datasets", "participants", "participant",
    "cohort", "cohorts", "analysis", "analyses", "using", "based", "associated", "association", "associations", "risk", "results",
    "methods", "background", "conclusion", "conclusions", "objective", "objectives", "aim", "aims", "keywords", "funding", "conflict",
    "interest",
]


def stopwords(extra: Sequence[str] = SCHOLARLY_STOPWORDS) -> list[str]:
    """English stop-words of Spark's own list, and the given ones."""
    from pyspark.ml.feature import StopWordsRemover

    return sorted({*StopWordsRemover.loadDefaultStopWords("english"), *extra})


def tokens(c: str | Column, pattern: str = r"[a-zA-Z][a-zA-Z\-]{2,}", stop: Sequence[str] = ()) -> Column:
    """TXT-01: lower-cased matches of a pattern without stop-words."""
    found = F.regexp_extract_all(F.lower(F.col(c) if isinstance(c, str) else c), F.lit(f"({pattern.lower()})"), F.lit(1))
    if not stop:
        return found
    return F.filter(found, lambda t: ~t.isin(list(stop)))


def ngrams(c: str | Column, low: int, high: int) -> Column:
    """TXT-03: all runs of ``low`` to ``high`` tokens, joined by spaces.

    Shifted copies of the list are zipped, so ``c`` is evaluated once a shift, not once a token.
    """
    c = F.col(c) if isinstance(c, str) else c
    parts = []
    for n in range(low, high + 1):
        runs = c
        for k in range(1, n):
            runs = F.zip_with(runs, F.slice(c, k + 1, F.greatest(F.size(c), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
        parts.append(F.filter(runs, lambda g: g.isNotNull()))
    return F.concat(*parts)


def kept_token(c: Column, banned: Sequence[str], allowed: Sequence[str] = (), least: int = 3) -> Column:
    """FLT-14: a term that is no number, not short unless allowed, and not banned."""
    short = (F.length(c) < least) & ~c.isin(list(allowed))
    return ~c.rlike(r"\d") & ~short & ~c.isin(list(banned))


def tfidf(docs: DataFrame, doc: str, terms: str, min_df: int = 1, max_df: float = 1.0, max_terms: int | None = None) -> DataFrame:
    """TXT-02: ``doc, term, w``: counts times ``ln((1+n)/(1+df))+1``, rows of length 1.

    Terms in under ``min_df`` documents or over a ``max_df`` share of them are left
    out, then all but the ``max_terms`` most frequent ones.
    """
    counted = docs.select(doc, F.explode(terms).alias("term")).groupBy(doc, "term").agg(F.count("*").alias("tf"))
    n = docs.agg(F.count_distinct(doc).alias("n"))
    df = counted.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).crossJoin(F.broadcast(n))  # one row
    df = df.where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n")))
    if max_terms is not None:
        df = df.orderBy(F.desc("cf"), "term").limit(max_terms)
    idf = df.select("term", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    raw = counted.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(doc)))
    return raw.withColumn("w", F.col("w") / norm).select(doc, "term", "w")


def group_means(weights: DataFrame, groups: DataFrame, doc: str, group: str) -> DataFrame:
    """Mean weight of each term in each group over all its documents, those without the term too."""
    sizes = groups.groupBy(group).agg(F.count("*").alias("_n"))
    summed = weights.join(groups.select(doc, group), doc).groupBy(group, "term").agg(F.sum("w").alias("_s"))
    return summed.join(F.broadcast(sizes), group).select(group, "term", (F.col("_s") / F.col("_n")).alias("mean_w"))  # a row a group


def discriminative(weights: DataFrame, groups: DataFrame, doc: str, group: str, a, b) -> DataFrame:
    """AGG-41: difference of a term's mean weight between two groups."""
    means = group_means(weights, groups, doc, group)
    value = lambda g: F.coalesce(F.max(F.when(F.col(group) == g, F.col("mean_w"))), F.lit(0.0))
    return means.where(F.col(group).isin(a, b)).groupBy("term").agg(value(a).alias("mean_a"), value(b).alias("mean_b")).withColumn("diff", F.col("mean_a") - F.col("mean_b"))


def top_terms(weights: DataFrame, groups: DataFrame, doc: str, group: str, k: int = 15) -> DataFrame:
    """TXT-04: the ``k`` terms of the largest mean weight of each group."""
    means = group_means(weights, groups, doc, group)
    w = Window.partitionBy(group).orderBy(F.desc("mean_w"), "term")
    return means.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def frequent_terms(docs: DataFrame, doc: str, text: str, k: int, stop: Sequence[str]) -> DataFrame:
    """STR-21: the ``k`` most frequent terms of each document, longer ones first among equals."""
    counted = docs.select(doc, F.explode(tokens(text, stop=stop)).alias("term")).groupBy(doc, "term").agg(F.count("*").alias("n"))
    w = Window.partitionBy(doc).orderBy(F.desc("n"), F.desc(F.length("term")), "term")
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def coherence(docs: DataFrame, doc: str, terms: str, topics: DataFrame, window: int = 110) -> DataFrame:
    """TXT-05: mean normalised PMI of each topic's term pairs over sliding windows.

    ``topics`` has ``topic, term``. Windows are numbered by the position that they
    begin at, so a term stands in those that begin up to ``window`` before it.
    """
    vocabulary = topics.select("term").distinct()
    sized = docs.select(doc, terms, F.greatest(F.size(terms) - (window - 1), F.lit(1)).alias("_n"))
    total = sized.agg(F.sum("_n").alias("n"))
    placed = sized.select(doc, "_n", F.posexplode(terms).alias("_p", "term")).join(F.broadcast(vocabulary), "term")
    begins = F.sequence(F.greatest(F.col("_p") - (window - 1), F.lit(0)), F.least(F.col("_p"), F.col("_n") - 1))
    held = placed.where(F.col("_p") - (window - 1) <= F.col("_n") - 1).select(doc, "term", F.explode(begins).alias("_b")).distinct()
    single = held.groupBy("term").agg(F.count("*").alias("c"))
    both = (
        held.withColumnRenamed("term", "a").join(held.withColumnRenamed("term", "b"), [doc, "_b"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("c"))
    )
    pairs = topics.withColumnRenamed("term", "a").join(topics.withColumnRenamed("term", "b"), "topic").where("a < b")
    named = (
        pairs.join(both, ["a", "b"], "left")
        .join(single.select(F.col("term").alias("a"), F.col("c").alias("ca")), "a", "left")
        .join(single.select(F.col("term").alias("b"), F.col("c").alias("cb")), "b", "left")
        .crossJoin(F.broadcast(total))  # one row
    )
    p = F.coalesce("c", F.lit(0)) / F.col("n")
    value = F.log((p + 1e-12) / (F.col("ca") * F.col("cb") / (F.col("n") * F.col("n")))) / -F.log(p + 1e-12)
    return named.groupBy("topic").agg(F.avg(F.coalesce(value, F.lit(-1.0))).alias("coherence"))


def topic_diversity(topics: DataFrame) -> DataFrame:
    """AGG-65: distinct words by all words of the topics, one row."""
    return topics.agg((F.count_distinct("term") / F.count("*")).alias("diversity"))


def fingerprint(df: DataFrame, *columns: str) -> DataFrame:
    """TXT-06: order-free digest of a corpus, one row: twelve hex digits over the sum of every row's own digest."""
    text = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    each = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")
    sums = df.agg(F.sum(each).cast("string").alias("a"), F.count("*").cast("string").alias("b"))
    return sums.select(F.substring(F.sha1(F.concat_ws("|", "a", "b").cast("binary")), 1, 12).alias("fingerprint"))
