"""Queries of metrics, windows, fractional counts, shares and consensus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.operators import columns, metrics, windows
from scholia.plans.registry import Registry, Tables

REGISTRY = Registry()
query = REGISTRY.query


def slots(t: Tables) -> DataFrame:
    """Author slots of papers: supplier as author, order as paper, quantity as citations, nation as country."""
    return (
        t.lineitem.select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", "l_quantity")
        .join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.col("l_orderkey").alias("paper"), F.col("l_suppkey").alias("author"), F.col("s_nationkey").alias("country"),
            F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("cites"),
        )
    )


SLOTS = """slots AS (SELECT l_orderkey AS paper, l_suppkey AS author, s_nationkey AS country, l_partkey AS part, l_linenumber AS line, l_quantity AS cites
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""


def _indices_sql(key: str, source: str = "slots") -> str:
    return f"""r AS (SELECT {key}, c, row_number() OVER (PARTITION BY {key} ORDER BY c DESC) AS i, sum(c) OVER (PARTITION BY {key} ORDER BY c DESC ROWS UNBOUNDED PRECEDING) AS s
      FROM (SELECT {key}, coalesce(cites, 0) AS c FROM {source})),
    ix AS (SELECT {key}, count_if(c >= i)::BIGINT AS h_index, coalesce(max(CASE WHEN s >= i * i THEN i END), 0)::BIGINT AS g_index, count_if(c >= 10)::BIGINT AS i10_index FROM r GROUP BY {key})"""


def _table_sql(key: str, name: str) -> str:
    return f"""WITH {SLOTS}, {_indices_sql(key)}, m AS (SELECT {key}, count(DISTINCT paper) AS papers, sum(cites)::DOUBLE AS total_cites, avg(cites) AS mean_cites,
      median(cites) AS median_cites, max(cites) AS max_cites, var_pop(cites) AS var_cites, skewness(cites) AS skew_cites, avg((cites = 0)::INT) AS uncited FROM slots GROUP BY {key})
    SELECT {key} AS {name}, papers, total_cites, round(mean_cites, 6) AS mean_cites, median_cites, max_cites, round(var_cites, 5) AS var_cites, round(skew_cites, 5) AS skew_cites,
      h_index, g_index, i10_index, round(uncited, 6) AS uncited_share, round(h_index::DOUBLE / papers, 6) AS h_per_paper,
      round(total_cites / (SELECT sum(cites) FROM slots), 8) AS cite_share FROM m JOIN ix USING ({key})"""


def _table(t: Tables, key: str, name: str) -> DataFrame:
    made = metrics.metric_table(slots(t), key, "paper", "cites")
    r = lambda c, n=6: F.round(c, n).alias(c)
    return made.select(
        F.col(key).alias(name), "papers", "total_cites", r("mean_cites"), "median_cites", "max_cites", r("var_cites", 5), r("skew_cites", 5),
        "h_index", "g_index", "i10_index", r("uncited_share"), r("h_per_paper"), r("cite_share", 8),
    )


@query("author_metrics", _table_sql("author", "author"))
def author_metrics(t: Tables) -> DataFrame:
    return _table(t, "author", "author")


@query("institution_metrics", _table_sql("country", "institution"))
def institution_metrics(t: Tables) -> DataFrame:
    return _table(t, "country", "institution")


@query(
    "institution_partners",
    f"""WITH {SLOTS}, p AS (SELECT DISTINCT paper, country FROM slots), n AS (SELECT paper, count(*) AS n FROM p GROUP BY paper),
      k AS (SELECT a.country, count(DISTINCT b.country) AS partners FROM p a JOIN p b ON a.paper = b.paper AND a.country <> b.country GROUP BY 1)
    SELECT p.country, round(avg(n), 6) AS mean_orgs, count_if(n = 1)::BIGINT AS papers_alone, coalesce(max(partners), 0) AS partners
    FROM p JOIN n USING (paper) LEFT JOIN k ON k.country = p.country GROUP BY p.country""",
)
def institution_partners(t: Tables) -> DataFrame:
    return metrics.collaborators(slots(t), "paper", "country").withColumn("mean_orgs", F.round("mean_orgs", 6))


for _name in ("h_index", "g_index", "i10_index"):

    @query(_name, f"WITH {SLOTS}, {_indices_sql('author')} SELECT author, {_name} FROM ix")
    def _index(t: Tables, name: str = _name) -> DataFrame:
        return metrics.citation_indices(slots(t), "author", "cites").select("author", name)


@query(
    "mode_first",
    """WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS o FROM orders GROUP BY 1, 2)
    SELECT o_custkey, o_orderpriority AS mode, n AS mode_n FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o, o_orderpriority) = 1""",
)
def mode_first(t: Tables) -> DataFrame:
    return metrics.mode_by(t.orders, "o_custkey", "o_orderpriority", tie="first", order="o_orderkey")


@query(
    "mode_smallest",
    """WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)
    SELECT o_custkey, o_orderpriority AS mode, n AS mode_n FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) = 1""",
)
def mode_smallest(t: Tables) -> DataFrame:
    return metrics.mode_by(t.orders, "o_custkey", "o_orderpriority")


@query(
    "field_summary",
    f"""WITH s AS (SELECT string_split(p_type, ' ')[1] AS field, author, country, cites FROM (WITH {SLOTS} SELECT * FROM slots) JOIN part ON part = p_partkey),
      {_indices_sql('field', 's')},
      a AS (SELECT field, author, row_number() OVER (PARTITION BY field ORDER BY count(*) DESC, author) AS k FROM s GROUP BY 1, 2),
      b AS (SELECT field, country, row_number() OVER (PARTITION BY field ORDER BY count(*) DESC, country) AS k FROM s GROUP BY 1, 2),
      m AS (SELECT field, count(*) AS papers, sum(cites)::DOUBLE AS total_cites, round(avg(cites), 6) AS mean_cites, count(DISTINCT author) AS people, count(DISTINCT country) AS orgs FROM s GROUP BY 1)
    SELECT m.*, a.author AS modal_person, b.country AS modal_org, h_index FROM m JOIN ix USING (field) JOIN a ON a.field = m.field AND a.k = 1 JOIN b ON b.field = m.field AND b.k = 1""",
)
def field_summary(t: Tables) -> DataFrame:
    s = slots(t).join(t.part.select("p_partkey", F.get(F.split("p_type", " "), 0).alias("field")), F.col("part") == F.col("p_partkey"))
    return metrics.field_summary(s, "field", "cites", "author", "country").withColumn("mean_cites", F.round("mean_cites", 6))


@query(
    "growth_top10",
    """WITH c AS (SELECT o_custkey % 50 AS grp, count_if(year(o_orderdate) = 1996)::BIGINT AS n_base, count_if(year(o_orderdate) = 1999)::BIGINT AS n_last FROM orders GROUP BY 1)
    SELECT grp, n_base, n_last, round(100.0::DOUBLE * (n_last - n_base) / n_base, 6) AS growth_pct FROM c WHERE n_base > 0 ORDER BY growth_pct DESC, grp LIMIT 10""",
)
def growth_top10(t: Tables) -> DataFrame:
    rows = t.orders.select((F.col("o_custkey") % 50).alias("grp"), F.year("o_orderdate").alias("year"))
    return metrics.growth(rows, "grp", "year", 1996, 1999).withColumn("growth_pct", F.round("growth_pct", 6))


@query(
    "rolling_180d",
    """WITH c AS (SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1),
      d AS (SELECT unnest(generate_series((SELECT min(day) FROM c), (SELECT max(day) FROM c), INTERVAL 1 DAY))::DATE AS day)
    SELECT d.day, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (ORDER BY d.day ROWS 179 PRECEDING)::BIGINT AS rolling FROM d LEFT JOIN c USING (day)""",
)
def rolling_180d(t: Tables) -> DataFrame:
    return windows.trailing_sum(windows.daily_counts(t.orders, "o_orderdate"), 180)


@query(
    "rolling_by_group",
    """WITH c AS (SELECT o_orderpriority AS grp, o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1, 2),
      b AS (SELECT grp, min(day) AS a, max(day) AS z FROM c GROUP BY 1), d AS (SELECT grp, unnest(generate_series(a, z, INTERVAL 1 DAY))::DATE AS day FROM b)
    SELECT d.grp, d.day, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY d.grp ORDER BY d.day ROWS 29 PRECEDING)::BIGINT AS rolling
    FROM d LEFT JOIN c ON c.grp = d.grp AND c.day = d.day""",
)
def rolling_by_group(t: Tables) -> DataFrame:
    rows = t.orders.withColumnRenamed("o_orderpriority", "grp")
    return windows.trailing_sum(windows.daily_counts(rows, "o_orderdate", ["grp"]), 30, ["grp"])


YEARS = "y AS (SELECT c_nationkey AS nation, year(o_orderdate)::INT AS year, o_custkey, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey)"


def yearly(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").alias("nation"), F.year("o_orderdate").alias("year"), "o_custkey", "o_orderkey"
    )


@query(
    "cumulative_sum",
    f"WITH {YEARS}, c AS (SELECT nation, year, count(*) AS n FROM y GROUP BY 1, 2) SELECT *, sum(n) OVER (PARTITION BY nation ORDER BY year)::BIGINT AS running FROM c",
)
def cumulative_sum(t: Tables) -> DataFrame:
    return windows.running_sum(yearly(t).groupBy("nation", "year").agg(F.count("*").alias("n")), ["nation"], "year", "n")


@query(
    "cumulative_distinct",
    f"""WITH {YEARS}, f AS (SELECT nation, o_custkey, min(year) AS year FROM y GROUP BY 1, 2), g AS (SELECT * FROM (SELECT DISTINCT nation FROM y), (SELECT DISTINCT year FROM y))
    SELECT g.nation, g.year, count(f.o_custkey) AS seen FROM g LEFT JOIN f ON f.nation = g.nation AND f.year <= g.year GROUP BY 1, 2""",
)
def cumulative_distinct(t: Tables) -> DataFrame:
    return windows.cumulative_distinct(yearly(t), "nation", "year", "o_custkey")


@query(
    "running_pct",
    """WITH c AS (SELECT o_orderpriority AS grp, count(*) AS n FROM orders GROUP BY 1), p AS (SELECT *, round(100.0::DOUBLE * n / sum(n) OVER (), 2) AS pct FROM c)
    SELECT grp, n, pct, round(sum(pct) OVER (ORDER BY n DESC, grp ROWS UNBOUNDED PRECEDING), 2) AS cum_pct FROM p""",
)
def running_pct(t: Tables) -> DataFrame:
    counted = t.orders.groupBy(F.col("o_orderpriority").alias("grp")).agg(F.count("*").alias("n"))
    return windows.running_pct(counted, "n", [F.desc("n"), "grp"])


@query(
    "interp_at_time",
    """WITH s AS (SELECT event_type, ts, min(value) AS value FROM events GROUP BY 1, 2),
      p AS (SELECT DISTINCT event_type, TIMESTAMP '2024-01-03 12:00:00' + to_hours((36 * k)::BIGINT) AS "at" FROM s, range(15) r(k)),
      a AS (SELECT p.event_type, p."at", max(ts) AS ta FROM p JOIN s ON s.event_type = p.event_type AND s.ts <= p."at" GROUP BY 1, 2),
      b AS (SELECT p.event_type, p."at", min(ts) AS tb FROM p JOIN s ON s.event_type = p.event_type AND s.ts >= p."at" GROUP BY 1, 2)
    SELECT p.event_type, p."at", round(CASE WHEN ta = p."at" THEN sa.value ELSE sa.value + (epoch_us(p."at") - epoch_us(ta))::DOUBLE / (epoch_us(tb) - epoch_us(ta)) * (sb.value - sa.value) END, 6) AS interpolated
    FROM p LEFT JOIN a ON a.event_type = p.event_type AND a."at" = p."at" LEFT JOIN b ON b.event_type = p.event_type AND b."at" = p."at"
      LEFT JOIN s sa ON sa.event_type = p.event_type AND sa.ts = ta LEFT JOIN s sb ON sb.event_type = p.event_type AND sb.ts = tb""",
)
def interp_at_time(t: Tables) -> DataFrame:
    s = t.events.groupBy("event_type", "ts").agg(F.min("value").alias("value"))
    at = F.expr("sequence(timestamp'2024-01-03 12:00:00', timestamp'2024-01-03 12:00:00' + interval 504 hours, interval 36 hours)")
    probes = t.events.select("event_type").distinct().select("event_type", F.explode(at).alias("at"))
    ltz = probes.withColumn("at", F.col("at").cast(t.events.schema["ts"].dataType))
    return windows.interpolated(s, ltz, "event_type", "ts", "value", "at").withColumn("interpolated", F.round("interpolated", 6))


@query(
    "rank_in_group",
    "SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem",
)
def rank_in_group(t: Tables) -> DataFrame:
    order = [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"]
    return metrics.top_per_group(t.lineitem, ["l_suppkey"], order, 2**31 - 1).select("l_suppkey", "l_orderkey", "l_linenumber", F.col("rank").cast("long").alias("rank"))


@query(
    "topk_per_group",
    """SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 3""",
)
def topk_per_group(t: Tables) -> DataFrame:
    order = [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"]
    return metrics.top_per_group(t.lineitem, ["l_suppkey"], order, 3).select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")


@query(
    "top4_other",
    """WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, p_brand) AS k FROM c)
    SELECT CASE WHEN k <= 4 THEN p_brand ELSE 'Other' END AS p_brand, sum(n)::BIGINT AS n FROM r GROUP BY 1""",
)
def top4_other(t: Tables) -> DataFrame:
    return metrics.top_or_other(t.part, "p_brand", 4)


@query(
    "ordered_topk_union",
    """WITH a AS (SELECT p_brand, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS rank FROM part GROUP BY 1), b AS (SELECT p_brand, row_number() OVER (ORDER BY sum(p_retailprice) DESC, p_brand) AS rank FROM part GROUP BY 1),
      u AS (SELECT p_brand, 0 AS l, rank FROM a WHERE rank <= 5 UNION ALL SELECT p_brand, 1, rank FROM b WHERE rank <= 8),
      f AS (SELECT p_brand, min(l * 1000 + rank) AS o FROM u GROUP BY 1)
    SELECT p_brand, row_number() OVER (ORDER BY o, p_brand) AS position FROM f ORDER BY o, p_brand LIMIT 9""",
)
def ordered_topk_union(t: Tables) -> DataFrame:
    by = t.part.groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("p_retailprice").alias("s")).withColumn("_", F.lit(1))
    a = metrics.top_per_group(by, ["_"], [F.desc("n"), "p_brand"], 5)
    b = metrics.top_per_group(by, ["_"], [F.desc("s"), "p_brand"], 8)
    return metrics.ordered_union([a, b], "p_brand", 9).withColumn("position", F.col("position").cast("long"))


@query(
    "fractional_country",
    f"""WITH {SLOTS}, w AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY paper) AS w FROM (SELECT paper, CASE WHEN author % 7 <> 0 THEN country END AS country FROM slots))
    SELECT country, round(sum(w), 6) AS frac, count(*) AS slots, count(DISTINCT paper) AS papers FROM w WHERE country IS NOT NULL GROUP BY 1""",
)
def fractional_country(t: Tables) -> DataFrame:
    rows = slots(t).select("paper", F.when(F.col("author") % 7 != 0, F.col("country")).alias("country"))
    return metrics.fractional(rows, "paper", "country").withColumn("frac", F.round("frac", 6))


@query(
    "fractional_institutes",
    f"""WITH {SLOTS}, w AS (SELECT author, part, 1.0::DOUBLE / count(*) OVER (PARTITION BY paper) AS w FROM slots),
      d AS (SELECT author, w, CASE WHEN part % 5 = 0 THEN ['Unclassified'] ELSE string_split(p_type, ' ') END AS ds FROM w JOIN part ON part = p_partkey),
      e AS (SELECT author, w / len(ds) AS w, unnest(ds) AS part FROM d)
    SELECT author, part, round(sum(w), 6) AS frac FROM e GROUP BY 1, 2""",
)
def fractional_institutes(t: Tables) -> DataFrame:
    parts = F.when(F.col("p_partkey") % 5 != 0, F.split("p_type", " ")).otherwise(F.array().cast("array<string>"))
    rows = slots(t).join(t.part.select("p_partkey", parts.alias("divisions")), F.col("part") == F.col("p_partkey")).select("paper", "author", "divisions")
    return metrics.fractional_split(rows, "paper", "author", "divisions").withColumn("frac", F.round("frac", 6))


@query(
    "fractional_country_topic",
    f"""WITH {SLOTS}, p AS (SELECT paper, list(DISTINCT country) AS cs FROM slots GROUP BY 1),
      c AS (SELECT unnest(cs) AS r, o_orderpriority AS c, 1.0::DOUBLE / len(cs) AS w FROM p JOIN orders ON paper = o_orderkey), m AS (SELECT r, c, sum(w) AS w FROM c GROUP BY 1, 2)
    SELECT r, c, round(w, 6) AS w FROM m WHERE r IN (SELECT r FROM m GROUP BY 1 ORDER BY round(sum(w), 6) DESC, r LIMIT 3)
      AND c IN (SELECT c FROM (SELECT * FROM m WHERE r IN (SELECT r FROM m GROUP BY 1 ORDER BY round(sum(w), 6) DESC, r LIMIT 3)) GROUP BY 1 ORDER BY round(sum(w), 6) DESC, c LIMIT 3)""",
)
def fractional_country_topic(t: Tables) -> DataFrame:
    papers = slots(t).groupBy("paper").agg(F.array_sort(F.collect_set("country")).alias("countries"))
    rows = papers.join(t.orders.select(F.col("o_orderkey").alias("paper"), "o_orderpriority"), "paper")
    return metrics.fractional_matrix(rows, "countries", "o_orderpriority", 3).select("r", "c", F.round("w", 6).alias("w"))


@query(
    "pivot_year_status",
    """SELECT year(o_orderdate)::INT AS year, count_if(o_orderstatus = 'F')::BIGINT AS "F", count_if(o_orderstatus = 'O')::BIGINT AS "O", count_if(o_orderstatus = 'P')::BIGINT AS "P",
      count_if(o_orderstatus = 'Z')::BIGINT AS "Z" FROM orders GROUP BY 1""",
)
def pivot_year_status(t: Tables) -> DataFrame:
    return metrics.pivoted(t.orders.withColumn("year", F.year("o_orderdate")), "year", "o_orderstatus", ["F", "O", "P", "Z"])


@query(
    "status_year_pct",
    """SELECT year(o_orderdate)::INT AS year, o_orderstatus, count(*) AS n, sum(count(*)) OVER (PARTITION BY year(o_orderdate))::BIGINT AS total,
      round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY year(o_orderdate)), 6) AS pct FROM orders GROUP BY year(o_orderdate), o_orderstatus""",
)
def status_year_pct(t: Tables) -> DataFrame:
    return metrics.shares(t.orders.withColumn("year", F.year("o_orderdate")), ["year"], "o_orderstatus").withColumn("pct", F.round("pct", 6))


@query(
    "column_share_heatmap",
    """WITH c AS (SELECT o_orderpriority AS macro, o_custkey % 20 AS category, count(*) AS n FROM orders GROUP BY 1, 2),
      s AS (SELECT DISTINCT category FROM (SELECT *, row_number() OVER (PARTITION BY macro ORDER BY n DESC, category) AS k FROM c) WHERE k <= 4)
    SELECT macro, category, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY category), 6) AS share,
      first_value(macro) OVER (PARTITION BY category ORDER BY n DESC, macro DESC) AS main FROM c WHERE category IN (SELECT category FROM s)""",
)
def column_share_heatmap(t: Tables) -> DataFrame:
    from scholia.operators.hierarchy import macro_heatmap

    rows = t.orders.select(F.col("o_orderpriority").alias("macro"), (F.col("o_custkey") % 20).alias("category"))
    return macro_heatmap(rows, "macro", "category", 4).withColumn("share", F.round("share", 6))


@query(
    "share_of_group",
    """SELECT user_id % 10 AS panel, event_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY user_id % 10)::BIGINT AS total,
      round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY user_id % 10), 6) AS pct FROM events GROUP BY user_id % 10, event_type""",
)
def share_of_group(t: Tables) -> DataFrame:
    return metrics.shares(t.events.withColumn("panel", F.col("user_id") % 10), ["panel"], "event_type").withColumn("pct", F.round("pct", 6))


@query(
    "open_access_rate",
    """SELECT year(o_orderdate)::INT AS year, count(*) AS n, count_if(o_orderkey % 4 IN (0, 1))::BIGINT AS open_n,
      round(count_if(o_orderkey % 4 IN (0, 1))::DOUBLE / count(*), 6) AS open_share FROM orders GROUP BY 1""",
)
def open_access_rate(t: Tables) -> DataFrame:
    kinds = (
        F.when(F.col("o_orderkey") % 4 == 0, F.array(F.lit("Gold"), F.lit("OA_all"))).when(F.col("o_orderkey") % 4 == 1, F.array(F.lit("green"))).when(F.col("o_orderkey") % 4 == 2, F.array(F.lit("Closed")))
    )
    rows = t.orders.select(F.year("o_orderdate").alias("year"), metrics.open_access_of(kinds).alias("open"))
    return rows.groupBy("year").agg(F.count("*").alias("n"), F.count_if("open").alias("open_n")).withColumn("open_share", F.round(F.col("open_n") / F.col("n"), 6))


@query(
    "female_share",
    """WITH g AS (SELECT year(o_orderdate)::INT AS year, CASE o_custkey % 5 WHEN 0 THEN 'female' WHEN 1 THEN 'female' WHEN 2 THEN 'male' WHEN 3 THEN 'male' ELSE 'unknown' END AS g FROM orders)
    SELECT year, round(count_if(g = 'female')::DOUBLE / count(*), 6) AS of_all, round(count_if(g = 'female')::DOUBLE / count_if(g <> 'unknown'), 6) AS of_known FROM g GROUP BY 1""",
)
def female_share(t: Tables) -> DataFrame:
    gender = F.when(F.col("o_custkey") % 5 <= 1, "female").when(F.col("o_custkey") % 5 <= 3, "male").otherwise("unknown")
    rows = t.orders.select(F.year("o_orderdate").alias("year"), gender.alias("gender"))
    return rows.groupBy("year").agg(
        F.round(metrics.female_share("gender", False), 6).alias("of_all"), F.round(metrics.female_share("gender", True), 6).alias("of_known")
    )


@query(
    "gender_lookup",
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'female' WHEN 1 THEN 'male' WHEN 2 THEN 'female' ELSE 'unknown' END AS gender,
      CASE WHEN c_custkey % 4 IN (0, 1) THEN 'dictionary' WHEN c_custkey % 4 = 2 THEN 'statistic' ELSE 'none' END AS gender_source FROM customer""",
)
def gender_lookup(t: Tables) -> DataFrame:
    from scholia.functions.entity import with_gender

    names = t.spark.sql("select * from values ('Ada','mostly_female',100,0.9D),('Ben','male',9,0.1D),('Kim','andy',50,0.85D),('Sam','andy',10,0.9D) t(name, gender, n, p_female)")
    first = F.element_at(F.array(*map(F.lit, ["Ada B", "Ben-Jo", "kim", "Sam"])), (F.col("c_custkey") % 4 + 1).cast("int"))
    rows = t.customer.select("c_custkey", first.alias("first_name"))
    return with_gender(rows, names).select("c_custkey", "gender", "gender_source")


RATERS = """v AS (SELECT d.doc_id, n_chars, quality::INT AS a, toxic::INT AS b, CASE WHEN n_chars % 5 = 0 THEN NULL WHEN n_chars > 1000 THEN 1 ELSE 0 END AS c
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) USING (doc_id))"""


def rated(t: Tables) -> DataFrame:
    labels = t.labels.groupBy("doc_id").agg(F.max("quality").cast("int").alias("a"), F.max("toxic").cast("int").alias("b"))
    third = F.when(F.col("n_chars") % 5 == 0, None).when(F.col("n_chars") > 1000, 1).otherwise(0)
    return t.documents.join(labels, "doc_id", "left").select("doc_id", "n_chars", "a", "b", third.alias("c"))


_COUNT = "(coalesce({0} = 1, false)::INT + coalesce({1} = 1, false)::INT + coalesce({2} = 1, false)::INT)"
VOTES = f"""{RATERS}, n AS (SELECT *, ((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT) AS p, {_COUNT.format('a', 'b', 'c')} AS t,
    {_COUNT.format('1 - a', '1 - b', '1 - c')} AS f FROM v), g AS (SELECT *, CASE WHEN t = 3 THEN 'all_true' WHEN f = 3 THEN 'all_false' WHEN t = 2 THEN '2_true' WHEN t = 1 THEN '1_true'
    WHEN p > 0 THEN 'none_true' ELSE 'unparsed' END AS consensus_group,
    'a=' || coalesce(CASE a WHEN 1 THEN 'T' ELSE 'F' END, 'NA') || ' | b=' || coalesce(CASE b WHEN 1 THEN 'T' ELSE 'F' END, 'NA') AS sig FROM n)"""


@query(
    "consensus_votes",
    f"""WITH {VOTES} SELECT doc_id, p AS n_models_parsed, t AS n_true_votes, f AS n_false_votes, consensus_group,
      'a=' || CASE WHEN a = 1 THEN 'T' WHEN a = 0 THEN 'F' ELSE 'NA' END || ' | b=' || CASE WHEN b = 1 THEN 'T' WHEN b = 0 THEN 'F' ELSE 'NA' END || ' | c=' ||
      CASE WHEN c = 1 THEN 'T' WHEN c = 0 THEN 'F' ELSE 'NA' END AS vote_signature FROM g""",
)
def consensus_votes(t: Tables) -> DataFrame:
    return metrics.voted(rated(t), ["a", "b", "c"]).select("doc_id", "n_models_parsed", "n_true_votes", "n_false_votes", "consensus_group", "vote_signature")


@query(
    "pairwise_agreement",
    f"""WITH {RATERS}, p AS (SELECT 'a' AS rater_a, 'b' AS rater_b, a = b AS same FROM v UNION ALL SELECT 'a', 'c', a = c FROM v UNION ALL SELECT 'b', 'c', b = c FROM v)
    SELECT rater_a, rater_b, count(*) AS n, round(100.0::DOUBLE * avg(same::INT), 4) AS agree_pct FROM p WHERE same IS NOT NULL GROUP BY 1, 2""",
)
def pairwise_agreement(t: Tables) -> DataFrame:
    return metrics.pairwise_agreement(rated(t), ["a", "b", "c"])


@query(
    "yearly_trend",
    f"""WITH {VOTES} SELECT (1990 + n_chars % 20)::INT AS year, count(*) AS n, count_if(t = 3)::BIGINT AS agree_true, round(100.0::DOUBLE * count_if(t = 3) / greatest(count(*), 1), 4) AS pct
    FROM g GROUP BY 1""",
)
def yearly_trend(t: Tables) -> DataFrame:
    rows = metrics.voted(rated(t), ["a", "b", "c"]).withColumn("year", (1990 + F.col("n_chars") % 20).cast("int"))
    return rows.groupBy("year").agg(F.count("*").alias("n"), F.count_if("all_agree_true").alias("agree_true")).withColumn(
        "pct", F.round(100.0 * F.col("agree_true") / F.greatest("n", F.lit(1)), 4)
    )


@query("vote_distribution", f"WITH {VOTES} SELECT consensus_group, t AS n_true_votes, count(*) AS n FROM g GROUP BY 1, 2")
def vote_distribution(t: Tables) -> DataFrame:
    return metrics.voted(rated(t), ["a", "b", "c"]).groupBy("consensus_group", "n_true_votes").agg(F.count("*").alias("n"))


@query(
    "best_metadata",
    """WITH m AS (SELECT o_custkey AS id, o_orderpriority AS title, o_orderstatus AS abstract, CASE WHEN o_orderkey % 2 = 0 THEN year(o_orderdate)::INT END AS year FROM orders)
    SELECT id, title, abstract, year FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY length(title) + length(abstract) + CASE WHEN year IS NOT NULL THEN 100 ELSE 0 END DESC,
      year DESC NULLS LAST, title, abstract) = 1""",
)
def best_metadata(t: Tables) -> DataFrame:
    year = F.when(F.col("o_orderkey") % 2 == 0, F.year("o_orderdate"))
    return metrics.best_metadata(t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("abstract"), year.alias("year")))


@query(
    "quality_report",
    """SELECT unnest(['rows', 'blank', 'long', 'english']) AS metric, unnest([count(*), count_if(trim(text) = ''), count_if(n_chars > 2000), count_if(lang = 'en')]::BIGINT[]) AS value FROM documents""",
)
def quality_report(t: Tables) -> DataFrame:
    return metrics.quality_report(t.documents, {"blank": F.trim("text") == "", "long": F.col("n_chars") > 2000, "english": F.col("lang") == "en"})


@query(
    "topic_year_share",
    """WITH p AS (SELECT label AS topic, (vec_id % 6 + 2015)::INT AS year FROM embeddings WHERE label <> 9)
    SELECT year, topic, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY year), 6) AS share FROM p GROUP BY 1, 2""",
)
def topic_year_share(t: Tables) -> DataFrame:
    from scholia.operators.topics import shares_by_year

    return shares_by_year(_placed(t)).select("year", "topic", "n", F.round("share", 6).alias("share"))


def _placed(t: Tables) -> DataFrame:
    topic = F.when(F.col("label") == 9, -1).otherwise(F.col("label")).cast("int")
    return t.embeddings.select("vec_id", topic.alias("topic"), (F.col("vec_id") % 6 + 2015).cast("int").alias("year"))


@query(
    "topic_growth",
    """WITH p AS (SELECT label AS topic, (vec_id % 6 + 2015)::INT AS year FROM embeddings WHERE label <> 9),
      s AS (SELECT year, topic, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY year) AS share FROM p GROUP BY 1, 2)
    SELECT topic, min(year) AS first_year, max(year) AS last_year, round(arg_min(share, year), 6) AS first_share, round(arg_max(share, year), 6) AS last_share,
      round(regr_slope(share, year), 8) AS share_slope, round((arg_max(share, year) + 1e-6) / (arg_min(share, year) + 1e-6), 5) AS growth_ratio FROM s GROUP BY 1""",
)
def topic_growth(t: Tables) -> DataFrame:
    from scholia.operators.topics import shares_by_year

    made = metrics.topic_growth(shares_by_year(_placed(t)))
    r = {"first_share": 6, "last_share": 6, "share_slope": 8, "growth_ratio": 5}
    return made.withColumns({c: F.round(c, n) for c, n in r.items()})


@query(
    "event_sessions",
    """WITH g AS (SELECT user_id, ts, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER w > 21600000000)::INT, 1) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts)::BIGINT AS session FROM g)
    SELECT user_id, session, count(*) AS events, min(ts) AS started, max(ts) AS ended FROM s GROUP BY 1, 2""",
)
def event_sessions(t: Tables) -> DataFrame:
    return windows.sessions(t.events, "user_id", "ts", 360)


@query(
    "smoothed_series",
    f"""WITH {YEARS}, c AS (SELECT nation, year, count(*)::DOUBLE AS n FROM y GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY year) - 1 AS i, count(*) OVER (PARTITION BY nation) AS m FROM c),
      w AS (SELECT d, exp(-0.5 * d * d) / (SELECT sum(exp(-0.5 * e * e)) FROM range(-4, 5) r(e)) AS w FROM range(-4, 5) r(d)),
      x AS (SELECT nation, year, n, m, w, ((i + d) % (2 * m) + 2 * m) % (2 * m) AS t FROM k, w), z AS (SELECT nation, year, n, m, w, CASE WHEN t < m THEN t ELSE 2 * m - 1 - t END AS j FROM x)
    SELECT z.nation, z.year, z.n, round(CASE WHEN max(z.m) >= 3 THEN sum(w * k.n) ELSE z.n END, 6) AS smooth FROM z JOIN k ON k.nation = z.nation AND k.i = z.j GROUP BY 1, 2, 3""",
)
def smoothed_series(t: Tables) -> DataFrame:
    counted = yearly(t).groupBy("nation", "year").agg(F.count("*").cast("double").alias("n"))
    return windows.smoothed(counted, ["nation"], "year", "n").withColumn("smooth", F.round("smooth", 6))


@query(
    "right_closed_bins",
    """SELECT o_orderkey, CASE WHEN p > 0 AND p <= 99 THEN '(0,99]' WHEN p > 99 AND p <= 199 THEN '(99,199]' WHEN p > 199 AND p <= 299 THEN '(199,299]' WHEN p > 299 THEN '>299' END AS bin
    FROM (SELECT o_orderkey, round(o_totalprice / 1000) AS p FROM orders)""",
)
def right_closed_bins(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.round(F.col("o_totalprice") / 1000).alias("p"))
    return rows.select("o_orderkey", windows.right_closed_bin("p", [0, 99, 199, 299]).alias("bin"))


@query(
    "min_max_scaled",
    "SELECT c_custkey, round(8 + (c_acctbal - min(c_acctbal) OVER ()) * 32 / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 6) AS size FROM customer",
)
def min_max_scaled(t: Tables) -> DataFrame:
    made = windows.scaled(t.customer, "c_acctbal", 8, 40, "size")
    return made.select("c_custkey", F.round("size", 6).alias("size"))


@query(
    "seen_before",
    "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) > 1 AS seen_before FROM events",
)
def seen_before(t: Tables) -> DataFrame:
    rows = t.events.withColumn("key", F.concat_ws("|", F.col("user_id").cast("string"), "event_type"))
    return windows.seen_before(rows, "key", ["ts", "event_id"]).select("event_id", "seen_before")


@query(
    "positional_slice",
    "SELECT day, n FROM (SELECT o_orderdate::DATE AS day, count(*) AS n, row_number() OVER (ORDER BY o_orderdate::DATE) AS k, count(*) OVER () AS m FROM orders GROUP BY 1) WHERE k > 138 AND k <= m - 180",
)
def positional_slice(t: Tables) -> DataFrame:
    daily = t.orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return columns.positions(daily, ["day"], 138, -180)
