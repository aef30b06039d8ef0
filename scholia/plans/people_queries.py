"""Queries of authors, places, lookups and remaining roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.operators import graph, people, windows
from scholia.plans.graph_queries import LISTED, PARTITION, listed, partition
from scholia.plans.metric_queries import SLOTS, slots
from scholia.plans.registry import Registry, Tables

REGISTRY = Registry()
query = REGISTRY.query


@query(
    "author_long_table",
    """SELECT o_orderkey AS paper_id, 'name::' || lower(a) || '|x' AS author_id, a || ' X' AS full_name, CASE WHEN a = 'B' THEN 'g2' ELSE 'g1' END AS org_grid,
      CASE WHEN a = 'B' THEN 'current' ELSE 'first' END AS aff_source FROM orders, (SELECT unnest(['A', 'B']) AS a)""",
)
def author_long_table(t: Tables) -> DataFrame:
    aff = F.array(*[F.struct(F.lit(g).alias("id"), F.lit(g.upper()).alias("name"), F.lit("UK").alias("country"), F.lit("GB").alias("country_code")) for g in ("g1", "g2")])
    author = lambda name, current: F.struct(
        F.lit("").alias("researcher_id"), F.lit(name).alias("first_name"), F.lit("X").alias("last_name"), F.lit(True).alias("corresponding"),
        F.lit(current).alias("current_organization_id"), aff.alias("affiliations"),
    )
    pubs = t.orders.select(
        F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("times_cited"), F.array(author("A", "g9"), author("B", "g2"), author("A", "g9")).alias("authors")
    )
    return people.author_papers(pubs).select("paper_id", "author_id", "full_name", "org_grid", "aff_source")


@query(
    "lookup_harvest",
    """WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2), m AS (SELECT p_brand, p_type AS common FROM c QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) = 1)
    SELECT p_brand, max(common) AS common, arg_min(p_type, p_partkey) AS first, arg_max(p_type, p_partkey) AS last FROM part JOIN m USING (p_brand) GROUP BY 1""",
)
def lookup_harvest(t: Tables) -> DataFrame:
    out = people.lookup(t.part, "p_brand", ["p_type"]).withColumnRenamed("p_type", "common")
    for keep in ("first", "last"):
        out = out.join(people.lookup(t.part, "p_brand", ["p_type"], keep, "p_partkey").withColumnRenamed("p_type", keep), "p_brand")
    return out


@query(
    "paper_fields",
    """WITH c AS (SELECT l_orderkey AS paper, CASE WHEN l_partkey % 3 = 0 THEN lpad((l_partkey % 40)::VARCHAR, 2, '0') ELSE lpad((l_partkey % 4000)::VARCHAR, 4, '0') END AS c FROM lineitem)
    SELECT paper, array_to_string(list_sort(list(DISTINCT left(c, 2))), ',') AS for_l2, coalesce(array_to_string(list_sort(list(DISTINCT c) FILTER (WHERE length(c) = 4)), ','), '') AS for_l4 FROM c GROUP BY 1""",
)
def paper_fields(t: Tables) -> DataFrame:
    code = F.when(F.col("l_partkey") % 3 == 0, F.lpad((F.col("l_partkey") % 40).cast("string"), 2, "0")).otherwise(F.lpad((F.col("l_partkey") % 4000).cast("string"), 4, "0"))
    rows = t.lineitem.select(F.col("l_orderkey").alias("paper"), code.alias("c"))
    made = people.paper_fields(rows, "paper", "c", "c")
    return made.select("paper", F.array_join("for_l2", ",").alias("for_l2"), F.array_join("for_l4", ",").alias("for_l4"))


@query(
    "author_summary",
    f"""WITH {SLOTS}, s AS (SELECT author, paper, cites, year(o_orderdate)::INT AS y, o_orderpriority AS f, country, CASE WHEN author % 3 = 0 THEN part % 5 END AS cur FROM slots JOIN orders ON paper = o_orderkey),
      o AS (SELECT author, paper, max(cites) AS c, min(y) AS y FROM s GROUP BY 1, 2), b AS (SELECT author, count(*) AS papers, sum(c)::DOUBLE AS citations, min(y) AS first_year, max(y) AS last_year FROM o GROUP BY 1),
      f AS (SELECT author, f FROM s GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY author ORDER BY count(*) DESC, f) = 1),
      h AS (SELECT author, cur FROM s WHERE cur IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY author ORDER BY count(*) DESC, cur) = 1),
      g AS (SELECT author, country FROM s GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY author ORDER BY count(*) DESC, country) = 1)
    SELECT b.*, f.f AS modal_field, coalesce(h.cur, g.country)::BIGINT AS home FROM b JOIN f USING (author) JOIN g USING (author) LEFT JOIN h USING (author)""",
)
def author_summary(t: Tables) -> DataFrame:
    rows = slots(t).join(t.orders.select(F.col("o_orderkey").alias("paper"), F.year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("f")), "paper")
    rows = rows.withColumn("cur", F.when(F.col("author") % 3 == 0, F.col("part") % 5)).withColumn("country", F.col("country").cast("long"))
    return people.author_summary(rows, "author", "paper", "cites", "y", "f", "country", "cur")


@query(
    "country_papers",
    f"WITH {SLOTS} SELECT country, count(DISTINCT paper) AS papers FROM slots GROUP BY 1",
)
def country_papers(t: Tables) -> DataFrame:
    return people.country_papers(slots(t).groupBy("paper").agg(F.collect_list("country").alias("cs")), "paper", "cs")


@query("country_counts", f"WITH {SLOTS} SELECT country, count(*) AS n FROM slots GROUP BY 1")
def country_counts(t: Tables) -> DataFrame:
    return people.country_counts(slots(t).groupBy("paper").agg(F.collect_list("country").alias("cs")), "cs")


@query(
    "dominant_topic",
    f"""WITH {SLOTS}, s AS (SELECT country, o_orderpriority AS topic, sum(cites)::DOUBLE AS w FROM slots JOIN orders ON paper = o_orderkey GROUP BY 1, 2)
    SELECT country, topic AS dominant, w AS weight FROM s QUALIFY row_number() OVER (PARTITION BY country ORDER BY w DESC, topic) = 1""",
)
def dominant_topic(t: Tables) -> DataFrame:
    rows = slots(t).join(t.orders.select(F.col("o_orderkey").alias("paper"), F.col("o_orderpriority").alias("topic")), "paper")
    return people.dominant(rows, "country", "topic", "cites")


@query(
    "home_and_others",
    """SELECT year(o_orderdate)::INT AS year, round(sum(CASE WHEN c_nationkey = 3 THEN 0.5 ELSE 0 END)::DOUBLE, 6) AS home, round(sum(CASE WHEN c_nationkey = 3 THEN 0 ELSE 0.5 END)::DOUBLE, 6) AS others
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
)
def home_and_others(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.year("o_orderdate").alias("year"), F.col("c_nationkey").cast("string").alias("c"))
    return people.home_and_others(rows, "year", "c", "3", F.lit(0.5))


@query(
    "mentions_summary",
    """WITH p AS (SELECT lower(trim(o_orderpriority || (o_custkey % 200))) AS doi, o_orderstatus AS grp FROM orders QUALIFY row_number() OVER (PARTITION BY doi ORDER BY o_totalprice DESC) = 1),
      a AS (SELECT lower(trim(' ' || upper(o_orderpriority) || (o_custkey % 300) || ' ')) AS doi, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 7 END AS news FROM orders)
    SELECT grp, count(*) AS n, sum(coalesce(news, 0))::BIGINT AS news FROM a LEFT JOIN p ON p.doi = a.doi GROUP BY 1""",
)
def mentions_summary(t: Tables) -> DataFrame:
    pubs = t.orders.select(F.concat("o_orderpriority", (F.col("o_custkey") % 200).cast("string")).alias("doi"), F.col("o_orderstatus").alias("grp"), F.col("o_totalprice").alias("times_cited"))
    said = F.concat(F.lit(" "), F.upper("o_orderpriority"), (F.col("o_custkey") % 300).cast("string"), F.lit(" "))
    alt = t.orders.select(said.alias("doi"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") % 7).alias("news"))
    return people.mentions(alt, pubs, "doi", ["news"], "grp")


@query(
    "community_examples",
    f"""WITH {LISTED}, {PARTITION}, c AS (SELECT item AS node, count(*) AS n FROM li GROUP BY 1), o AS (SELECT community, node FROM pt JOIN c USING (node) QUALIFY row_number() OVER (PARTITION BY community ORDER BY n DESC, node) <= 5),
      f AS (SELECT item AS node, g FROM li QUALIFY row_number() OVER (PARTITION BY item ORDER BY g) <= 5)
    SELECT community, array_to_string(list_sort(list(DISTINCT g))[1:20], ',') AS examples FROM o JOIN f USING (node) GROUP BY 1""",
)
def community_examples(t: Tables) -> DataFrame:
    rows = listed(t)
    made = graph.community_examples(partition(t), graph.item_counts(rows, "g", "item"), rows, "g", "item")
    return made.select("community", F.array_join("examples", ",").alias("examples"))


@query(
    "smoothed_years",
    """WITH c AS (SELECT o_orderpriority AS grp, year(o_orderdate)::INT AS year, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY year) - 1 AS i, count(*) OVER (PARTITION BY grp) AS m FROM c),
      w AS (SELECT d, exp(-0.5 * d * d) / (SELECT sum(exp(-0.5 * e * e)) FROM range(-4, 5) r(e)) AS w FROM range(-4, 5) r(d)),
      x AS (SELECT grp, year, m, w, ((i + d) % (2 * m) + 2 * m) % (2 * m) AS t FROM k, w), y AS (SELECT grp, year, w, CASE WHEN t < m THEN t ELSE 2 * m - 1 - t END AS j FROM x)
    SELECT y.grp, y.year, round(sum(w * k.n), 6) AS smooth FROM y JOIN k ON k.grp = y.grp AND k.i = y.j GROUP BY 1, 2""",
)
def smoothed_years(t: Tables) -> DataFrame:
    counted = t.orders.groupBy(F.col("o_orderpriority").alias("grp"), F.year("o_orderdate").alias("year")).agg(F.count("*").cast("double").alias("n"))
    return windows.smoothed(counted, ["grp"], "year", "n").select("grp", "year", F.round("smooth", 6).alias("smooth"))
