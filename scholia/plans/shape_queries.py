"""Queries of scans, column shapes, filters, rankings and small text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.functions import entity, parsing, text
from scholia.operators import columns, inference, metrics, people, textmine
from scholia.plans.registry import Registry, Tables
from scholia.sources import files

REGISTRY = Registry()
query = REGISTRY.query


@query("parquet_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000")
def parquet_scan(t: Tables) -> DataFrame:
    return files.read_parquet(t.spark, f"{t.folder}/orders.parquet", ["o_orderkey", "o_totalprice"], "o_orderstatus = 'F' and o_totalprice > 1000")


@query("shaped_columns", "SELECT c_custkey, c_nationkey::VARCHAR AS c_nationkey, NULL::VARCHAR AS note, c_name AS label FROM customer")
def shaped_columns(t: Tables) -> DataFrame:
    rows = columns.with_missing(columns.as_strings(t.customer, ["c_nationkey"]), {"note": "string", "c_name": "string"})
    name = columns.first_existing(rows.columns, ["full_name", "c_name", "c_mktsegment"])
    return rows.select("c_custkey", "c_nationkey", "note", F.col(name).alias("label"))


@query(
    "year_window",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y%m') AS stamp, CASE WHEN o_totalprice > 200000 THEN 'large' ELSE 'small' END AS size FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1997",
)
def year_window(t: Tables) -> DataFrame:
    kept = columns.within_years(t.orders.withColumn("year", F.year("o_orderdate")), "year", 1996, 1997)
    return kept.select("o_orderkey", columns.year_month("o_orderdate").alias("stamp"), columns.split_label(F.col("o_totalprice") > 200000, "large", "small").alias("size"))


@query(
    "positive_measures",
    "SELECT s_suppkey, c_custkey, round(2 * sqrt(c_acctbal), 6) AS marker, round(ln(1 + s_acctbal), 6) AS damped FROM supplier JOIN customer ON s_suppkey = c_custkey WHERE s_acctbal > 0 AND c_acctbal > 0",
)
def positive_measures(t: Tables) -> DataFrame:
    both = t.supplier.join(t.customer, F.col("s_suppkey") == F.col("c_custkey"))
    return columns.positive(both, "s_acctbal", "c_acctbal").select(
        "s_suppkey", "c_custkey", F.round(columns.marker_size("c_acctbal", 2.0), 6).alias("marker"), F.round(columns.damped("s_acctbal"), 6).alias("damped")
    )


@query(
    "head_tail_ranking",
    """WITH c AS (SELECT l_partkey AS part, count(*) AS n FROM lineitem GROUP BY 1)
    (SELECT part, n, 'head' AS side FROM c ORDER BY n DESC, part LIMIT 25) UNION ALL (SELECT part, n, 'tail' FROM c ORDER BY n, part DESC LIMIT 25)""",
)
def head_tail_ranking(t: Tables) -> DataFrame:
    counted = t.lineitem.groupBy(F.col("l_partkey").alias("part")).agg(F.count("*").alias("n"))
    return metrics.head_and_tail(counted, [F.desc("n"), F.asc("part")], [F.asc("n"), F.desc("part")], 25)


@query(
    "most_common_first_seen",
    "SELECT p_type || '/' || p_size AS kind, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, min(p_partkey) LIMIT 12",
)
def most_common_first_seen(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", F.concat_ws("/", "p_type", F.col("p_size").cast("string")).alias("kind"))
    return metrics.most_common(rows, "kind", "p_partkey", 12)


@query(
    "list_pairs",
    """WITH d AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(lang || ' ' || source || ' ' || source), '[a-z0-9]+'))) AS w FROM documents)
    SELECT doc_id, w[i] || '-' || w[j] AS pair FROM d, range(1, 5) a(i), range(1, 5) b(j) WHERE i < j AND j <= len(w)""",
)
def list_pairs(t: Tables) -> DataFrame:
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", "lang", "source", "source")), F.lit("[a-z0-9]+"), F.lit(0))
    return t.documents.select("doc_id", F.inline(columns.array_pairs(words))).select("doc_id", F.concat_ws("-", "a", "b").alias("pair"))


_SHARES = """b AS (SELECT c_nationkey AS nation, c_custkey AS person, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS seg FROM customer),
  c AS (SELECT nation, coalesce(seg, 'Unclassified') AS seg, count(DISTINCT person) AS n FROM b GROUP BY 1, 2), g AS (SELECT nation, count(DISTINCT person) AS group_n FROM b GROUP BY 1)
  SELECT nation, seg, n, group_n, round(n::DOUBLE / group_n, 6) AS share, row_number() OVER (PARTITION BY nation ORDER BY {order}) AS rank FROM c JOIN g USING (nation)"""


def _shares(t: Tables, last: bool) -> DataFrame:
    rows = t.customer.select(
        F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("person"), F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("seg")
    )
    made = metrics.value_shares(rows, "nation", "person", "seg", "Unclassified", last)
    return made.select("nation", "seg", "n", "group_n", F.round("share", 6).alias("share"), F.col("rank").cast("long").alias("rank"))


@query("value_shares", "WITH " + _SHARES.format(order="n DESC, (seg = 'Unclassified')::INT, seg"))
def value_shares(t: Tables) -> DataFrame:
    return _shares(t, last=False)


@query("value_shares_unknown_last", "WITH " + _SHARES.format(order="(seg = 'Unclassified')::INT, n DESC, seg"))
def value_shares_unknown_last(t: Tables) -> DataFrame:
    return _shares(t, last=True)


@query(
    "folded_matrix",
    """WITH x AS (SELECT c_nationkey AS nation, c_mktsegment AS seg, round(c_acctbal * 100)::BIGINT AS w FROM customer),
      t AS (SELECT seg, row_number() OVER (ORDER BY sum(w) DESC, seg) AS k FROM x GROUP BY 1),
      f AS (SELECT nation, CASE WHEN k <= 2 THEN k ELSE 3 END AS k, w FROM x JOIN t USING (seg))
    SELECT nation, sum(CASE WHEN k = 1 THEN w ELSE 0 END)::BIGINT AS first, sum(CASE WHEN k = 2 THEN w ELSE 0 END)::BIGINT AS second, sum(CASE WHEN k = 3 THEN w ELSE 0 END)::BIGINT AS other FROM f GROUP BY 1""",
)
def folded_matrix(t: Tables) -> DataFrame:
    rows = t.customer.select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("seg"), F.round(F.col("c_acctbal") * 100).cast("long").alias("w"))
    made = metrics.folded_matrix(rows, "nation", "seg", "w", 2)
    return made.toDF("nation", "first", "second", "other")


@query(
    "patch_read_back",
    """SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k, 0::BIGINT AS bad_fields, 0::BIGINT AS list_fields FROM events""",
)
def patch_read_back(t: Tables) -> DataFrame:
    good, bad, listed = (parsing.patch_of(c) for c in ("props", F.concat(F.lit("{'"), "props"), F.concat(F.lit("["), "props", F.lit("]"))))
    return t.events.select(
        "event_id", F.coalesce(F.try_element_at(good, F.lit("k")), F.lit("")).alias("k"),
        F.size(bad).cast("long").alias("bad_fields"), F.size(listed).cast("long").alias("list_fields"),
    )


@query(
    "text_shapes",
    r"""SELECT conv_id, turn, left(coalesce(text, ''), 40) AS short, trim(role) || chr(10) || trim(text) AS analysis, 'Turn ' || turn || ' by ' || role || ': ' || text AS prompt FROM conversations""",
)
def text_shapes(t: Tables) -> DataFrame:
    return t.conversations.select(
        "conv_id", "turn", text.shortened("text", 40).alias("short"), text.analysis_text("role", "text").alias("analysis"),
        text.prompt("Turn %s by %s: %s", "turn", "role", "text").alias("prompt"),
    )


@query(
    "spellings",
    r"""WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '\p{L}+')) AS x, generate_subscripts(regexp_extract_all(text, '\p{L}+'), 1) AS i FROM conversations WHERE turn = 0),
      f AS (SELECT conv_id, turn, lower(x) AS l, arg_min(x, i) AS x, min(i) AS i FROM w GROUP BY 1, 2, 3)
    SELECT conv_id, turn, string_agg(x, ' ' ORDER BY i) AS words FROM f GROUP BY 1, 2""",
)
def spellings(t: Tables) -> DataFrame:
    words = F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))
    first = t.conversations.where("turn = 0").select("conv_id", "turn", F.array_join(text.distinct_ignoring_case(words), " ").alias("words"))
    return first.where("words <> ''")


@query(
    "share_labels",
    """WITH c AS (SELECT c_nationkey AS nation, c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY 1, 2), s AS (SELECT *, sum(n) OVER (PARTITION BY nation) AS m FROM c)
    SELECT nation, string_agg(seg || ' (' || round_even(n * 100 / m::DECIMAL(18, 6), 0)::INT || '%)', '; ' ORDER BY n DESC, seg) AS label FROM s GROUP BY 1""",
)
def share_labels(t: Tables) -> DataFrame:
    found = metrics.shares(t.customer, ["c_nationkey"], "c_mktsegment")
    order = F.struct(-F.col("n"), "c_mktsegment")
    return found.groupBy(F.col("c_nationkey").alias("nation")).agg(text.share_label(F.col("c_mktsegment"), F.bround("pct"), order).alias("label"))


@query(
    "kept_terms",
    r"""WITH x AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents)
    SELECT term, count(*) AS n FROM x WHERE NOT regexp_matches(term, '[0-9]') AND (length(term) >= 3 OR term IN ('uk', 'in')) AND term NOT IN ('the', 'and') GROUP BY 1""",
)
def kept_terms(t: Tables) -> DataFrame:
    terms = t.documents.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("term"))
    return terms.where(textmine.kept_token(F.col("term"), ["the", "and"], ["uk", "in"])).groupBy("term").agg(F.count("*").alias("n"))


@query(
    "resumed_results",
    "SELECT doc_id, coalesce(quality, -1)::INT AS quality, source FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id)",
)
def resumed_results(t: Tables) -> DataFrame:
    done = t.labels.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    return inference.with_checkpoint(t.documents.select("doc_id", "source"), done, "doc_id", {"quality": -1})


@query(
    "fast_fields",
    """WITH y AS (SELECT o_orderpriority || o_orderstatus AS field, year(o_orderdate) AS year, o_totalprice AS v FROM orders), b AS (SELECT field, count_if(year = 1996) AS a, count_if(year = 1997) AS z, max(v) AS top FROM y GROUP BY 1)
    SELECT field, a::BIGINT AS n_base, z::BIGINT AS n_last, round(100.0::DOUBLE * (z - a) / a, 6) AS growth_pct, top FROM b WHERE a > 0 ORDER BY 100.0::DOUBLE * (z - a) / a DESC, field LIMIT 10""",
)
def fast_fields(t: Tables) -> DataFrame:
    rows = t.orders.select(F.concat("o_orderpriority", "o_orderstatus").alias("field"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("v"))
    top = rows.groupBy("field").agg(F.max("v").alias("top"))
    return people.percent_growth_fields(rows, "field", "year", 1996, 1997, top).withColumn("growth_pct", F.round("growth_pct", 6))


#: Names of places as records write them, with their two- and three-letter codes.
PLACES = [
    ("gb", "GB", "GBR"), ("USA", "US", "USA"), ("Brazil", "BR", "BRA"), ("Kenya", "KE", "KEN"), ("PERU", "PE", "PER"), ("viet-nam", "VN", "VNM"),
    ("Romania", "RO", "ROU"), ("Korea", "KR", "KOR"), ("Lima, Peru", "PE", "PER"), ("Germny", "DE", "DEU"), ("Indonesia", "ID", "IDN"), ("JPN", "JP", "JPN"),
    ("Mozambique", "MZ", "MOZ"), ("Atlantis", None, None), ("egypt", "EG", "EGY"), ("Jordan", "JO", "JOR"), ("India", "IN", "IND"), ("Iraq", "IQ", "IRQ"),
    ("Argentina", "AR", "ARG"), ("Algeria", "DZ", "DZA"), ("Ethiopia", "ET", "ETH"), ("Morocco", "MA", "MAR"), ("Saudi Arabia", "SA", "SAU"), ("China", "CN", "CHN"),
    ("Canada", "CA", "CAN"),
]
_PLACES_SQL = ", ".join(f"({i}, '{n}', {f'{chr(39)}{a}{chr(39)}' if a else 'NULL'}, {f'{chr(39)}{b}{chr(39)}' if b else 'NULL'})" for i, (n, a, b) in enumerate(PLACES))


@query(
    "place_codes",
    f"SELECT c_custkey, p.name AS place, p.a AS iso2, p.b AS iso3 FROM customer JOIN (VALUES {_PLACES_SQL}) p(k, name, a, b) ON c_nationkey = k",
)
def place_codes(t: Tables) -> DataFrame:
    """A country for each nation, looked up once a name and then joined to every customer."""
    names = t.spark.createDataFrame([(i, n) for i, (n, _, _) in enumerate(PLACES)], "k int, place string")
    coded = names.withColumn("iso2", entity.iso2("place"))
    found = entity.with_iso3(coded, files.country_dimension(t.spark), code="iso2", name="place")
    return t.customer.join(F.broadcast(found), F.col("c_nationkey") == F.col("k")).select("c_custkey", "place", "iso2", "iso3")  # a row a nation
