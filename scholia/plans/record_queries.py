"""Queries of record deduplication, overlays, filters and text functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions import parsing, text
from scholia.operators import columns, dedup
from scholia.plans.durable import durable
from scholia.plans.registry import Registry, Tables

REGISTRY = Registry()
query = REGISTRY.query

WEIGHTS = {"id": 7.0, "text": 6.0, "lang": 5.0, "quality": 4.0, "toxic": 3.0, "note": 2.0, "tags": 1.0}


def records(t: Tables) -> DataFrame:
    """Documents as records: source plays the shard; some fields are missing by rule."""
    d = t.documents.join(t.labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")), "doc_id", "left")
    return d.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("file"),
        "text",
        F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("lang"),
        "quality",
        "toxic",
        F.when(F.col("doc_id") % 4 == 1, F.concat(F.lit("note "), F.col("doc_id").cast("string"))).alias("note"),
        F.when(F.col("doc_id") % 5 != 0, F.array(F.col("lang"), F.concat(F.lit("t"), (F.col("doc_id") % 7).cast("string")))).alias("tags"),
    )


def members(t: Tables) -> DataFrame:
    """Clusters of documents with equal letters, whatever stands between them, or with equal sets of words."""
    letters = F.md5(F.lower(F.regexp_replace("text", r"[^\p{L}]+", "")))
    words = F.md5(F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))), " "))
    keys = t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("file"), letters.alias("letters"), words.alias("words"))
    keys = durable(keys, "keys")  # texts are read once
    return dedup.clusters([dedup.star_edges(keys.select("id", "file", k), [k], drop_null_keys=True) for k in ("letters", "words")])


MEMBERS_SQL = r"""
WITH RECURSIVE p AS (
  SELECT doc_id AS id, source AS file, md5(lower(regexp_replace(text, '[^\p{L}]+', '', 'g'))) AS h,
    md5(array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '\p{L}+'))), ' ')) AS t FROM documents
), d AS (SELECT * FROM p
), e AS (
  SELECT a.id AS a, b.id AS b FROM d a JOIN d b ON a.h = b.h AND a.id <> b.id
  UNION SELECT a.id, b.id FROM d a JOIN d b ON a.t = b.t AND a.id <> b.id
), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
), m AS (SELECT a AS id, least(a, min(b)) AS head FROM r GROUP BY a
), member AS (SELECT m.id, d.file, dense_rank() OVER (ORDER BY head) - 1 AS cluster_id FROM m JOIN d USING (id)
), lab AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id
), record AS (
  SELECT d.doc_id AS id, d.source AS file, d.text, CASE WHEN d.doc_id % 3 <> 0 THEN d.lang END AS lang, quality, toxic,
    CASE WHEN d.doc_id % 4 = 1 THEN 'note ' || d.doc_id END AS note,
    CASE WHEN d.doc_id % 5 <> 0 THEN [d.lang, 't' || (d.doc_id % 7)] END AS tags
  FROM documents d LEFT JOIN lab USING (doc_id)
), scored AS (
  SELECT record.*, cluster_id, 7.0::DOUBLE + (text IS NOT NULL)::INT * 6 + (lang IS NOT NULL)::INT * 5 + (quality IS NOT NULL)::INT * 4
    + (toxic IS NOT NULL)::INT * 3 + (note IS NOT NULL)::INT * 2 + (tags IS NOT NULL)::INT AS score
  FROM record JOIN member USING (id, file)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, file, id) AS rk,
    count(*) OVER (PARTITION BY cluster_id) AS total FROM scored
), win AS (SELECT cluster_id, id AS canonical_id, file AS canonical_file, score AS best_score, total AS total_members FROM ranked WHERE rk = 1
), lost AS (SELECT cluster_id, id, file FROM ranked WHERE rk > 1)
"""


@query("dedup_components", MEMBERS_SQL + "SELECT id, file, cluster_id FROM member")
def dedup_components(t: Tables) -> DataFrame:
    return members(t)


@query(
    "dedup_route",
    MEMBERS_SQL
    + """SELECT file, '/raw/' || file || '.parquet' AS path, count(DISTINCT id) AS n_ids, array_to_string(list_sort(list(DISTINCT id)), ',') AS ids
    FROM member WHERE file IN (SELECT source FROM documents WHERE lang = 'en') GROUP BY file""",
)
def dedup_route(t: Tables) -> DataFrame:
    wanted = dedup.wanted_by_file(members(t))
    existing = t.documents.where("lang = 'en'").select(F.col("source").alias("file")).distinct()
    touched, _ = dedup.routed(wanted, existing, "/raw")
    return touched.join(wanted.select("file", "ids"), "file").select("file", "path", "n_ids", F.array_join("ids", ",").alias("ids"))


def scored(t: Tables) -> DataFrame:
    return dedup.scored(records(t), members(t), WEIGHTS)


@query("dedup_score_winner", MEMBERS_SQL + "SELECT * FROM win")
def dedup_score_winner(t: Tables) -> DataFrame:
    return dedup.winners(scored(t))


@query("dedup_losers", MEMBERS_SQL + "SELECT * FROM lost")
def dedup_losers(t: Tables) -> DataFrame:
    rows = scored(t)
    return dedup.losers(rows, dedup.winners(rows))


@query(
    "dedup_patch_scalar",
    MEMBERS_SQL
    + """SELECT cluster_id, canonical_id,
      CASE WHEN max(CASE WHEN rk = 1 THEN note END) IS NULL THEN arg_min(note, rk) FILTER (WHERE rk > 1 AND note IS NOT NULL) END AS note,
      CASE WHEN max(CASE WHEN rk = 1 THEN lang END) IS NULL THEN arg_min(lang, rk) FILTER (WHERE rk > 1 AND lang IS NOT NULL) END AS lang,
      CASE WHEN max(CASE WHEN rk = 1 THEN note END) IS NULL THEN arg_min(id || ':' || file, rk) FILTER (WHERE rk > 1 AND note IS NOT NULL) END AS note_from
    FROM ranked JOIN win USING (cluster_id) GROUP BY cluster_id, canonical_id""",
)
def dedup_patch_scalar(t: Tables) -> DataFrame:
    rows = scored(t)
    patches = dedup.merge_patches(rows, dedup.winners(rows), ["note", "lang"], [])
    return patches.select("cluster_id", "canonical_id", "note", "lang", F.array_join("note_from", ",").alias("note_from"))


@query(
    "dedup_patch_list",
    MEMBERS_SQL
    + """, el AS (SELECT cluster_id, rk, unnest(tags) AS tag, unnest(range(len(tags))) AS k FROM ranked WHERE tags IS NOT NULL
    ), firsts AS (SELECT cluster_id, tag, min(rk * 1000 + k) AS o FROM el GROUP BY cluster_id, tag
    ), merged AS (SELECT cluster_id, string_agg(tag, ',' ORDER BY o) AS tags FROM firsts GROUP BY cluster_id
    ), own AS (SELECT cluster_id, array_to_string(tags, ',') AS mine FROM ranked WHERE rk = 1)
    SELECT w.cluster_id, CASE WHEN w.total_members > 1 AND merged.tags IS DISTINCT FROM mine THEN merged.tags END AS tags
    FROM win w JOIN own USING (cluster_id) LEFT JOIN merged USING (cluster_id)""",
)
def dedup_patch_list(t: Tables) -> DataFrame:
    rows = scored(t)
    patches = dedup.merge_patches(rows, dedup.winners(rows), [], ["tags"])
    return patches.select("cluster_id", F.array_join("tags", ",").alias("tags"))


@query(
    "dedup_changelog",
    MEMBERS_SQL
    + """SELECT r.file, count(*) AS num_rows_before, count(l.id) AS num_deleted_present, count(w.canonical_id) AS num_patched_present,
      count(*) - count(l.id) AS num_rows_after
    FROM record r LEFT JOIN lost l ON l.id = r.id AND l.file = r.file LEFT JOIN win w ON w.canonical_id = r.id AND w.canonical_file = r.file
    WHERE r.file IN (SELECT file FROM lost UNION SELECT canonical_file FROM win) GROUP BY r.file""",
)
def dedup_changelog(t: Tables) -> DataFrame:
    rows = scored(t)
    won = dedup.winners(rows)
    return dedup.changelog(records(t), dedup.losers(rows, won), won)


@query(
    "dedup_applied",
    MEMBERS_SQL
    + """SELECT r.id, r.file, coalesce(CASE WHEN r.note IS NULL THEN p.note END, r.note) AS note
    FROM record r LEFT JOIN (SELECT cluster_id, arg_min(note, rk) FILTER (WHERE rk > 1 AND note IS NOT NULL) AS note FROM ranked GROUP BY cluster_id) p
      ON p.cluster_id = (SELECT max(cluster_id) FROM win w WHERE w.canonical_id = r.id AND w.canonical_file = r.file)
    WHERE NOT EXISTS (SELECT 1 FROM lost l WHERE l.id = r.id AND l.file = r.file)""",
)
def dedup_applied(t: Tables) -> DataFrame:
    rows = scored(t)
    won = dedup.winners(rows)
    patches = dedup.merge_patches(rows, won, ["note"], [])
    return dedup.applied(records(t), dedup.losers(rows, won), patches, ["note"]).select("id", "file", "note")


@query(
    "keep_first_by_key",
    """SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) = 1""",
)
def keep_first_by_key(t: Tables) -> DataFrame:
    return columns.keep_first(t.events, ["user_id", "event_type"], [F.desc("ts"), "event_id"]).select("user_id", "event_id", "event_type", "value")


@query(
    "null_safe_dedupe",
    """WITH k AS (SELECT o_orderkey, CASE WHEN o_custkey % 3 <> 0 THEN o_custkey END AS k FROM orders)
    SELECT o_orderkey, k FROM k WHERE k IS NULL UNION ALL SELECT min(o_orderkey), k FROM k WHERE k IS NOT NULL GROUP BY k""",
)
def null_safe_dedupe(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")).alias("k"))
    return columns.dedupe_filled(rows, "k", ["o_orderkey"])


@query(
    "duplicate_report",
    """SELECT o_orderkey, o_custkey, o_orderdate, count(*) OVER (PARTITION BY o_custkey, o_orderpriority, o_orderstatus) AS copies FROM orders
    QUALIFY copies > 1""",
)
def duplicate_report(t: Tables) -> DataFrame:
    return columns.duplicates(t.orders, ["o_custkey", "o_orderpriority", "o_orderstatus"]).select("o_orderkey", "o_custkey", "o_orderdate", "copies")


@query(
    "coalesce_overlay",
    """WITH p AS (SELECT l_orderkey, max(CASE WHEN l_returnflag = 'R' THEN 'X' END) AS s, max(CASE WHEN l_linestatus = 'O' THEN l_extendedprice END) AS v FROM lineitem GROUP BY 1)
    SELECT o_orderkey, coalesce(s, o_orderstatus) AS o_orderstatus, coalesce(v, o_totalprice) AS o_totalprice FROM orders LEFT JOIN p ON l_orderkey = o_orderkey""",
)
def coalesce_overlay(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    patch = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.max(F.when(F.col("l_returnflag") == "R", "X")).alias("o_orderstatus"),
        F.max(F.when(F.col("l_linestatus") == "O", F.col("l_extendedprice"))).alias("o_totalprice"),
    )
    return columns.patched(rows, patch, "o_orderkey", ["o_orderstatus", "o_totalprice"])


@query(
    "blank_coalesce",
    """SELECT doc_id, CASE WHEN trim(CASE WHEN doc_id % 4 = 0 THEN '  ' ELSE lang END) <> '' THEN lang ELSE source END AS label FROM documents""",
)
def blank_coalesce(t: Tables) -> DataFrame:
    local = F.when(F.col("doc_id") % 4 == 0, F.lit("  ")).otherwise(F.col("lang"))
    return t.documents.select("doc_id", columns.filled_or(local, "source").alias("label"))


@query("anti_missing", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def anti_missing(t: Tables) -> DataFrame:
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query(
    "semi_intersect",
    """SELECT DISTINCT c_custkey AS key FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
      AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')""",
)
def semi_intersect(t: Tables) -> DataFrame:
    with_status = lambda s: t.orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("key"))
    both = with_status("F").intersect(with_status("O"))
    return both.join(t.customer, F.col("key") == F.col("c_custkey"), "left_semi")


@query(
    "reconcile_outer",
    """WITH a AS (SELECT c_nationkey AS nation, count(*) AS customers FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1),
      b AS (SELECT s_nationkey AS nation, count(*) AS suppliers FROM supplier WHERE s_acctbal < 0 GROUP BY 1)
    SELECT coalesce(a.nation, b.nation) AS nation, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers,
      CASE WHEN coalesce(suppliers, 0) <> 0 THEN round(coalesce(customers, 0)::DOUBLE / suppliers, 6) END AS ratio FROM a FULL JOIN b ON a.nation = b.nation""",
)
def reconcile_outer(t: Tables) -> DataFrame:
    a = t.customer.where("c_mktsegment = 'BUILDING'").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    b = t.supplier.where("s_acctbal < 0").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return columns.reconciled(a, b, "nation", "customers", "suppliers").withColumn("ratio", F.round("ratio", 6))


@query("required_filter", "SELECT doc_id, n_chars FROM documents WHERE trim(text) <> '' AND length(text) >= 300 AND lang IS NOT NULL")
def required_filter(t: Tables) -> DataFrame:
    rows = columns.require_columns(t.documents, ["doc_id", "text", "lang"])
    return rows.where(columns.filled_text("text") & (F.length("text") >= 300)).dropna(subset=["lang"]).select("doc_id", "n_chars")


@query(
    "clean_year",
    """SELECT o_orderkey, CASE WHEN y BETWEEN 1996 AND 1999 THEN y END AS year FROM (SELECT o_orderkey, year(o_orderdate)::INT AS y FROM orders)""",
)
def clean_year(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", columns.valid_year(F.year("o_orderdate"), 1996, 1999).alias("year"))


@query("column_inference", "SELECT o_orderkey AS id, o_orderdate AS date, o_totalprice AS amount FROM orders")
def column_inference(t: Tables) -> DataFrame:
    df = t.orders
    found = [columns.infer_column(df.columns, c, required=True) for c in (["OrderKey"], ["order_date", "date"], ["total price", "price"])]
    return df.select(*[F.col(c).alias(n) for c, n in zip(found, ("id", "date", "amount"), strict=True)])


@query("strip_html", "SELECT page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') AS plain FROM pages")
def strip_html(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.without_tags("html", " ").alias("plain"))


@query(
    "topic_text_clean",
    r"""WITH a AS (SELECT page_id, trim(trim(url) || '. ' || trim(html)) AS s FROM pages),
    b AS (SELECT page_id, regexp_replace(s, '<[^>]+>', ' ', 'g') AS s FROM a),
    c AS (SELECT page_id, regexp_replace(s, '\bCopyright\b[^\n\r\x{0085}\x{2028}\x{2029}]*', ' ', 'gi') AS s FROM b),
    d AS (SELECT page_id, regexp_replace(s, '\b(Background|Objectives?|Aims?|Methods|Results|Conclusions?|Keywords|Funding|Conflict of interest)\s*:', ' ', 'gi') AS s FROM c)
    SELECT page_id, trim(regexp_replace(s, '\s+', ' ', 'g')) AS topic_text FROM d""",
)
def topic_text_clean(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.topic_text("url", "html").alias("topic_text"))


@query(
    "plain_abstract",
    r"SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM documents",
)
def plain_abstract(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.plain_abstract("text").alias("plain"))


@query(
    "patent_text_clean",
    r"""WITH t AS (SELECT page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') AS s FROM pages WHERE NOT regexp_matches(html, '(?i)<su[bp]>')),
      e AS (SELECT page_id, replace(replace(replace(replace(replace(s, '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&') AS s FROM t),
      a AS (SELECT page_id, trim(regexp_replace(s, '\s+', ' ', 'g')) AS s FROM e), b AS (SELECT page_id, regexp_replace(s, '\s+([,.;:])', '\1', 'g') AS s FROM a),
      c AS (SELECT page_id, regexp_replace(regexp_replace(s, '\(\s+', '(', 'g'), '\s+\)', ')', 'g') AS s FROM b)
    SELECT page_id, regexp_replace(s, '\s*-\s*', '-', 'g') AS plain FROM c""",
)
def patent_text_clean(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.patent_abstract("html").alias("plain"))


@query(
    "tokenise_terms",
    r"""WITH x AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z][a-z\-]{2,}')) AS term FROM documents)
    SELECT term, count(*) AS n FROM x WHERE term NOT IN ('the', 'and', 'for', 'with', 'that') GROUP BY term""",
)
def tokenise_terms(t: Tables) -> DataFrame:
    from scholia.operators.textmine import tokens

    found = t.documents.select(F.explode(tokens("text", stop=["the", "and", "for", "with", "that"])).alias("term"))
    return found.groupBy("term").agg(F.count("*").alias("n"))


CATEGORIES = {"the": r"\b(the|of)\b", "license": r"\blicen[sc]e\b", "shout": r"!!", "digits": r"\d{4}"}
_HITS = " UNION ALL ".join(
    f"SELECT lang AS grp, '{k}' AS category, regexp_matches(text, '(?i){p}')::INT AS hit FROM documents" for k, p in CATEGORIES.items()
)


@query(
    "regex_categories",
    f"""SELECT grp, category, sum(hit)::BIGINT AS hits, count(*) AS n, round(100.0::DOUBLE * sum(hit) / greatest(count(*), 1), 4) AS pct
    FROM ({_HITS}) GROUP BY grp, category""",
)
def regex_categories(t: Tables) -> DataFrame:
    return columns.category_shares(t.documents, "text", F.col("lang"), CATEGORIES)


@query(
    "explicit_mention_rate",
    r"""SELECT source, count(*) AS n, count_if(regexp_matches(text, '(?i)\blicen[sc]ed?\b')) AS mentions,
      round(100.0::DOUBLE * count_if(regexp_matches(text, '(?i)\blicen[sc]ed?\b')) / greatest(count(*), 1), 4) AS pct FROM documents GROUP BY source""",
)
def explicit_mention_rate(t: Tables) -> DataFrame:
    hit = columns.matches("text", r"\blicen[sc]ed?\b")
    return t.documents.groupBy("source").agg(F.count("*").alias("n"), F.count_if(hit).alias("mentions")).withColumn(
        "pct", F.round(100.0 * F.col("mentions") / F.greatest("n", F.lit(1)), 4)
    )


@query(
    "hash_id",
    r"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN doc_id::VARCHAR ELSE
      left(sha1(regexp_replace(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), '[^a-z0-9 ]', '', 'g') || '||' || n_chars), 16) END AS id FROM documents""",
)
def hash_id(t: Tables) -> DataFrame:
    own = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")).when(F.col("doc_id") % 3 == 0, "NaN")
    return t.documents.select("doc_id", text.hashed_id(own, "text", "n_chars").alias("id"))


_CODED = "lpad((p_size)::VARCHAR, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 4 END, '0') || ' ' || p_type"


@query(
    "code_level_split",
    rf"""WITH c AS (SELECT p_partkey, {_CODED} AS name FROM part)
    SELECT p_partkey, regexp_extract(name, '^(\d{{6}}|\d{{4}}|\d{{2}})\b', 1) AS code, 'L' || length(regexp_extract(name, '^(\d{{6}}|\d{{4}}|\d{{2}})\b', 1)) AS level,
      regexp_replace(name, '^\d{{2}} |\d{{4}} |\d{{6}} ', '', 'g') AS label, left(regexp_extract(name, '^\s*(\d+)', 1), 2) AS top FROM c""",
)
def code_level_split(t: Tables) -> DataFrame:
    name = F.concat(F.when(F.col("p_partkey") % 2 == 0, F.lpad(F.col("p_size").cast("string"), 2, "0")).otherwise(F.lpad(F.col("p_size").cast("string"), 4, "0")), F.lit(" "), F.col("p_type"))
    named = t.part.select("p_partkey", name.alias("name"))
    return named.select(
        "p_partkey", text.field_code("name").alias("code"), text.field_level("name").alias("level"), text.field_label("name").alias("label"), text.top_level("name").alias("top")
    )


@query(
    "ipc_code_standardise",
    """SELECT p_partkey, chr((65 + p_partkey % 8)::INT) || lpad((p_size)::VARCHAR, 2, '0') || 'B' || lpad((p_partkey % 97)::VARCHAR, 4, '0')
      || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE rpad((p_size + 100)::VARCHAR, 6, '0') END AS standard FROM part""",
)
def ipc_code_standardise(t: Tables) -> DataFrame:
    code = F.concat(
        F.char((65 + F.col("p_partkey") % 8).cast("int")), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit("B "), (F.col("p_partkey") % 97).cast("string"),
        F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("/"), (F.col("p_size") + 100).cast("string"))),
    )
    return t.part.select("p_partkey", text.ipc_standard(code).alias("standard"))


@query(
    "parse_bool",
    """WITH w AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN ' Yes. ' WHEN 1 THEN '"no"' WHEN 2 THEN '1' WHEN 3 THEN 'likely true' WHEN 4 THEN 'maybe'
      WHEN 5 THEN NULL WHEN 6 THEN '0.0' ELSE 'NEGATIVE' END AS w FROM events)
    SELECT event_id, CASE event_id % 8 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN true WHEN 6 THEN false WHEN 7 THEN false END AS loose,
      event_id % 8 IN (0, 2, 3) AS strict, CASE WHEN event_id % 8 IN (0, 2, 3) THEN 1 WHEN event_id % 8 IN (1, 6, 7) THEN 0 END AS label FROM w""",
)
def parse_bool(t: Tables) -> DataFrame:
    words = {0: " Yes. ", 1: '"no"', 2: "1", 3: "likely true", 4: "maybe", 6: "0.0", 7: "NEGATIVE"}
    said = t.events.select("event_id", F.try_element_at(F.create_map(*[F.lit(x) for k, w in words.items() for x in (k, w)]), (F.col("event_id") % 8).cast("int")).alias("w"))
    return said.select(
        "event_id", parsing.tolerant_bool("w").alias("loose"), parsing.strict_bool("w").alias("strict"), parsing.label_01("w").alias("label")
    )


@query(
    "parse_json_label",
    """SELECT event_id, CASE event_type WHEN 'view' THEN value > 50 WHEN 'click' THEN value > 50 WHEN 'purchase' THEN value <= 50 WHEN 'signup' THEN NULL ELSE value > 50 END AS label FROM events""",
)
def parse_json_label(t: Tables) -> DataFrame:
    high = F.col("value") > 50
    yes_no = lambda a, b: F.when(high, a).otherwise(b)
    answer = (
        F.when(F.col("event_type") == "view", F.concat(F.lit("```json\n{'implies_UKB_use': "), yes_no("True", "False"), F.lit(", 'why': \"it's, {so}\",}\n```")))
        .when(F.col("event_type") == "click", F.concat(F.lit('It reads {"note": {"x": [1, null]}, "prediction": "'), yes_no("Likely true", "no"), F.lit('"} so')))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("**"), yes_no("No", "Yes"), F.lit("**.")))
        .when(F.col("event_type") == "signup", F.concat(F.lit("{broken: "), F.col("props"), F.lit("} who knows")))
        .otherwise(F.concat(F.lit("I conclude: Implies UKB use = "), yes_no("YES", "0")))
    )
    return t.events.select("event_id", parsing.robust_label(answer).alias("label"))


@query(
    "first_json_object",
    r"""SELECT event_id, regexp_extract('answer: ' || props || ' end', '\{[^}]*\}') AS object, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""",
)
def first_json_object(t: Tables) -> DataFrame:
    said = F.concat(F.lit("answer: "), F.col("props"), F.lit(" end"))
    return t.events.select("event_id", parsing.first_object(said).alias("object"), parsing.outer_object(said, "k bigint")["k"].alias("k"))


@query(
    "prefix_join_inner",
    """SELECT p_partkey, w[1] AS parent, c AS child FROM (SELECT p_partkey, string_split(p_type, ' ') AS w, unnest([p_type, string_split(p_type, ' ')[1] || 'X', p_brand]) AS c FROM part)
    WHERE starts_with(c, w[1])""",
)
def prefix_join_inner(t: Tables) -> DataFrame:
    from scholia.operators.hierarchy import prefix_pairs

    first = F.get(F.split("p_type", " "), 0)
    rows = t.part.select("p_partkey", F.array(first).alias("l2"), F.array("p_type", F.concat(first, F.lit("X")), "p_brand").alias("l4"))
    return prefix_pairs(rows, ["p_partkey"], "l2", "l4")


@query(
    "prefix_join_left",
    """WITH p AS (SELECT p_partkey, string_split(p_type, ' ')[1] AS parent, [p_type, p_brand] AS cs FROM part),
      two AS (SELECT p_partkey, unnest([parent, 'none']) AS parent, cs FROM p), hit AS (SELECT p_partkey, parent, unnest(cs) AS child FROM two)
    SELECT two.p_partkey, two.parent, hit.child FROM two LEFT JOIN hit ON hit.p_partkey = two.p_partkey AND hit.parent = two.parent AND starts_with(hit.child, two.parent)""",
)
def prefix_join_left(t: Tables) -> DataFrame:
    from scholia.operators.hierarchy import prefix_pairs

    first = F.get(F.split("p_type", " "), 0)
    rows = t.part.select("p_partkey", F.array(first, F.lit("none")).alias("l2"), F.array("p_type", "p_brand").alias("l4"))
    return prefix_pairs(rows, ["p_partkey"], "l2", "l4", keep_parents=True)


@query(
    "name_country",
    """SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'GB' WHEN 1 THEN 'DE' WHEN 2 THEN 'JP' WHEN 3 THEN 'FR' WHEN 4 THEN NULL ELSE 'KR' END AS iso FROM supplier""",
)
def name_country(t: Tables) -> DataFrame:
    from scholia.functions.entity import country_of_name

    names = ["Acme plc", "Werk GmbH", "Lab (Japan)", "Institut, France", "Nowhere", "South Korea"]
    return t.supplier.select("s_suppkey", country_of_name(F.get(F.array(*map(F.lit, names)), (F.col("s_suppkey") % 6).cast("int"))).alias("iso"))


@query("file_safe_names", "SELECT page_id, left(regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g'), 40) AS name FROM pages")
def file_safe_names(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.file_safe("url", 40).alias("name"))


@query(
    "list_split",
    """SELECT p_partkey, array_to_string(list_transform(string_split(p_type, ' '), lambda x: trim(x)), '+') AS parts, len(string_split(p_type, ' ')) AS n FROM part""",
)
def list_split(t: Tables) -> DataFrame:
    cell = F.regexp_replace("p_type", " ", " ; ")
    made = F.when(F.col("p_partkey") % 2 == 0, cell).otherwise(F.concat(F.lit("['"), F.regexp_replace("p_type", " ", "', '"), F.lit("']")))
    parts = t.part.select("p_partkey", text.split_list(made).alias("parts"))
    return parts.select("p_partkey", F.array_join("parts", "+").alias("parts"), F.size("parts").cast("long").alias("n"))
