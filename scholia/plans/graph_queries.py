"""Queries of graphs, text mining, vectors, hierarchies and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.operators import graph, hierarchy, textmine, vectors
from scholia.plans.durable import durable
from scholia.plans.registry import Registry, Tables

REGISTRY = Registry()
query = REGISTRY.query


def listed(t: Tables) -> DataFrame:
    """Parts of orders as labels of papers: part number modulo 60, so that pairs recur."""
    return t.lineitem.select(F.col("l_orderkey").alias("g"), (F.col("l_partkey") % 60).alias("item"), F.col("l_suppkey").alias("s"))


LISTED = "li AS (SELECT DISTINCT l_orderkey AS g, l_partkey % 60 AS item FROM lineitem)"
PAIRS = f"{LISTED}, pr AS (SELECT a.item AS src, b.item AS dst, count(*) AS weight FROM li a JOIN li b ON a.g = b.g AND a.item < b.item GROUP BY 1, 2)"


@query("pair_cooccurrence", f"WITH {PAIRS} SELECT * FROM pr WHERE weight >= 2")
def pair_cooccurrence(t: Tables) -> DataFrame:
    return graph.pairs(listed(t), "g", "item", 2)


@query(
    "npmi_edges",
    f"""WITH {PAIRS}, c AS (SELECT item, count(*) AS n FROM li GROUP BY 1), m AS (SELECT count(DISTINCT g)::DOUBLE AS m FROM li),
      v AS (SELECT src, dst, weight, ln((weight / m) / (a.n * b.n / (m * m)) + 1e-12) / -ln(weight / m + 1e-12) AS pmi
        FROM pr JOIN c a ON a.item = src JOIN c b ON b.item = dst, m)
    SELECT src, dst, weight, round(pmi, 6) AS pmi FROM v WHERE pmi > 0.01""",
)
def npmi_edges(t: Tables) -> DataFrame:
    rows = listed(t)
    groups = rows.agg(F.count_distinct("g").alias("n_groups"))
    found = graph.pmi(graph.pairs(rows, "g", "item"), graph.item_counts(rows, "g", "item"), groups)
    return graph.over_threshold(found, 0.01, "pmi").withColumn("pmi", F.round("pmi", 6))


@query(
    "coauthor_edges",
    """WITH li AS (SELECT DISTINCT l_orderkey AS g, l_suppkey AS s FROM lineitem)
    SELECT a.s AS src, b.s AS dst, count(*) AS weight FROM li a JOIN li b ON a.g = b.g AND a.s < b.s GROUP BY 1, 2""",
)
def coauthor_edges(t: Tables) -> DataFrame:
    return graph.pairs(listed(t), "g", "s")


STRONG = f"{PAIRS}, st AS (SELECT * FROM pr WHERE weight > (SELECT quantile_disc(weight, 0.97) FROM pr)), nodes AS (SELECT DISTINCT item AS node FROM li)"


def strong(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The few strongest pairs and all labels."""
    rows = listed(t)
    pairs = graph.pairs(rows, "g", "item")
    cut = pairs.agg(F.expr("percentile_disc(0.97) within group (order by weight)").alias("cut"))
    edges = pairs.crossJoin(F.broadcast(cut)).where("weight > cut").drop("cut")  # one row
    return edges, rows.select(F.col("item").alias("node")).distinct()


@query(
    "network_summary",
    f"""WITH RECURSIVE {STRONG}, e AS (SELECT src AS a, dst AS b FROM st UNION SELECT dst, src FROM st), r AS (SELECT node AS a, node AS b FROM nodes UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
      comp AS (SELECT a AS node, min(b) AS c FROM r GROUP BY 1), sz AS (SELECT c, count(*) AS n FROM comp GROUP BY 1)
    SELECT (SELECT count(*) FROM sz) AS components, (SELECT max(n) FROM sz) AS giant_size, (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM st) AS edges,
      round((SELECT max(n) FROM sz)::DOUBLE / (SELECT count(*) FROM nodes), 6) AS giant_fraction, round(2.0::DOUBLE * (SELECT count(*) FROM st) / (SELECT count(*) FROM nodes), 6) AS mean_degree,
      round(2.0::DOUBLE * (SELECT count(*) FROM st) / ((SELECT count(*) FROM nodes) * ((SELECT count(*) FROM nodes) - 1)), 6) AS density""",
)
def network_summary(t: Tables) -> DataFrame:
    made = graph.network_summary(*strong(t))
    return made.withColumns({c: F.round(c, 6) for c in ("giant_fraction", "mean_degree", "density")})


@query(
    "network_over_time",
    """WITH li AS (SELECT l_orderkey AS g, l_suppkey AS s, min(year(o_orderdate))::INT AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
      nb AS (SELECT s, min(y) AS y FROM li GROUP BY 1), eb AS (SELECT a.s AS a, b.s AS b, min(greatest(a.y, b.y)) AS y FROM li a JOIN li b ON a.g = b.g AND a.s < b.s GROUP BY 1, 2),
      ys AS (SELECT y FROM nb UNION SELECT y FROM eb)
    SELECT y AS year, (SELECT count(*) FROM nb WHERE nb.y <= ys.y) AS nodes, (SELECT count(*) FROM eb WHERE eb.y <= ys.y) AS edges,
      round(2.0::DOUBLE * (SELECT count(*) FROM eb WHERE eb.y <= ys.y) / (SELECT count(*) FROM nb WHERE nb.y <= ys.y), 6) AS mean_degree FROM ys""",
)
def network_over_time(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("g"), F.col("l_suppkey").alias("s"), F.year("o_orderdate").alias("y"))
    return graph.network_over_time(rows, "g", "s", "y").withColumn("mean_degree", F.round("mean_degree", 6))


@query(
    "degree_stats",
    f"""WITH {STRONG}, x AS (SELECT src AS node, weight FROM st UNION ALL SELECT dst, weight FROM st)
    SELECT nodes.node, count(x.weight) AS degree, coalesce(sum(x.weight), 0)::DOUBLE AS strength FROM nodes LEFT JOIN x ON x.node = nodes.node GROUP BY 1""",
)
def degree_stats(t: Tables) -> DataFrame:
    return graph.degrees(*strong(t))


PARTITION = "pt AS (SELECT DISTINCT item AS node, (item % 5)::INT AS community FROM li)"


def partition(t: Tables) -> DataFrame:
    return listed(t).select(F.col("item").alias("node"), (F.col("item") % 5).cast("int").alias("community")).distinct()


@query(
    "community_rollup",
    f"""WITH {PAIRS}, {PARTITION}, nm AS (SELECT a.community AS ca, b.community AS cb, weight FROM pr JOIN pt a ON a.node = src JOIN pt b ON b.node = dst),
      top AS (SELECT community FROM pt GROUP BY 1 ORDER BY count(*) DESC, community LIMIT 3), k AS (SELECT DISTINCT pt.community, coalesce(top.community, -1) AS c FROM pt LEFT JOIN top ON top.community = pt.community),
      nd AS (SELECT k.c, count(*) AS size FROM pt JOIN k USING (community) GROUP BY 1), w AS (SELECT a.c, sum(weight)::DOUBLE AS w FROM nm JOIN k a ON a.community = ca JOIN k b ON b.community = cb WHERE a.c = b.c GROUP BY 1)
    SELECT nd.c AS community, size, coalesce(w, 0) AS internal_weight FROM nd LEFT JOIN w ON w.c = nd.c""",
)
def community_rollup(t: Tables) -> DataFrame:
    sizes, between = graph.community_graph(graph.pairs(listed(t), "g", "item"), partition(t))
    return graph.collapsed(sizes, between, 3)[0]


@query(
    "community_between",
    f"""WITH {PAIRS}, {PARTITION} SELECT least(a.community, b.community) AS src, greatest(a.community, b.community) AS dst, sum(weight)::DOUBLE AS weight
    FROM pr JOIN pt a ON a.node = src JOIN pt b ON b.node = dst WHERE a.community <> b.community GROUP BY 1, 2""",
)
def community_between(t: Tables) -> DataFrame:
    return graph.community_graph(graph.pairs(listed(t), "g", "item"), partition(t))[1]


@query(
    "community_summary",
    f"""WITH {LISTED}, {PARTITION}, c AS (SELECT item, count(*) AS n FROM li GROUP BY 1), o AS (SELECT community, node, n, row_number() OVER (PARTITION BY community ORDER BY n DESC, node) AS k FROM pt JOIN c ON item = node)
    SELECT community, count(*) AS n_labels, string_agg(node::VARCHAR, '; ' ORDER BY k) FILTER (WHERE k <= 4) AS top_labels, string_agg(node::VARCHAR, '; ' ORDER BY k) AS all_labels FROM o GROUP BY 1""",
)
def community_summary(t: Tables) -> DataFrame:
    rows = listed(t)
    return graph.community_summary(partition(t), graph.item_counts(rows, "g", "item"), 4)


@query(
    "community_sizes",
    """WITH s AS (SELECT label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, label) AS k FROM embeddings GROUP BY 1)
    SELECT count(*) AS communities, count_if(n <= 5)::BIGINT AS tiny, count_if(n >= 100)::BIGINT AS large, median(n)::DOUBLE AS median_size,
      round(sum(CASE WHEN k <= 10 THEN n ELSE 0 END)::DOUBLE / sum(n), 6) AS top10_cover, round(sum(CASE WHEN k <= 20 THEN n ELSE 0 END)::DOUBLE / sum(n), 6) AS top20_cover FROM s""",
)
def community_sizes(t: Tables) -> DataFrame:
    made = graph.community_sizes(t.embeddings.select(F.col("vec_id").alias("node"), F.col("label").alias("community")))
    return made.withColumns({c: F.round(c, 6) for c in ("top10_cover", "top20_cover")})


@query(
    "modularity",
    f"""WITH {PAIRS}, {PARTITION}, m AS (SELECT sum(weight)::DOUBLE AS m FROM pr), k AS (SELECT community, sum(weight)::DOUBLE AS k FROM (SELECT src AS node, weight FROM pr UNION ALL SELECT dst, weight FROM pr) JOIN pt USING (node) GROUP BY 1),
      i AS (SELECT a.community, sum(weight)::DOUBLE AS w FROM pr JOIN pt a ON a.node = src JOIN pt b ON b.node = dst WHERE a.community = b.community GROUP BY 1)
    SELECT round(sum(coalesce(w, 0) / m - pow(k / (2 * m), 2)), 8) AS modularity FROM k LEFT JOIN i USING (community), m""",
)
def modularity(t: Tables) -> DataFrame:
    return graph.modularity(graph.pairs(listed(t), "g", "item"), partition(t)).select(F.round("modularity", 8).alias("modularity"))


@query(
    "ari",
    """WITH c AS (SELECT label AS a, vec_id % 4 AS b, count(*)::DOUBLE AS n FROM embeddings GROUP BY 1, 2), ij AS (SELECT sum(n * (n - 1) / 2) AS x, sum(n) AS t FROM c),
      ai AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT a, sum(n) AS n FROM c GROUP BY 1)), bj AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT b, sum(n) AS n FROM c GROUP BY 1))
    SELECT round((ij.x - ai.x * bj.x / (t * (t - 1) / 2)) / ((ai.x + bj.x) / 2 - ai.x * bj.x / (t * (t - 1) / 2)), 8) AS ari FROM ij, ai, bj""",
)
def ari(t: Tables) -> DataFrame:
    return graph.adjusted_rand(t.embeddings.withColumn("b", F.col("vec_id") % 4), "label", "b").select(F.round("ari", 8).alias("ari"))


def parts(t: Tables) -> DataFrame:
    """Parts of orders by their own number: the whole graph of the table."""
    return t.lineitem.select(F.col("l_orderkey").alias("g"), F.col("l_partkey").alias("item"))


def part_graph(t: Tables) -> tuple[DataFrame, DataFrame]:
    """All pairs of parts, kept for the reads that follow, and all parts of orders."""
    rows = parts(t)
    return durable(graph.pairs(rows, "g", "item"), "pairs"), rows.select(F.col("item").alias("node")).distinct()


def part_sizes(t: Tables) -> DataFrame:
    """Parts of orders with their size as the community."""
    sizes = t.part.select(F.col("p_partkey").alias("item"), F.col("p_size").cast("int").alias("community"))
    return parts(t).select("item").distinct().join(sizes, "item").withColumnRenamed("item", "node")


PART_SIZES = "pt AS (SELECT DISTINCT item AS node, p_size::INT AS community FROM li JOIN part ON p_partkey = item)"


def part_pairs(t: Tables) -> DataFrame:
    """The pairs of ``part_graph``, a row each time, for what sums them itself."""
    rows = parts(t).where("item is not null").select("g", "item").distinct()
    return graph.pair_rows(rows, "g", "item").withColumn("weight", F.lit(1))


def unfolded(name: str) -> str:
    """The SQL of a query over folded parts, over the parts themselves and with part sizes as communities."""
    return REGISTRY.oracles[name].replace(LISTED, LISTED.replace(" % 60", "")).replace(PARTITION, PART_SIZES)


@query("pair_cooccurrence_parts", unfolded("pair_cooccurrence").replace(" WHERE weight >= 2", ""))
def pair_cooccurrence_parts(t: Tables) -> DataFrame:
    return graph.pairs(parts(t), "g", "item")


@query("npmi_edges_parts", unfolded("npmi_edges"))
def npmi_edges_parts(t: Tables) -> DataFrame:
    rows = parts(t)
    groups = rows.agg(F.count_distinct("g").alias("n_groups"))
    found = graph.pmi(graph.pairs(rows, "g", "item"), graph.item_counts(rows, "g", "item"), groups)
    return graph.over_threshold(found, 0.01, "pmi").withColumn("pmi", F.round("pmi", 6))


#: Without SQL: reachability over all pairs is too slow for recursive SQL; tests search plainly.
@query("network_summary_parts")
def network_summary_parts(t: Tables) -> DataFrame:
    made = graph.network_summary(*part_graph(t))
    return made.withColumns({c: F.round(c, 6) for c in ("giant_fraction", "mean_degree", "density")})


@query("degree_stats_parts", unfolded("degree_stats").replace(" WHERE weight > (SELECT quantile_disc(weight, 0.97) FROM pr)", ""))
def degree_stats_parts(t: Tables) -> DataFrame:
    return graph.degrees(*part_graph(t))


@query("community_rollup_parts", unfolded("community_rollup"))
def community_rollup_parts(t: Tables) -> DataFrame:
    sizes, between = graph.community_graph(part_graph(t)[0], part_sizes(t))
    return graph.collapsed(sizes, between, 3)[0]


@query("community_between_parts", unfolded("community_between"))
def community_between_parts(t: Tables) -> DataFrame:
    return graph.community_graph(part_graph(t)[0], part_sizes(t))[1]


@query("community_summary_parts", unfolded("community_summary"))
def community_summary_parts(t: Tables) -> DataFrame:
    return graph.community_summary(part_sizes(t), graph.item_counts(parts(t), "g", "item"), 4)


@query("modularity_parts", unfolded("modularity"))
def modularity_parts(t: Tables) -> DataFrame:
    return graph.modularity(part_graph(t)[0], part_sizes(t)).select(F.round("modularity", 8).alias("modularity"))


@query(
    "louvain_quality",
    """SELECT count(DISTINCT l_partkey) AS nodes, count(DISTINCT l_partkey) AS placed, true AS beats_sizes FROM lineitem""",
)
def louvain_quality(t: Tables) -> DataFrame:
    """What a partition must hold whatever its seeds: every node has one community, and it beats the partition by size."""
    edges, node = durable(part_pairs(t), "louvain"), F.col("node")
    found = graph.louvain(edges)
    sizes = part_sizes(t).select("node", F.col("community").cast("long").alias("sizes"))
    both = graph.modularities(edges, found.select("node", F.col("community").cast("long").alias("own")).join(sizes, "node", "full"))
    counts = found.agg(F.count_distinct(node).alias("nodes"), F.count("*").alias("placed"))
    return counts.crossJoin(both).select("nodes", "placed", (F.col("own") > F.col("sizes")).alias("beats_sizes"))  # one row each


@query("louvain_communities")
def louvain_communities(t: Tables) -> DataFrame:
    return graph.louvain(part_graph(t)[0])


TERMS = r"tk AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z][a-z\-]{2,}') AS ts FROM documents)"
TFIDF = f"""{TERMS}, n AS (SELECT count(*)::DOUBLE AS n FROM tk), tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM tk) GROUP BY 1, 2),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), raw AS (SELECT doc_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), n WHERE df >= 5 AND df <= 0.85 * n),
  tw AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM raw)"""


def weights(t: Tables) -> DataFrame:
    return textmine.tfidf(t.documents.select("doc_id", textmine.tokens("text").alias("terms")), "doc_id", "terms", min_df=5, max_df=0.85)


@query(
    "tfidf_discriminative",
    f"""WITH {TFIDF}, g AS (SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN 'a' ELSE 'b' END AS g FROM documents), s AS (SELECT g, count(*)::DOUBLE AS m FROM g GROUP BY 1),
      x AS (SELECT g, term, sum(w) / max(m) AS mw FROM tw JOIN g USING (doc_id) JOIN s USING (g) GROUP BY 1, 2)
    SELECT term, round(coalesce(max(CASE WHEN g = 'a' THEN mw END), 0), 6) AS mean_a, round(coalesce(max(CASE WHEN g = 'b' THEN mw END), 0), 6) AS mean_b FROM x GROUP BY 1""",
)
def tfidf_discriminative(t: Tables) -> DataFrame:
    groups = t.documents.select("doc_id", F.when(F.col("n_chars") % 2 == 0, "a").otherwise("b").alias("g"))
    made = textmine.discriminative(weights(t), groups, "doc_id", "g", "a", "b")
    return made.select("term", F.round("mean_a", 6).alias("mean_a"), F.round("mean_b", 6).alias("mean_b"))


@query(
    "cluster_top_terms",
    f"""WITH {TFIDF}, s AS (SELECT lang, count(*)::DOUBLE AS m FROM documents GROUP BY 1), x AS (SELECT lang, term, sum(w) / max(m) AS mw FROM tw JOIN documents USING (doc_id) JOIN s USING (lang) GROUP BY 1, 2)
    SELECT lang, term, round(mw, 6) AS mean_w, row_number() OVER (PARTITION BY lang ORDER BY mw DESC, term) AS rank FROM x QUALIFY rank <= 5""",
)
def cluster_top_terms(t: Tables) -> DataFrame:
    made = textmine.top_terms(weights(t), t.documents, "doc_id", "lang", 5)
    return made.select("lang", "term", F.round("mean_w", 6).alias("mean_w"), F.col("rank").cast("long").alias("rank"))


@query(
    "term_ngrams",
    f"""WITH {TERMS}, x AS (SELECT unnest(list_transform(range(1, len(ts)), lambda i: ts[i] || ' ' || ts[i + 1])) AS gram FROM tk WHERE len(ts) >= 2) SELECT gram, count(*) AS n FROM x GROUP BY 1 HAVING count(*) >= 3""",
)
def term_ngrams(t: Tables) -> DataFrame:
    grams = t.documents.select(F.explode(textmine.ngrams(textmine.tokens("text"), 2, 2)).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n")).where("n >= 3")


@query(
    "frequent_terms",
    r"""WITH x AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z\-]{2,}')) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS n FROM x WHERE term NOT IN ('the', 'and') GROUP BY 1, 2)
    SELECT doc_id, term, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, length(term) DESC, term) AS rank FROM c QUALIFY rank <= 3""",
)
def frequent_terms(t: Tables) -> DataFrame:
    return textmine.frequent_terms(t.documents, "doc_id", "text", 3, ["the", "and"]).withColumn("rank", F.col("rank").cast("long"))


@query(
    "corpus_fingerprint",
    """WITH d AS (SELECT ('0x' || left(md5(lang || chr(9) || text), 15))::BIGINT::HUGEINT AS x FROM documents)
    SELECT left(sha1(sum(x) || '|' || count(*)), 12) AS fingerprint FROM d""",
)
def corpus_fingerprint(t: Tables) -> DataFrame:
    return textmine.fingerprint(t.documents, "lang", "text")


UNITS = "un AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12)) AS u FROM embeddings)"
CENTRES = f"""{UNITS}, cp AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(u) AS x, unnest(range(len(u))) AS i FROM un) GROUP BY 1, 2),
  cc AS (SELECT label, list(x ORDER BY i) AS c FROM cp GROUP BY 1)"""


@query(
    "centroid_cosine",
    f"""WITH {CENTRES}, v AS (SELECT a.label AS group_a, b.label AS group_b, list_dot_product(a.c, b.c) / (sqrt(list_dot_product(a.c, a.c)) * sqrt(list_dot_product(b.c, b.c))) AS s FROM cc a JOIN cc b ON a.label < b.label)
    SELECT group_a, group_b, round(s, 6) AS similarity, round(1 - s, 6) AS distance FROM v""",
)
def centroid_cosine(t: Tables) -> DataFrame:
    made = vectors.centroid_cosines(t.embeddings, "label", "embedding")
    return made.select("group_a", "group_b", F.round("similarity", 6).alias("similarity"), F.round("distance", 6).alias("distance"))


@query(
    "silhouette_cosine",
    f"""WITH {UNITS}, d AS (SELECT a.vec_id, a.label, b.label AS g, sum(1 - list_dot_product(a.u, b.u)) AS s, count(*) AS n FROM un a, un b GROUP BY 1, 2, 3),
      x AS (SELECT vec_id, max(CASE WHEN g = label THEN s / (n - 1) END) AS a, min(CASE WHEN g <> label THEN s / n END) AS b FROM d GROUP BY 1)
    SELECT vec_id, round((b - a) / greatest(a, b), 5) AS silhouette FROM x""",
)
def silhouette_cosine(t: Tables) -> DataFrame:
    return vectors.cosine_silhouettes(t.embeddings, "vec_id", "embedding", "label").select("vec_id", F.round("silhouette", 5).alias("silhouette"))


@query(
    "prototype_classify",
    f"""WITH {UNITS}, p AS (SELECT i AS label, list_transform(range(64), lambda j: CASE WHEN j % 4 = i THEN 0.25::DOUBLE ELSE 0.0 END) AS p FROM range(4) r(i)),
      s AS (SELECT vec_id, p.label, list_dot_product(u, p) AS s FROM un, p), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC) AS k FROM s)
    SELECT vec_id, 'p' || max(CASE WHEN k = 1 THEN label END) AS label, round(max(CASE WHEN k = 1 THEN s END), 6) AS score,
      round(max(CASE WHEN k = 1 THEN s END) - max(CASE WHEN k = 2 THEN s END), 6) AS margin FROM r GROUP BY 1""",
)
def prototype_classify(t: Tables) -> DataFrame:
    prototypes = [(f"p{i}", [1.0 if j % 4 == i else 0.0 for j in range(64)]) for i in range(4)]
    made = vectors.nearest_prototypes(t.embeddings, "vec_id", "embedding", prototypes)
    return made.select("vec_id", "label", F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"))


@query("kmeans_clusters")
def kmeans_clusters(t: Tables) -> DataFrame:
    return vectors.kmeans(t.embeddings, "vec_id", "embedding", [8, 10])


def _axis(k: int, matrix: str) -> str:
    """SQL for the leading axis ``v{k}`` of a symmetric matrix ``i, j, x`` by squaring it, its largest part positive."""
    return f"""s{k} AS (SELECT 0 AS n, i, j, x FROM {matrix} UNION ALL
      SELECT n + 1, i, j, x / sum(CASE WHEN i = j THEN x END) OVER () FROM (SELECT max(a.n) AS n, a.i, b.j, sum(a.x * b.x) AS x FROM s{k} a JOIN s{k} b ON a.j = b.i WHERE a.n < 13 GROUP BY a.i, b.j)),
      w{k} AS (SELECT i, x FROM s{k} WHERE n = 13 AND j = (SELECT arg_max(j, x) FROM s{k} WHERE n = 13 AND i = j)),
      v{k} AS (SELECT i, x / (SELECT sqrt(sum(x * x)) FROM w{k}) * sign((SELECT arg_max(x, abs(x)) FROM w{k})) AS x FROM w{k})"""


@query(
    "pca_projection",
    f"""WITH RECURSIVE e AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS i FROM embeddings),
      c AS (SELECT vec_id, i, x - avg(x) OVER (PARTITION BY i) AS x FROM e),
      g AS (SELECT a.i, b.i AS j, sum(a.x * b.x) AS x FROM c a JOIN c b ON a.vec_id = b.vec_id GROUP BY 1, 2), m AS (SELECT i, j, x / (SELECT sum(x) FROM g WHERE i = j) AS x FROM g),
      {_axis(1, 'm')}, l AS (SELECT sum(a.x * m.x * b.x) AS l FROM m JOIN v1 a ON a.i = m.i JOIN v1 b ON b.i = m.j),
      r AS (SELECT m.i, m.j, m.x - l * a.x * b.x AS x FROM m JOIN v1 a ON a.i = m.i JOIN v1 b ON b.i = m.j, l), {_axis(2, 'r')}
    SELECT vec_id, round(sum(c.x * v1.x), 4) AS pc1, round(sum(c.x * v2.x), 4) AS pc2 FROM c JOIN v1 USING (i) JOIN v2 USING (i) GROUP BY 1""",
)
def pca_projection(t: Tables) -> DataFrame:
    made = vectors.pca(t.embeddings, "vec_id", "embedding")
    return made.select("vec_id", F.round("pc1", 4).alias("pc1"), F.round("pc2", 4).alias("pc2"))


@query(
    "hierarchy_rollup",
    """WITH p AS (SELECT r_name AS a, n_name AS b, c_mktsegment AS c FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
      a AS (SELECT a, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, a) AS k FROM p GROUP BY 1 QUALIFY k <= 3),
      b AS (SELECT a, b, count(*) AS n, row_number() OVER (PARTITION BY a ORDER BY count(*) DESC, b) AS k FROM p WHERE a IN (SELECT a FROM a) GROUP BY 1, 2 QUALIFY k <= 2),
      c AS (SELECT a, b, c, count(*) AS n, row_number() OVER (PARTITION BY a, b ORDER BY count(*) DESC, c) AS k FROM p WHERE (a, b) IN (SELECT (a, b) FROM b) GROUP BY 1, 2, 3 QUALIFY k <= 2)
    SELECT 'region' AS level, a AS path, a AS value, n, k AS rank FROM a UNION ALL SELECT 'nation', a || '/' || b, b, n, k FROM b UNION ALL SELECT 'segment', a || '/' || b || '/' || c, c, n, k FROM c""",
)
def hierarchy_rollup(t: Tables) -> DataFrame:
    rows = (
        t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("segment"))
    )
    return hierarchy.level_counts(rows, ["region", "nation", "segment"], [3, 2, 2]).withColumn("rank", F.col("rank").cast("long"))


@query(
    "path_levels",
    """SELECT p_partkey, c AS code, CASE WHEN p_size <= 25 THEN 'A' ELSE left(c, 1) END AS section, CASE WHEN p_size <= 25 THEN 'First' ELSE 'Section ' || left(c, 1) END AS section_title,
      left(c, 3) AS class, 'Class ' || left(c, 3) AS class_title
    FROM (SELECT p_partkey, p_size, CASE WHEN p_size <= 25 THEN 'A' ELSE 'B' END || lpad(p_size::VARCHAR, 2, '0') AS c FROM part)""",
)
def path_levels(t: Tables) -> DataFrame:
    code = F.concat(F.when(F.col("p_size") <= 25, "A").otherwise("B"), F.lpad(F.col("p_size").cast("string"), 2, "0"))
    tree = t.part.where("p_size <= 25").select(code.alias("symbol"), F.lit("x").alias("kind"), F.lit("").alias("title"), F.concat(F.lit("A/"), code).alias("path")).distinct()
    root = t.spark.sql("select 'A' as symbol, 's' as kind, 'First' as title, 'A' as path")
    rows = t.part.select("p_partkey", code.alias("code"))
    return hierarchy.code_levels(rows, "code", tree.unionByName(root)).select("p_partkey", "code", "section", "section_title", "class", "class_title")


@query(
    "stream_sessions",
    """WITH g AS (SELECT user_id, ts, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 1800000000)::INT, 1) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
    SELECT user_id, count(*) AS events FROM s GROUP BY user_id, session""",
)
def stream_sessions(t: Tables) -> DataFrame:
    from scholia.streaming.streams import session_counts

    return session_counts(t.events, "user_id", "ts").select("user_id", "events")
