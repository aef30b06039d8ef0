"""The graph queries over all parts, against plain versions on the smallest tables."""

from collections import Counter
from itertools import combinations

import duckdb
import pytest
from tests.llm.brute import components

from scholia.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def weights():
    """Orders of each pair of parts."""
    rows = duckdb.sql(f"select distinct l_orderkey, l_partkey from '{SF}/lineitem.parquet'").fetchall()
    orders = {}
    for g, item in rows:
        orders.setdefault(g, set()).add(item)
    return {i for _, i in rows}, Counter(p for items in orders.values() for p in combinations(sorted(items), 2))


def test_pairs_and_degrees_of_all_parts(spark, weights):
    nodes, pairs = weights
    found = catalogue.QUERIES["pair_cooccurrence_parts"](spark, SF).collect()
    assert {(r["src"], r["dst"]): r["weight"] for r in found} == pairs
    ends = Counter(e for p in pairs for e in p)
    strength = Counter()
    for p, w in pairs.items():
        for e in p:
            strength[e] += w
    found = {r["node"]: (r["degree"], r["strength"]) for r in catalogue.QUERIES["degree_stats_parts"](spark, SF).collect()}
    assert found == {n: (ends[n], float(strength[n])) for n in nodes}


def test_summary_of_all_parts(spark, weights):
    nodes, pairs = weights
    sizes = Counter(components(nodes, pairs).values())
    r = catalogue.QUERIES["network_summary_parts"](spark, SF).first()
    assert (r["nodes"], r["edges"], r["components"], r["giant_size"]) == (len(nodes), len(pairs), len(sizes), max(sizes.values()))
    assert r["mean_degree"] == round(2 * len(pairs) / len(nodes), 6)


def test_louvain_places_every_part(spark, weights):
    _, pairs = weights
    found = {r["node"]: r["community"] for r in catalogue.QUERIES["louvain_communities"](spark, SF).collect()}
    assert set(found) == {e for p in pairs for e in p}

    def modularity(of):
        m, k, inside = sum(pairs.values()), Counter(), 0
        for (a, b), w in pairs.items():
            k[of[a]] += w
            k[of[b]] += w
            inside += w * (of[a] == of[b])
        return inside / m - sum((x / (2 * m)) ** 2 for x in k.values())

    assert modularity(found) > max(0.01, modularity({n: n for n in found}), modularity(dict.fromkeys(found, 0)))
