import random

import numpy as np
import pytest
from tests.llm.brute import near_duplicates as brute_near
from tests.llm.brute import near_vectors as brute_vectors
from tests.llm.brute import without_repeats as brute_repeats

from scholia.llm import embeddings, minhash, substring

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string"


def corpus():
    """Invented words: copies, near copies, shared passages, runs of one word, null, empty and long texts."""
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 4)))
    text = lambda n: [word() for _ in range(n)]
    passage, base = text(60), text(90)
    rows = [None, "", "  \t", "one", "one two", "ONE two", "a " * 70, "a b " * 50]
    for k in range(40):
        near = list(base)
        for _ in range(k % 9):
            near[draw.randrange(len(near))] = word()
        rows.append(" ".join(near))
    for _ in range(30):
        at = draw.randint(0, 20)
        rows.append(" ".join(text(at) + passage[draw.randint(0, 30) :] + text(draw.randint(0, 25))))
    rows += [" ".join(text(30)) for _ in range(20)] + [" ".join(base)] * 25 + [" ".join(text(5000) + passage)]
    draw.shuffle(rows)
    return [(3 * i + 1, t, None if i % 5 else "en") for i, t in enumerate(rows)]


@pytest.mark.parametrize(("k", "num", "den"), [(3, 85, 100), (5, 4, 5)])
def test_near_duplicates_equal_brute_force(spark, k, num, den):
    from fractions import Fraction

    rows = corpus()
    found = minhash.near_duplicates(spark.createDataFrame(rows, DOCS), k, Fraction(num, den)).collect()
    want = brute_near({d: t for d, t, _ in rows}, k, num, den)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found} == want


def test_blocks_find_what_the_first_member_does_not(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rows = corpus()
    found = minhash.near_duplicates(spark.createDataFrame(rows, DOCS), 3, 0.85).collect()
    want = brute_near({d: t for d, t, _ in rows}, 3, 85, 100)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found} == want


@pytest.mark.parametrize("joined", [0, 3, 10**6])
def test_joined_and_blocked_bands_find_the_same(spark, monkeypatch, joined):
    monkeypatch.setattr(minhash, "JOINED", joined)
    monkeypatch.setattr(minhash, "BAND_BLOCK", 5)
    monkeypatch.setattr(minhash, "BLOCK_CHARS", 2000)
    rows = corpus()
    found = minhash.near_duplicates(spark.createDataFrame(rows, DOCS), 3, 0.85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found} == brute_near({d: t for d, t, _ in rows}, 3, 85, 100)


def test_links_at_the_threshold_are_found(spark):
    """Recall where it is hardest: three hundred pairs of a similarity of 0.85 to 0.87."""
    draw = random.Random(9)
    rows, want = [], 0
    for k in range(300):
        words = [f"w{draw.randrange(10**9)}" for _ in range(202)]
        other = list(words)
        for at in draw.sample(range(5, 190, 8), 5):  # five words change fifteen shingles of two hundred
            other[at] = "x" + other[at]
        rows += [(2 * k + 1, " ".join(words), None), (2 * k + 2, " ".join(other), None)]
    found = minhash.near_duplicates(spark.createDataFrame(rows, DOCS), 3, 0.85).collect()
    got = {r["doc_id"]: r["component_id"] for r in found}
    assert got == {d: c for d, (_, c, _) in brute_near({d: t for d, t, _ in rows}, 3, 85, 100).items()}
    assert sum(got[2 * k + 2] == 2 * k + 1 for k in range(300)) == 300


def test_registers_merge_and_estimate():
    draw = np.random.default_rng(1)
    a, b, c = (draw.integers(0, 2**63, 1500, dtype=np.uint64) for _ in range(3))
    x, y = np.concatenate((a, b)), np.concatenate((a, c))
    assert (np.maximum(minhash.registers(a), minhash.registers(b)) == minhash.registers(x)).all()
    kx, ky = minhash.registers(x)[None], minhash.registers(y)[None]
    assert abs(minhash.estimate(kx, ky, np.array([3000.0]), np.array([3000.0]))[0] - 1 / 3) < 0.15


def test_repeats_equal_brute_force(spark):
    rows = corpus()
    found = substring.without_repeats(spark.createDataFrame(rows, DOCS), 20).collect()
    want = brute_repeats({d: t for d, t, _ in rows}, 20)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found} == want
    assert sum(w[1] for w in want.values()) > 500


def test_test_tables_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = substring.without_repeats(docs, 20).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found} == brute_repeats(texts, 20)
    found = minhash.near_duplicates(docs, 3, 0.85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found} == brute_near(texts, 3, 85, 100)


def test_kept_text_is_what_the_digest_says(spark):
    import hashlib

    rows = substring.without_repeats(spark.createDataFrame(corpus(), DOCS), 20, keep_text=True).collect()
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in rows)


def vectors():
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(6, 16))
    rows = []
    for i in range(300):
        v = centres[i % 6] + draw.normal(size=16) * draw.choice([0.05, 0.3, 0.6])
        rows.append((i * 2, [float(x) for x in v], i % 3))
    rows += [(1001 + 2 * i, rows[4][1], rows[4][2]) for i in range(40)]
    rows += [
        (2001, None, 1), (2003, [0.0] * 16, 1), (2005, [float("nan")] * 16, 1), (2007, [None] * 16, 1), (2009, [], 1),
        (2011, rows[4][1], None), (2013, [float("inf")] + [0.0] * 15, 1), (2015, [x * 1e300 for x in rows[4][1]], rows[4][2]),
    ]
    return rows


@pytest.mark.parametrize(("block", "cells"), [(1024, None), (7, 40), (64, 1)])
def test_near_vectors_equal_brute_force(spark, block, cells):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = embeddings.near_vectors(df, 0.93, blocks_of=block, cells=cells).collect()
    scaled = [(i, [x / 1e300 for x in v] if i == 2015 else v, label) for i, v, label in rows]
    want = brute_vectors(scaled, 0.93)
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found} == want


@pytest.mark.parametrize("threshold", [0.93, 0.8])
def test_spread_vectors_with_planted_pairs_equal_brute_force(spark, threshold):
    """Vectors without clusters, each third with partners just about the threshold in random directions."""
    draw = np.random.default_rng(8)
    x = draw.normal(size=(900, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k in range(0, 900, 3):
        away = x[k + 1] - (x[k + 1] @ x[k]) * x[k]
        cosine = threshold + draw.choice([1e-9, 0.001, 0.03, -1e-6])
        x[k + 1] = cosine * x[k] + np.sqrt(1 - cosine**2) * away / np.linalg.norm(away)
    rows = [(i + 1, [float(c) for c in v], i % 2) for i, v in enumerate(x)]
    rows = [(i, v, (i - 1) // 3 % 2) for i, v, _ in rows]
    found = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), threshold, cells=64).collect()
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found}
    assert got == brute_vectors(rows, threshold) and sum(n for n, _, _ in got.values()) >= 400


def test_vectors_visit_a_share_of_many_cells(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where("embedding is not null").collect()
    x = np.array([r["embedding"] for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cells = embeddings.cells_for(len(x), 10)
    centres = embeddings.spherical_kmeans(x, cells)
    _, goes = embeddings.visits(x @ centres.T, centres, embeddings.reach_of(0.93))
    assert cells >= 14 and goes.sum(axis=1).mean() < 0.75 * cells  # these vectors have no clusters at all
    near = x[:200].repeat(10, axis=0) + np.random.default_rng(1).normal(size=(2000, 64)) * 0.02
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    centres = embeddings.spherical_kmeans(near, 200)
    _, goes = embeddings.visits(near @ centres.T, centres, embeddings.reach_of(0.93))
    assert goes.sum(axis=1).mean() < 3


def test_null_and_repeated_ids_and_vectors_of_two_lengths(spark):
    rows = [(1, [1.0, 0.0], 1, "a"), (1, [1.0, 0.0], 1, "a"), (2, [1.0, 0.01], 1, None), (None, [1.0, 0.0], 1, "b"), (2**60 + 1, [1.0, 0.0, 0.0], 1, "c"), (2**60 + 3, [2.0, 0.0, 0.0], 1, "c")]
    found = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rep string")).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in found), key=str) == sorted(
        [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (None, 0, None, True), (2**60 + 1, 1, 2**60 + 1, True), (2**60 + 3, 1, 2**60 + 1, False)], key=str
    )


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    assert minhash.near_duplicates(docs).count() == 0
    assert substring.without_repeats(docs).count() == 0
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    text, big = "a b c d " * 9, 2**60
    rows = [(1, text, "x", 1), (1, text, "x", 1), (None, text, None, None), (2, None, None, 2), (big + 1, "u v w " * 9, "y", 3), (big + 3, "u v w " * 9 + "u", "y", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, n long").coalesce(1)
    near = minhash.near_duplicates(docs, 3, 0.85).collect()
    assert sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near), key=str) == sorted(
        [(1, 1, True), (1, 1, True), (None, None, True), (2, 2, True), (big + 1, big + 1, True), (big + 3, big + 1, False)], key=str
    )
    cut = substring.without_repeats(docs).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in cut), key=str) == sorted(
        [(1, 36, 32), (1, 36, 32), (None, 36, 0), (2, 0, 0), (big + 1, 27, 24), (big + 3, 28, 28)], key=str
    )
