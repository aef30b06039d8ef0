import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from scholia.llm import packing, sharding

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", None, "a", "Häuser, \n\n  tabs\t and  spaces  ", "<|endoftext|> in text", "word " * 3000, "naïve 你好 🙂" * 400, "x" * 5000]


def json_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_ids_equal_those_of_tokenizers_on_a_whole_table(spark):
    texts = TEXTS + ["<|endoftext|><|endoftext|>", "a" * 70_000, "ab9é" * 30_000, "\x00\x7f\u200b", "\r\n \t  x"]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    other = json_tokenizer()
    for t, ids in zip(texts, packing.token_ids(packing.load(PATH), texts), strict=True):
        assert ids.tolist() == [*other.encode(t or "", add_special_tokens=False).ids, 2]


def test_pack_documents_round_trip(spark):
    rows = [(i, t, "x", i) for i, t in enumerate(TEXTS * 5)] + [(3, "a", None, None), (None, "a", None, None)]
    rows += [(2**60 + 1, "b" * 3_000_000, None, 1), (2**60 + 3, "b", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, length int").coalesce(2)
    found = packing.pack_documents(docs, PATH).collect()
    encode = json_tokenizer().encode
    want = Counter()
    for i, t, *_ in rows:
        ids = [*encode(t or "", add_special_tokens=False).ids, 2]
        for k, (s, n) in enumerate(packing.cut(len(ids))):
            assert n <= 1024 and (k == 0 or n == 1024)
            want[i, k, s, n, zlib.crc32(np.array(ids[s : s + n], dtype="<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert set(sequences) == set(range(len(sequences)))


def best_fit_decreasing(counts, capacity=1024):
    """Bins of the plain greedy packing, piece by piece."""
    gaps, bins = [0] * (capacity + 1), 0
    for x in sorted(counts, reverse=True):
        for _ in range(counts[x]):
            g = next((g for g in range(x, capacity) if gaps[g]), 0)
            if g:
                gaps[g] -= 1
                gaps[g - x] += 1
            else:
                bins += 1
                gaps[capacity - x] += 1
    return bins


@pytest.mark.parametrize("seed", range(6))
def test_best_two_fit_is_whole_and_tight(seed):
    draw = np.random.default_rng(seed)
    counts = {int(k): int(draw.integers(1, 400)) for k in draw.choice(np.arange(1, 1025), size=int(draw.integers(1, 500)), replace=False)}
    plan = packing.best_two_fit(counts)
    used = Counter()
    for pattern, times in plan:
        assert times > 0 and sum(pattern) <= 1024
        for x in pattern:
            used[x] += times
    assert used == counts
    assert sum(t for _, t in plan) <= 1.001 * best_fit_decreasing(counts) + 1


def test_communication_matrix_has_its_margins_and_law():
    sizes = sharding.shard_sizes(1000, 7)
    m = sharding.communication_matrix([400, 0, 350, 250], sizes, 5)
    assert m.sum(axis=1).tolist() == [400, 0, 350, 250] and m.sum(axis=0).tolist() == sizes
    first = np.array([sharding.communication_matrix([400, 600], sizes, s)[0, 0] for s in range(400)])
    n, big_k, k = 1000, 400, sizes[0]
    assert abs(first.mean() - k * big_k / n) < 1
    assert abs(first.var() / (k * big_k / n * (1 - big_k / n) * (n - k) / (n - 1)) - 1) < 0.3


@pytest.mark.parametrize(("good", "bad", "n"), [(40, 60, 30), (5, 500, 100), (3000, 4000, 2500)])
def test_draws_by_rejection_follow_the_law(good, bad, n):
    from math import comb, exp, log

    low, high = max(0, n - bad), min(n, good)
    for k in range(low, high + 1, max(1, (high - low) // 40)):
        exact = log(comb(good, k)) + log(comb(bad, n - k)) - log(comb(good + bad, n))
        assert abs(sharding.log_chance(k, good, bad, n) - exact) < 1e-9 * max(1, abs(exact))
    draw = np.random.default_rng(6)
    found = Counter(sharding.ratio_of_uniforms(draw, good, bad, n) for _ in range(20_000))
    chance = {k: exp(sharding.log_chance(k, good, bad, n)) for k in range(low, high + 1)}
    often = [k for k, p in chance.items() if p * 20_000 >= 10]
    chi = sum((found[k] - 20_000 * chance[k]) ** 2 / (20_000 * chance[k]) for k in often)
    assert chi < len(often) + 5 * (2 * len(often)) ** 0.5


def test_large_populations_are_drawn_exactly():
    rows = [3 * 10**9, 10**10, 7, 0, 5 * 10**8]
    sizes = sharding.shard_sizes(sum(rows), 40)
    m = sharding.communication_matrix(rows, sizes, 2)
    assert m.sum(axis=1).tolist() == rows and m.sum(axis=0).tolist() == sizes and (m >= 0).all()
    good, bad, n = sizes[0], sum(rows) - sizes[0], rows[0]
    sd = (n * good / (good + bad) * (bad / (good + bad)) * ((good + bad - n) / (good + bad - 1))) ** 0.5
    draw = np.random.default_rng(3)
    z = np.array([(sharding.hypergeometric(draw, good, bad, n) - n * good / (good + bad)) / sd for _ in range(3000)])
    assert abs(z.mean()) < 0.08 and abs(z.std() - 1) < 0.06 and abs((np.abs(z) < 0.5).mean() - 0.383) < 0.04
    around = [sharding.log_chance(int(n * good / (good + bad) + k), good, bad, n) for k in range(-2, 3)]
    assert max(around) - min(around) < 1e-6  # neighbours near the mode are alike, to the digit


def test_blocks_of_the_matrix_are_the_matrix():
    rows, sizes = [30, 5, 0, 65, 17], sharding.shard_sizes(117, 4)
    whole = sharding.communication_matrix(rows, sizes, 8)
    assert (np.concatenate(list(sharding.matrix_blocks(rows, sizes, 8, 2))) == whole).all()


@pytest.mark.parametrize("name", ["_row", "_part", "_order", "_slice", "_rank", "c0", "shard"])
def test_shards_of_columns_of_any_name(spark, name, tmp_path):
    docs = spark.createDataFrame([(i, 2**60 + i, str(i)) for i in range(50)], f"doc_id long, big long, `{name}` string")
    found = sharding.assign_shards(docs, 4).collect()
    assert {(r["doc_id"], r["big"]) for r in found} == {(i, 2**60 + i) for i in range(50)}
    assert sorted(Counter(r["shard"] for r in found).values()) == [12, 12, 13, 13]
    sharding.write_shards(docs, str(tmp_path / "out"), 4, rows_per_file=5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50 and back.select("shard", "slots").distinct().count() >= 12


def test_shards_are_whole_even_and_gapless(spark, monkeypatch):
    rows = [(i % 700, "é" * (i % 50) if i % 9 else None, "s") for i in range(1003)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(5)
    for per_slice in (10**6, 7):
        monkeypatch.setattr(sharding, "ROWS_PER_SLICE", per_slice)
        found = sharding.shard_report(docs).collect()
        want = Counter((i, 16 + len((t or "").encode()), zlib.crc32((t or "").encode())) for i, t, _ in rows)
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == want
        by = {}
        for r in found:
            by.setdefault(r["shard"], []).append(r["slot"])
        assert sorted(by) == list(range(40)) and {len(v) for v in by.values()} == {25, 26}
        assert all(sorted(v) == list(range(len(v))) for v in by.values())
        assert all(r["law"] == "rows" and r["grown_shard"] is None for r in found)


def test_shuffle_is_uniform(spark):
    docs = spark.createDataFrame([(i, str(i)) for i in range(4000)], "doc_id long, text string").repartition(4)
    found = sharding.shard_report(docs, shards=8).toPandas()
    assert abs(np.corrcoef(found["doc_id"], found["shard"] * 500 + found["slot"])[0, 1]) < 0.06


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(docs, PATH).count() == 0
    assert sharding.shard_report(docs).count() == 0
