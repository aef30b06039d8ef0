import functools
import math
import random
import re
import time
from collections import Counter
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest

from scholia.llm import decontamination, lattice, licences, quality

SF = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
EDGES = [(901, None), (902, ""), (903, " \n "), (904, "x"), (904, "x"), (None, "x y z")]


def all_splits(word, pieces):
    """Every segmentation of a word, by plain recursion."""
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        if word[:k] in pieces:
            for rest in all_splits(word[k:], pieces):
                yield [word[:k], *rest]


def word_chance(v, weights, word):
    """A word's probability by listing its segmentations; characters without a piece are bytes."""
    known = {p for p, i in v.ids.items()}

    def ids_of(parts):
        for k, p in enumerate(parts):
            if p in known and (k == 0 or not v.begins[v.ids[p]]):
                yield [v.ids[p]]
            else:
                yield v.bytes_of(p)

    usable = lambda k, p: p in known and (k == 0 or not v.begins[v.ids[p]])
    total = 0.0
    marked = "▁" + word
    free = {p for k in range(1, len(marked) + 1) for j in range(k) if usable(j, p := marked[j:k])} | set(marked)
    for parts in all_splits(marked, free):
        if any(len(p) > 1 and not usable(len("".join(parts[:k])), p) for k, p in enumerate(parts)):
            continue
        ids = [i for group in ids_of(parts) for i in group]
        total += math.exp(sum(weights[0, i] for i in ids[:-1]) + weights[1, ids[-1]])
    return total


def test_lattice_sums_all_segmentations():
    v = lattice.Vocabulary(PIECES)
    weights = lattice.log_weights(v, np.array([[10.0, 65.0], [14.0, 101.0]]))
    assert np.isclose(np.exp(weights[:, v.begins]).sum(), 1) and np.isclose(np.exp(weights[:, ~v.begins]).sum(), 1)
    words = ["the", "thonre", "a", "réouy", "über", "zz\U0001f642q", "▁x", "x" * 40]
    found = lattice.Lattice(v, weights).log_words(words)
    for w, log in zip(words[:7], found, strict=False):
        assert math.isclose(math.log(word_chance(v, weights, w)), log, rel_tol=1e-9)
    assert np.isfinite(found).all()


def test_scores_of_the_vocabulary_rank_the_weights():
    v = lattice.Vocabulary(PIECES)
    weights = lattice.log_weights(v, np.array([[10.0, 65.0], [14.0, 101.0]]))
    for group in (v.begins, ~v.begins):
        own = np.flatnonzero(group & v.usable)
        scores = np.array([v.model.get_score(int(i)) for i in own])
        plain = np.array([not v.model.is_byte(int(i)) for i in own])
        order = np.argsort(-scores[plain], kind="stable")
        assert (np.diff(weights[0, own[plain]][order]) <= 1e-12).all()
        w = np.exp(weights[0, own] - weights[0, own].max())
        assert math.isclose((w * v.depth[own]).sum() / w.sum(), 6.5 if group is v.begins or group[own[0]] and v.begins[own[0]] else 101 / 14, rel_tol=1e-6)


def test_long_words_equal_short_ones(monkeypatch):
    v = lattice.Vocabulary(PIECES)
    words = ["hello" * 14, "x" * 66, "thereñó\U0001f642" * 10, "a▁▁b" * 20]
    found = []
    for long, stretch in ((10**9, 65_536), (1, 65_536), (1, 7)):
        monkeypatch.setattr(lattice, "LONG", long)
        monkeypatch.setattr(lattice, "STRETCH", stretch)
        found.append(lattice.Lattice(v, lattice.log_weights(v, np.array([[10.0, 65.0], [14.0, 101.0]]))).log_words(words))
    assert np.allclose(found[0], found[1], rtol=1e-10) and np.allclose(found[0], found[2], rtol=1e-10)


def test_a_text_without_spaces_is_scored_in_bounded_time(spark):
    rows = [(1, "Aé9" * 400_000), (2, "a b"), (2**60 + 1, None), (None, "a"), (2**60 + 3, "b")]
    began = time.time()
    found = {r["doc_id"]: r for r in lattice.lattice_scores(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), PIECES).collect()}
    assert set(found) == {1, 2, 2**60 + 1, None, 2**60 + 3} and time.time() - began < 120
    assert math.isfinite(found[1]["score"]) and found[1]["score"] < -400_000 and found[1]["n_tokens"] == 2


def test_scores_of_documents_equal_a_plain_sum(spark):
    rows = [(r["doc_id"], r["text"][:300]) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(40).collect()] + EDGES
    found = lattice.lattice_scores(spark.createDataFrame(rows, "doc_id long, text string"), PIECES).collect()
    v = lattice.Vocabulary(PIECES)
    words = lambda t: [w.decode() for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())]
    train = [words(t) for d, t in rows if d is None or crc32(str(d).encode()) % 7 != 2]
    cut = [v.model.encode(w) for ws in train for w in ws]
    inner = [i for ids in cut for i in ids[1:]]
    weights = lattice.log_weights(v, np.array([[len(cut), sum(v.depth[ids[0]] for ids in cut)], [len(inner), sum(v.depth[i] for i in inner)]]))
    end = (len(train) + 1) / (len(cut) + len(train) + 2)
    chance = functools.cache(lambda w: math.log10(word_chance(v, weights, w) * (1 - end)))
    short = {w for _, t in rows for w in words(t) if len(w) <= 12}
    want = Counter((d, round(sum(map(chance, words(t))) + math.log10(end), 5)) for d, t in rows if set(words(t)) <= short)
    got = Counter((r["doc_id"], round(r["score"], 5)) for r in found)
    assert sum(want.values()) >= 15 and not want - got


@pytest.mark.parametrize("frequent", [10**6, 50, 0])
def test_lattice_scores_equal_brute_counts(spark, monkeypatch, frequent):
    monkeypatch.setattr(lattice, "FREQUENT", frequent)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()] + EDGES
    found = lattice.lattice_scores(spark.createDataFrame(rows, "doc_id long, text string"), PIECES).collect()
    words = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), b""]
    learn = lambda d: d is None or crc32(str(d).encode()) % 7 != 2
    c = Counter(w for d, t in rows if learn(d) for w in words(t))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for d, t in rows:
        w = words(t)
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        want[d, not learn(d), len(w), sum(c[x] > 0 for x in w), n, round(base, 6)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in found)


def test_licences_equal_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()] + EDGES
    rows += [
        (905, "CC-BY and cc by, cc\nBY-NC!"), (906, "All Rights reserved. all rights  reserved"), (907, "GNU General public LICENSE"), (908, "cc"),
        (909, "words before. Permission is hereby granted, free of charge, to any person obtaining one copy of this software and associated documentation "
              "files (the Software), to deal in the Software without any restriction"),
    ]
    found = licences.licence_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    phrases = {p: label for p, label in licences.PHRASES.items()}
    want = Counter()
    for d, t in rows:
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
        places, labels = [], set()
        for p, label in phrases.items():
            ws = p.encode().split()
            at = [i for i in range(len(w) - len(ws) + 1) if w[i : i + len(ws)] == ws]
            places += at
            labels |= {label} if at else set()
        want[d, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))] += 1
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in found) == want
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1 for r in found)
    assert {r["doc_id"]: r["labels"] for r in found}[909] == "mit"


def plain_labels(text):
    """Labels and score of a text: every k-gram against every template position, one by one."""
    m = licences
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    labels, score = set(), 0.0
    for t, label in m.all_templates():
        k = min(m.GRAM, len(t))
        places = {}
        for at in range(len(t) - k + 1):
            places.setdefault(tuple(t[at : at + k]), []).append(at)
        diagonals = {}
        for pos in range(len(w) - k + 1):
            for at in places.get(tuple(w[pos : pos + k]), []):
                diagonals.setdefault(pos - at, []).append((pos, at))
        votes = max(1, min(m.MOST_VOTES, len(t) // m.WORDS_A_VOTE))
        spans, last = [], None
        for d in sorted(d for d, hits in diagonals.items() if len(hits) >= votes):
            if last is None or d - last > m.NEIGHBOUR or len(t) == k:
                spans.append([])
            spans[-1] += diagonals[d]
            last = d
        for hits in spans:
            cover = len({at + j for _, at in hits for j in range(k)}) / len(t)
            first, end = min(p for p, _ in hits), max(p for p, _ in hits)
            if cover >= m.COVER and end - first + k <= len(t) * 1.5 + 2:
                labels.add(label)
                score = max(score, cover)
    return ",".join(sorted(labels)), round(score, 9)


def test_licence_labels_equal_brute_force(spark):
    draw = random.Random(2)
    texts = licences.licence_texts()
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()] + EDGES
    wanted = {}
    for k, label in enumerate(["gpl-3", "apache-2.0", "mit", "isc", "bsd-3", "mpl-2.0", "lgpl-2.1", "cc0-1.0"]):
        words = texts[label].split()
        for _ in range(len(words) // 40):  # edits: replace, drop, add
            at = draw.randrange(len(words))
            words[at : at + 1] = draw.choice([["zzz"], [], [words[at], "qqq"]])
        rows.append((2**60 + 2 * k + 1, f"{rows[k][1]} {' '.join(words)} {rows[k + 1][1]}"))
        rows.append((3000 + k, " ".join(words[: len(words) // 2])))
        wanted[2**60 + 2 * k + 1] = label
    found = licences.licence_report(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)).collect()
    want = Counter((d, *plain_labels(t)) for d, t in rows)
    assert Counter((r["doc_id"], r["labels"], round(r["score"], 9)) for r in found) == want
    assert all(wanted[r["doc_id"]] in r["labels"].split(",") for r in found if r["doc_id"] in wanted)
    halves = {r["doc_id"]: r["labels"] for r in found if 3000 <= (r["doc_id"] or 0) < 3008}
    # Half a text is not the licence, unless its sentence, a template of its own, is in that half.
    own = set(licences.TEMPLATES.values()) | {"bsd-3"}
    assert not any(label in halves[3000 + k].split(",") for k, label in enumerate(wanted.values()) if label not in own)


def test_decontamination_finds_copies_and_edits_alone(spark):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()][:12]
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    draw = random.Random(4)
    planted = {}
    for k, (i, text) in enumerate(items):
        words = text.split()
        for _ in range(len(words) // 8):  # edits: replace, drop, add
            at = draw.randrange(len(words))
            words[at : at + 1] = draw.choice([["zzz"], [], [words[at], "qqq"]])
        host = docs[k][1].split()
        planted[2000 + k] = i
        docs.append((2000 + k, " ".join(host[:40] + words + host[40:])))
    planted[2100] = 76
    items.append((76, "Éai éonleeau pour an éonqueê aivi ai, éenaitreoiaux éoiré anvitre èenreré èéèquepaè le"))
    docs.append((2100, f"{docs[0][1]} {items[-1][1].upper()} {docs[1][1]}"))
    docs += EDGES
    bench = spark.createDataFrame([*items, (77, None), (78, ""), (None, "a b c")], "item_id long, text string")
    rows = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    found = {(r["doc_id"], r["item_id"]) for r in rows}
    assert {(d, i) for d, i in planted.items()} <= found and len(rows) == len(found)
    grams = lambda t, n=5: {tuple(w[k : k + n]) for w in [decontamination.plain_words(t)] for k in range(len(w) - n + 1)}
    texts, tests = {d: t for d, t in docs if d is not None}, dict(items)
    for d, i in found:  # what is found does share much
        assert len(grams(texts[d], 2) & grams(tests[i], 2)) >= 0.3 * len(grams(tests[i], 2))
    for d, t in texts.items():  # whole copies are all found
        for i, text in tests.items():
            if len(grams(t) & grams(text)) >= 0.9 * len(grams(text)):
                assert (d, i) in found
    assert Counter((r["doc_id"], r["item_id"], round(r["score"], 6), r["first_word"], r["last_word"], r["n_seeds"]) for r in rows) == plain_copies(docs, items)


def plain_copies(docs, items):
    """Documents and items one by one: counted trigrams, seeds, diagonals, alignment."""
    m, words = decontamination, decontamination.plain_words
    tests = {i: w for i, t in items if len(w := words(t)) >= 3}
    known = {x for w in tests.values() for x in w}
    all_words = [words(t) for _, t in docs]
    c1 = Counter(x for w in all_words for x in w)
    c3 = Counter(tuple(w[k : k + 3]) for w in all_words for k in range(len(w) - 2))
    total = sum(c1.values())
    out = Counter()
    for i, w in tests.items():
        weight = np.array([-math.log2((c1[x] + 1) / (total + len(known) + 1)) for x in w])
        bits = [-math.log2((c3[tuple(w[k : k + 3])] + 1) / (total + 1)) for k in range(len(w) - 2)]
        seeds = {}
        assert all(c3[tuple(w[k : k + 3])] <= m.RARE_COUNT for k in range(len(bits)))  # ties of hashes play no part here
        for k in range(len(bits)):
            if bits[k] >= m.RARE_BITS or c3[tuple(w[k : k + 3])] <= m.RARE_COUNT:
                seeds.setdefault(tuple(w[k : k + 3]), []).append(k)
        for d, own in {d: w for (d, _), w in zip(docs, all_words) if d is not None}.items():
            hits = sorted({(k - at, at) for k in range(len(own) - 2) for at in seeds.get(tuple(own[k : k + 3]), [])})
            groups = []
            for g, at in hits:
                if not groups or g - groups[-1][-1][0] > len(w) // 2 + 4:
                    groups.append([])
                groups[-1].append((g, at))
            best = None
            for g in groups:
                n = len({at for _, at in g})
                if n < min(2, len(w) - 2):
                    continue
                lo, hi = max(0, g[0][0] - len(w) // 2 - 6), g[-1][0] + len(w) + len(w) // 2 + 6
                code = {x: k for k, x in enumerate({*w, *own})}
                score, first, end = m.smith_waterman(np.array([code[x] for x in w]), np.array([code[x] for x in own[lo:hi]]), weight)
                if score >= m.LEAST_BITS and (score >= m.THRESHOLD * weight.sum() or score >= m.EXCERPT_WORDS * weight.mean()):
                    row = (score / weight.sum(), lo + first, lo + end - 1, n)
                    best = max(best, row) if best else row
            if best:
                out[d, i, round(best[0], 6), *best[1:]] += 1
    return out


def test_items_copied_everywhere_keep_seeds(spark):
    draw = random.Random(5)
    item = " ".join("".join(draw.choices("abcdefgh", k=4)) for _ in range(40))
    rows = [(k, f"w{k} {item} v{k}") for k in range(200)]
    words = item.split()
    words[::8] = ["zzz"] * len(words[::8])
    rows += [(500, " ".join(words))] + [(600 + k, " ".join(draw.choices(item.split(), k=60))) for k in range(5)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r["doc_id"] for r in decontamination.contaminated(docs, bench).collect()} == {*range(200), 500}


def test_excerpts_short_items_and_rows_without_ids(spark):
    draw = random.Random(12)
    text = lambda n: " ".join("".join(draw.choices("abcdefghij", k=5)) for _ in range(n))
    long_item, plain = text(400), text(60)
    items = [(1, long_item), (2, "yes"), (3, "yes no"), (None, plain), (5, "yes no yes"), (2**60 + 1, plain + " end")]
    excerpt = " ".join(long_item.split()[100:220])
    rows = [
        (10, f"{text(30)} {excerpt} {text(50)}", 1), (11, f"yes {text(40)} no yes no", 2), (None, f"{text(9)} {plain}", 3), (2**60 + 3, f"{plain} end {text(5)}", 4),
        (13, text(5000) + " " + plain + " " + text(5000), 5), (14, None, 6), (15, "", 7), (10, f"{text(3)}", 8), (16, text(80), 9),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest int").coalesce(1)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, bench).collect()}
    assert found == {(10, 1), (2**60 + 3, 2**60 + 1), (13, 2**60 + 1)}
    kept = decontamination.decontaminated(docs, bench)
    assert kept.columns == ["doc_id", "text", "digest"] and sorted(r["digest"] for r in kept.collect()) == [2, 6, 7, 8, 9]


def test_smith_waterman_equals_plain_recursion():
    draw = np.random.default_rng(3)
    for _ in range(20):
        item, passage = draw.integers(0, 5, 9).astype(np.uint64), draw.integers(0, 5, 14).astype(np.uint64)
        weight = draw.random(9) + 0.5
        gap, miss = decontamination.GAP * weight.mean(), decontamination.MISMATCH * weight.mean()
        h = np.zeros((10, 15))
        for a in range(1, 10):
            for b in range(1, 15):
                s = weight[a - 1] if item[a - 1] == passage[b - 1] else miss
                h[a, b] = max(0, h[a - 1, b - 1] + s, h[a - 1, b] - gap, h[a, b - 1] - gap)
        best, lo, hi = decontamination.smith_waterman(item, passage, weight)
        assert math.isclose(best, h.max(), abs_tol=1e-9) and 0 <= lo <= hi <= 14


def test_quality_learns_from_documents_that_are_not_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_quality(docs, labels)
    extra = docs.select("doc_id", "text").unionByName(spark.createDataFrame(EDGES, "doc_id long, text string"))
    found = quality.score_quality(extra, model)
    assert found.count() == docs.count() + len(EDGES)
    rows = found.join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found.collect())
    assert quality.score_quality(docs, quality.fit_quality(docs, labels.limit(0))).where("score <> 0.5").count() == 0


def test_quality_learns_from_every_passage(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality.AttentionScorer, "fit", lambda self, x, bags, labels: seen.append((x, bags, labels)) or self)
    texts = {i: "A plain sentence. " * (10 + 1800 * (i % 2)) + "#@!% " * (400 * (i % 2)) for i in range(12)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    quality.fit_quality(docs, docs.selectExpr("doc_id", "1 - doc_id % 2 as quality"))
    known = [i for i in sorted(texts) if crc32(str(i).encode()) % 5]
    x, bags = quality.encode([texts[i] for i in known])
    assert max(bags) > 80
    ((got, got_bags, labels),) = seen
    assert list(got_bags) == list(bags) and np.allclose(got, x) and list(labels) == [1.0 - i % 2 for i in known]


def plain_features(text):
    """Features of a text's passages, one byte at a time."""
    raw, size = (text or "").encode(), quality.PASSAGE
    classes = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r\x0b\x0c", b".", b",;:", b"!?", b"'\"()-"]

    def kind(c):
        if c >= 128:
            return 9
        return next((k for k, members in enumerate(classes) if c in members), 10 if c < 9 or 14 <= c < 32 else 11)

    rows, seen = [], set()
    for at in range(0, max(1, len(raw)), size):
        part = raw[at : at + size]
        row = [0.0] * quality.WIDTH
        for a, b in zip(part, part[1:]):
            row[12 * kind(a) + kind(b)] += 1 / len(part)
        own = [part[k : k + 8] for k in range(len(part) - 7)]
        row[-4], row[-1] = len(part) / size, math.log1p(len(raw)) / 12
        if own:
            row[-3] = sum(r in own[:k] for k, r in enumerate(own)) / len(own)
            row[-2] = sum(r in own[:k] or r in seen for k, r in enumerate(own)) / len(own)
        seen |= set(own)
        rows.append(row)
    return rows


def plain_score(model, rows):
    """The forward pass of one bag in scalars."""
    p, dot = model.p, lambda x, w: [sum(a * b for a, b in zip(x, col)) for col in zip(*w)]
    sig = lambda v: 1 / (1 + math.exp(-v))
    hidden, weights = [], []
    for r in rows:
        s = [min(8.0, max(-8.0, (a - m) / sd)) for a, m, sd in zip(r, model.mean, model.spread)]
        h = [math.tanh(v + b) for v, b in zip(dot(s, p["W"]), p["b"])]
        gate = [math.tanh(t) * sig(g) for t, g in zip(dot(h, p["V"]), dot(h, p["U"]))]
        weights.append(math.exp(dot(gate, p["w"])[0]))
        hidden.append(h)
    z = [sum(w * h[k] for w, h in zip(weights, hidden)) / sum(weights) for k in range(len(hidden[0]))]
    return sig(dot(z, p["c"])[0] + p["d"][0])


def test_quality_scores_equal_a_plain_forward_pass(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_quality(docs, labels)
    rows = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").limit(25).collect()] + EDGES + [(2**60 + 1, "A. " * 400), (2**60 + 3, "é" * 1000)]
    want = Counter((d, round(plain_score(model, plain_features(t)), 6)) for d, t in rows)
    for stretch in (quality.STRETCH, 2 * quality.PASSAGE):  # long texts are encoded in stretches with one result
        monkeypatch.setattr(quality, "STRETCH", stretch)
        found = quality.score_quality(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), model).collect()
        assert Counter((r["doc_id"], round(r["score"], 6)) for r in found) == want
        if stretch < 1000:
            x, bags = quality.encode([t for _, t in rows])
            assert np.allclose(x, np.concatenate([plain_features(t) for _, t in rows]), atol=1e-5)


def test_quality_sample_is_bounded_and_of_whole_documents(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality.AttentionScorer, "fit", lambda self, x, bags, labels: seen.append(list(bags)) or self)
    docs = spark.createDataFrame([(i, "word " * (77 * (1 + i % 3))) for i in range(40)], "doc_id long, text string")
    for documents, passages in ((1000, 1000), (10, 1000), (1000, 12)):
        quality.fit_quality(docs, docs.selectExpr("doc_id", "1 as quality"), documents=documents, passages=passages)
        assert len(seen[-1]) <= documents and sum(seen[-1]) <= passages and set(seen[-1]) <= {2, 3, 4}
    assert sum(seen[2]) > 8 and len(seen[0]) > 25


def test_attention_gradient():
    draw = np.random.default_rng(0)
    bags, labels = np.array([3, 1, 4]), np.array([1.0, 0.0, 1.0])
    x = draw.normal(size=(8, quality.WIDTH))
    m = quality.AttentionScorer()
    loss = lambda: -np.mean(labels * np.log(m.score(x, bags)) + (1 - labels) * np.log(1 - m.score(x, bags)))
    grad = m._gradient(x, bags, labels)
    for k, p in m.p.items():
        at = tuple(draw.integers(0, s) for s in p.shape)
        keep, eps = p[at], 1e-5
        p[at] = keep + eps
        up = loss()
        p[at] = keep - eps
        down = loss()
        p[at] = keep
        assert math.isclose((up - down) / (2 * eps), grad[k][at], rel_tol=1e-3, abs_tol=1e-7)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert lattice.lattice_scores(docs, PIECES).count() == 0
    assert licences.licence_report(docs).count() == 0
    assert decontamination.contaminated(docs, bench).count() == 0
    assert decontamination.contaminated(spark.createDataFrame(EDGES, "doc_id long, text string"), bench).count() == 0
    assert quality.score_quality(docs, None).count() == 0
