"""Benchmark decontamination by rare seeds and local alignment.

Method: test items are cut into word trigrams, which are counted in the whole corpus;
the rare ones are seeds, and so are an item's rarest. Training passages are joined to
items on seeds: a passage that shares at least two seeds of an item about one diagonal
is aligned with the item by Smith-Waterman over words, each word weighing its surprisal
in the corpus, so that edited and paraphrased copies score by what they keep and chance
runs of common words score little.

A passage is a copy if it keeps half of the item's weight, or, of a long item, as much
as ``EXCERPT_WORDS`` words of mean weight. Either way it must hold ``LEAST_BITS`` bits:
an item of a word or two, which any text may hold by chance, is never reported.

The benchmark is a table and may be large. Documents see it only through bitmaps of a
bounded size, which tell most words and trigrams that do not matter; the joins that
follow are exact. Texts are told by a digest, so that copies are aligned once, and only
texts with candidates are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scholia.llm.frames import positional
from scholia.llm.words import WordHashes, alphanumeric_words, ngrams, slices
from scholia.plans.durable import durable

SEED_WORDS = 3
#: A trigram is rare from this surprisal in bits on, or if it occurs this often at most.
RARE_BITS, RARE_COUNT = 18.0, 32
#: Rarest trigrams that are seeds in every item, however common; among equals a hash decides, so that they spread.
LEAST_SEEDS = 16
#: Share of an item's own weight from which a passage is a copy.
THRESHOLD = 0.5
#: Words of mean weight that an excerpt must keep to be a copy, and bits that any copy must hold.
EXCERPT_WORDS, LEAST_BITS = 50, 40.0
MISMATCH, GAP = -0.5, 0.5
#: Least and most bits of a bitmap, as powers of two: at most 16 MB.
BITMAP = (16, 27)
#: Words and trigrams that a task counts before it passes them on.
COUNTED = 250_000


def plain_words(text: str | None) -> list[bytes]:
    """Lower-cased words of ASCII letters, digits and non-ASCII characters; copies in capitals have the same words."""
    return alphanumeric_words(text.lower()) if text else []


def smith_waterman(item: np.ndarray, passage: np.ndarray, weight: np.ndarray) -> tuple[float, int, int]:
    """Best local score of ``item`` in ``passage``, and the passage words from and up to which it lies.

    Equal words score the item word's ``weight``, others ``MISMATCH`` and gaps ``GAP``
    times the mean weight.
    """
    mean = float(weight.mean())
    gap, miss = GAP * mean, MISMATCH * mean
    n = len(passage)
    slope = gap * np.arange(n + 1)
    above = np.zeros(n + 1)
    begin = np.arange(n + 1)
    best, found = 0.0, (0, 0)
    for word, w in zip(item, weight, strict=True):
        diagonal = np.concatenate(([0.0], above[:-1] + np.where(passage == word, w, miss)))
        came = np.concatenate(([0], begin[:-1]))
        up = above - gap
        row = np.maximum(diagonal, up)
        came = np.where(up > diagonal, begin, came)
        fresh = row <= 0
        row = np.where(fresh, 0.0, row)
        came = np.where(fresh, np.arange(n + 1), came)
        lifted = row + slope
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted >= top, np.arange(n + 1), 0))
        above = top - slope
        begin = came[source]
        k = int(above.argmax())
        if above[k] > best:
            best, found = float(above[k]), (int(begin[k]), k)
    return best, *found


class Bitmap:
    """Which 64-bit hashes may be in a set: two bits each, by their lower and upper halves."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def places(self, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Byte and bit of each probe."""
        mask = np.uint64(8 * len(self.bits) - 1)
        for half in (hashes, hashes >> np.uint64(32)):
            at = half & mask
            yield (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        for byte, bit in self.places(hashes):
            np.bitwise_or.at(self.bits, byte, bit)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        (byte, bit), second = self.places(hashes)
        found = self.bits[byte] & bit > 0
        some = np.flatnonzero(found)  # few are left for the second probe
        found[some] = self.bits[second[0][some]] & second[1][some] > 0
        return found


def bitmap(hashes: DataFrame, column: str) -> Bitmap:
    """The bitmap of a column of hashes: each task sets bits of its own, and the driver joins them one by one."""
    n = hashes.count()
    power = int(min(BITMAP[1], max(BITMAP[0], np.ceil(np.log2(64 * n + 1)))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, some = Bitmap(np.zeros(2 ** (power - 3), dtype=np.uint8)), False
        for b in batches:
            own.add(b["h"].to_numpy().view(np.uint64))
            some = some or len(b) > 0
        if some:
            yield pd.DataFrame({"bits": [own.bits.tobytes()]})

    whole = np.zeros(2 ** (power - 3), dtype=np.uint8)
    for r in hashes.select(F.col(column).alias("h")).coalesce(16).mapInPandas(run, "bits binary").toLocalIterator():
        whole |= np.frombuffer(r["bits"], dtype=np.uint8)
    return Bitmap(whole)


def _texts_of(docs: DataFrame, digests: DataFrame) -> DataFrame:
    """``digest, text`` once for each wanted digest: most others are told by a bitmap, and copies meet before the shuffle."""
    wanted = bitmap(digests.select(F.xxhash64("digest").alias("h")), "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(wanted.of(b.column("h").to_numpy().view(np.uint64)))).drop_columns(["h"])

    told = docs.where("digest is not null").select("digest", "text", F.xxhash64("digest").alias("h"))
    some = told.mapInArrow(run, "digest binary, text string")
    return some.groupBy("digest").agg(F.max("text").alias("text")).join(digests, "digest", "left_semi")


def _items(benchmark: DataFrame) -> DataFrame:
    """``key, item_id, words``: items of at least a trigram with hashes of their words; null ids are items too."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batches:
            words = [hashes.of(plain_words(t)).view(np.int64) for t in b["text"]]
            out = pd.DataFrame({"key": b["key"], "words": words})
            yield out[[len(w) >= SEED_WORDS for w in words]]

    rows = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = durable(rows.distinct().withColumn("key", F.monotonically_increasing_id()), "benchmark")
    return durable(rows.select("key", "text").mapInPandas(run, "key long, words array<long>").join(rows.select("key", "item_id"), "key"), "items")


def _grams(items: DataFrame) -> DataFrame:
    """``key, gram, at`` of all trigrams of the items."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, words in zip(b["key"], b["words"], strict=True):
                grams = ngrams(np.asarray(words, dtype=np.int64).view(np.uint64), SEED_WORDS)
                yield pd.DataFrame({"key": key, "gram": grams.view(np.int64), "at": np.arange(len(grams))})

    return items.select("key", "words").mapInPandas(run, "key long, gram long, at int")


def _corpus_counts(docs: DataFrame, words: Bitmap, grams: Bitmap) -> DataFrame:
    """``gram, h, n``: how often words and trigrams that may be the benchmark's occur; the number of all words has no hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, total, held = WordHashes(), 0, {False: [], True: []}

        def out() -> pd.DataFrame:
            parts = []
            for kind, lists in held.items():
                if lists:
                    found, n = np.unique(np.concatenate(lists), return_counts=True)
                    parts.append(pd.DataFrame({"gram": kind, "h": found.view(np.int64), "n": n}))
                lists.clear()
            return pd.concat(parts) if parts else pd.DataFrame({"gram": [], "h": [], "n": []}).astype({"gram": bool, "h": np.int64, "n": np.int64})

        size = 0
        for b in batches:
            texts = b["text"].tolist()
            for i, j in slices(texts):
                found = [hashes.of(plain_words(t)) for t in texts[i:j]]
                each = np.concatenate(found)
                total += len(each)
                three = np.concatenate([ngrams(w, SEED_WORDS) for w in found])
                for kind, values, which in ((False, each, words), (True, three, grams)):
                    some = values[which.of(values)]
                    held[kind].append(some)
                    size += len(some)
            if size > 8 * COUNTED:
                yield out()
                size = 0
        yield out()
        yield pd.DataFrame({"gram": [False], "h": [None], "n": [total]})

    return docs.select("text").mapInPandas(run, "gram boolean, h long, n long").groupBy("gram", "h").agg(F.sum("n").alias("n"))


def _seed_hits(docs: DataFrame, seeds: Bitmap) -> DataFrame:
    """``digest, gram, pos``: where a text may hold a seed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batches:
            found = [[], [], []]
            for digest, text in zip(b["digest"], b["text"], strict=True):
                grams = ngrams(hashes.of(plain_words(text)), SEED_WORDS)
                pos = np.flatnonzero(seeds.of(grams))
                if len(pos):
                    for column, values in zip(found, ([digest] * len(pos), grams[pos].view(np.int64), pos), strict=True):
                        column.append(values)
            if found[0]:
                yield pd.DataFrame({"digest": [d for ds in found[0] for d in ds], "gram": np.concatenate(found[1]), "pos": np.concatenate(found[2])})

    return docs.select("digest", "text").mapInPandas(run, "digest binary, gram long, pos int")


def _candidates(hits: DataFrame, seeds: DataFrame, sizes: DataFrame) -> DataFrame:
    """``digest, key, lo, hi, n_seeds``: passages with two seeds of an item about one diagonal."""
    met = hits.join(seeds, "gram").select("digest", "key", "at", (F.col("pos") - F.col("at")).alias("diagonal")).distinct().join(sizes, "key")
    along = Window.partitionBy("digest", "key").orderBy("diagonal", "at")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > F.floor(F.col("size") / 2) + 4, F.lit(True))
    groups = met.withColumn("apart", apart.cast("int")).withColumn("span", F.sum("apart").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    margin = F.floor(F.col("size") / 2) + 6
    spans = groups.groupBy("digest", "key", "size", "span").agg(
        F.min("diagonal").alias("a"), F.max("diagonal").alias("z"), F.count_distinct("at").alias("n_seeds")
    )
    enough = F.least(F.lit(2), F.col("size") - (SEED_WORDS - 1))
    return spans.where(F.col("n_seeds") >= enough).select(
        "digest", "key", F.greatest(F.lit(0), F.col("a") - margin).cast("int").alias("lo"), (F.col("z") + F.col("size") + margin).cast("int").alias("hi"), "n_seeds"
    )


def _aligned(docs: DataFrame, wanted: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """``digest, key, score, first_word, last_word, n_seeds`` of candidates that are copies."""
    lists = wanted.groupBy("digest").agg(F.collect_list(F.struct("key", "lo", "hi", "n_seeds")).alias("at"))
    texts = _texts_of(docs, durable(wanted.select("digest").distinct(), "wanted"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batches:
            for digest, text, at in zip(b["digest"], b["text"], b["at"], strict=True):
                words = hashes.of(plain_words(text)).view(np.int64)
                rows = [(digest, a["key"], a["lo"], a["n_seeds"], words[a["lo"] : a["hi"]]) for a in at]
                yield pd.DataFrame(rows, columns=["digest", "key", "lo", "n_seeds", "passage"])

    passages = texts.join(lists, "digest").mapInPandas(cut, "digest binary, key long, lo int, n_seeds long, passage array<long>")

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                weight = np.asarray(r.weights)
                best, first, end = smith_waterman(np.asarray(r.words), np.asarray(r.passage), weight)
                share = best / weight.sum()
                if best >= LEAST_BITS and (share >= threshold or best >= EXCERPT_WORDS * weight.mean()):
                    rows.append((r.digest, r.key, share, r.lo + first, r.lo + end - 1, r.n_seeds))
            yield pd.DataFrame(rows, columns=["digest", "key", "score", "first_word", "last_word", "n_seeds"])

    both = durable(passages, "passages").join(items.select("key", "words", "weights"), "key")
    return both.mapInPandas(align, "digest binary, key long, score double, first_word long, last_word long, n_seeds long")


def _copies(docs: DataFrame, benchmark: DataFrame, threshold: float) -> DataFrame:
    """``digest, item_id, score, first_word, last_word, n_seeds`` of the texts ``digest, text`` that copy test items."""
    items = _items(benchmark)
    grams = durable(_grams(items), "grams")
    words = durable(items.select("key", F.posexplode("words").alias("at", "h")), "words")
    own = [durable(d, "own") for d in (words.select("h").distinct(), grams.select(F.col("gram").alias("h")).distinct())]
    counts = durable(_corpus_counts(docs, bitmap(own[0], "h"), bitmap(own[1], "h")), "counts")
    total, vocabulary = counts.where("h is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], own[0].count()
    bits = lambda n, of: -F.log2((F.coalesce(n, F.lit(0)) + 1.0) / float(of))
    weighed = words.join(counts.where("not gram and h is not null").select("h", "n"), "h", "left").select(
        "key", "at", bits(F.col("n"), total + vocabulary + 1).alias("w")
    )
    weights = weighed.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "w"))), lambda e: e["w"]).alias("weights"))
    items = durable(items.join(weights, "key"), "weighed")
    rare = grams.join(counts.where("gram").select(F.col("h").alias("gram"), "n"), "gram", "left").withColumn("bits", bits(F.col("n"), total + 1))
    ranked = rare.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("bits"), F.xxhash64("gram", "at"), "at")))
    seeds = durable(ranked.where((F.col("bits") >= RARE_BITS) | (F.coalesce("n", F.lit(0)) <= RARE_COUNT) | (F.col("rank") <= LEAST_SEEDS)).select("gram", "key", "at"), "seeds")
    hits = durable(_seed_hits(docs, bitmap(seeds.select("gram").distinct(), "gram")), "hits")
    wanted = durable(_candidates(hits, seeds, items.select("key", F.size("words").alias("size"))), "candidates")
    found = _aligned(docs, wanted, items, threshold).join(items.select("key", "item_id"), "key")
    best = found.groupBy("digest", "item_id").agg(F.max(F.struct("score", "first_word", "last_word", "n_seeds")).alias("m"))
    return best.select("digest", "item_id", F.round("m.score", 9).alias("score"), "m.first_word", "m.last_word", "m.n_seeds")


def _told(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``text`` as text and its ``digest``."""
    value = F.col(text).cast("string")
    return docs.withColumn("text", value).withColumn("digest", F.unhex(F.sha2(value, 256)))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, item_id, score, first_word, last_word, n_seeds`` of each document and test item that it copies.

    ``score`` is the alignment's share of the item's own weight; words count from 0.
    Null and empty texts and items match nothing; a repeated document reports its
    matches once; a document or item without an id reports none, as it has no name. Other
    columns play no part; empty tables give none.
    """
    docs = _told(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")), "text")
    found = durable(_copies(docs, benchmark, threshold).where("item_id is not null"), "copies")
    who = docs.where("doc_id is not null").select("doc_id", "digest").join(F.broadcast(found) if found.count() < BROADCAST_ROWS else found, "digest")
    return who.select("doc_id", "item_id", "score", "first_word", "last_word", "n_seeds").distinct()


#: Copies, a hundred bytes each, up to which they travel to the documents; more are joined by a shuffle.
BROADCAST_ROWS = 100_000


def decontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, whole and with all their columns, that copy no test item.

    Documents and items without an id count like all others; repeated documents go or
    stay together; columns may have any names; an empty table gives none.
    """
    rows, names, (place,) = positional(docs, "text")
    told = _told(rows, place)
    gone = durable(_copies(told.select("text", "digest"), benchmark, threshold).select("digest").distinct(), "leaks")
    # A null text has no digest and stays.
    kept = told.join(F.broadcast(gone) if gone.count() < BROADCAST_ROWS else gone, "digest", "left_anti")
    return kept.select(*[F.col(f"c{i}") for i in range(len(names))]).toDF(*names)
