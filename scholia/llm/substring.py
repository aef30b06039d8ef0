"""Exact removal of word sequences that occur earlier in the corpus.

Method: seed and extend. The anchor of a window of ``WINDOW`` words is the smallest
of its 8-word hashes (winnowing), so equal windows share an anchor wherever they
stand, and about one anchor in seven words is kept. Documents are joined on the
anchors that occur twice. Each shared anchor is extended both ways over all windows
that it stands for, as far as 12 words to either side; equal extensions are settled
as one, and where extensions of an anchor differ, at the ends of a repeat, they are
settled window by window. Neighbouring windows add up to maximal repeats of at least
``WINDOW`` words.

The first occurrence, by document and then by position, stays. Anchors are 64-bit;
windows and extensions are compared by 64 bits more besides their anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.frames import id_long, id_text
from scholia.llm.words import WordHashes, mixed, ngrams, ranges, split
from scholia.plans.durable import durable

WINDOW, SEED_WORDS = 20, 8
#: A run's start and length share a long.
_SHIFT = 31


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each ``n`` consecutive values."""
    width = 1
    while 2 * width <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    rest = n - width
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def runs(words: np.ndarray, window: int, seed_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Anchor, first window and number of windows of each run, and whether windows may repeat inside a run."""
    if len(words) < window:
        none = np.empty(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, False
    seeds = ngrams(words, seed_words)
    anchor = _sliding_min(seeds, window - seed_words + 1)
    starts = np.concatenate(([0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1))
    lengths = np.diff(np.concatenate((starts, [len(anchor)])))
    return anchor[starts], starts, lengths, len(np.unique(seeds)) < len(seeds)


def _anchors(docs: DataFrame, window: int, seed_words: int) -> DataFrame:
    """One row per run: ``anchor, doc_id, run`` and ``w``, 2 for a document that repeats seeds in itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            anchor, doc_of, at, weight = [], [], [], []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                a, s, n, again = runs(hashes.of(split(text)), window, seed_words)
                if len(a):
                    anchor.append(a.view(np.int64))
                    doc_of.append(np.full(len(a), doc))
                    at.append((s << _SHIFT) + n)
                    weight.append(np.full(len(a), 2 if again else 1, dtype=np.int32))
            if anchor:
                yield pd.DataFrame(
                    {k: np.concatenate(v) for k, v in (("anchor", anchor), ("doc_id", doc_of), ("run", at), ("w", weight))}
                )

    return docs.mapInPandas(run, "anchor long, doc_id long, run long, w int")


def _extended(docs: DataFrame, shared: DataFrame, window: int) -> DataFrame:
    """Each shared run with a hash of all its words, ``extent``, and of each of its windows."""
    schema = "anchor long, extent long, n int, doc_id long, start long, again boolean, windows array<long>"
    wanted = shared.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "run")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, powers = WordHashes(seed=1), _Powers()
        for whole in batches:
            for first in range(0, whole.num_rows, 512):  # bounded memory for long texts
                yield _extend(whole.slice(first, 512), window, hashes, powers)

    return docs.join(wanted, "doc_id").select("doc_id", "text", "runs").mapInArrow(run, schema)


class _Powers:
    """Hashes of stretches of windows, from prefix sums of a polynomial modulo 2**64."""

    BASE = 0xD6E8FEB86659FD93

    def __init__(self):
        self.up, self.down = self._table(1024)

    def _table(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        def powers(base: int) -> np.ndarray:
            factors = np.full(size, base, dtype=np.uint64)
            factors[0] = 1
            return np.multiply.accumulate(factors)

        return powers(self.BASE), powers(pow(self.BASE, -1, 2**64))

    def extents(self, each: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        if len(each) > len(self.up):
            self.up, self.down = self._table(2 * len(each))
        sums = np.zeros(len(each) + 1, dtype=np.uint64)
        np.cumsum(each * self.up[: len(each)], out=sums[1:])
        return mixed((sums[start + n] - sums[start]) * self.down[start] + n.astype(np.uint64))


def _extend(batch: pa.RecordBatch, window: int, hashes: WordHashes, powers: _Powers) -> pa.RecordBatch:
    """The runs of some documents with their extents and windows."""
    listed = batch.column("runs")
    cuts = listed.offsets.to_numpy() - listed.offsets[0].as_py()
    anchor, packed = (listed.flatten().field(k).to_numpy() for k in (0, 1))
    start, n = packed >> _SHIFT, packed & (2**_SHIFT - 1)
    extents, repeated, values = [], [], []
    for k, text in enumerate(batch.column("text")):
        each = ngrams(hashes.of(split(text.as_py())), window, salt=2)
        s, m = start[cuts[k] : cuts[k + 1]], n[cuts[k] : cuts[k + 1]]
        own = each[np.repeat(s, m) + ranges(m)]
        values.append(own)
        extents.append(powers.extents(each, s, m))
        again = np.zeros(len(s), dtype=bool)
        if len(np.unique(each)) < len(each):
            again = np.array([len(np.unique(p)) < len(p) for p in np.split(own, np.cumsum(m)[:-1])])
        repeated.append(again)
    windows = pa.ListArray.from_arrays(
        pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(np.concatenate(values).view(np.int64))
    )
    docs_of = np.repeat(batch.column("doc_id").to_numpy(), np.diff(cuts))
    columns = [anchor, np.concatenate(extents).view(np.int64), n.astype(np.int32), docs_of, start, np.concatenate(repeated)]
    return pa.RecordBatch.from_arrays(
        [*map(pa.array, columns), windows], ["anchor", "extent", "n", "doc_id", "start", "again", "windows"]
    )


def repeats(docs: DataFrame, window: int = WINDOW, seed_words: int = SEED_WORDS) -> DataFrame:
    """``doc_id, start, n``: ``n`` windows from word ``start`` on that occur earlier in the corpus.

    Documents without an id have no place in the order and are left out.
    """
    docs = docs.where("doc_id is not null")
    anchors = _anchors(docs, window, seed_words)
    twice = durable(anchors.groupBy("anchor").agg(F.sum("w").alias("w")).where("w > 1").select("anchor"), "anchors")
    shared = anchors.join(twice, "anchor", "left_semi").select("doc_id", "anchor", "run")
    found = durable(_extended(docs, shared, window), "runs")
    place = F.struct("doc_id", "start")
    firsts = durable(
        found.groupBy("anchor", "extent", "n").agg(F.min(place).alias("first"), F.max("again").alias("again")), "firsts"
    )
    # An anchor with one extension, without repeats inside, is settled by that.
    unsettled = durable(
        firsts.groupBy("anchor").agg(F.count("*").alias("c"), F.max("again").alias("g")).where("c > 1 or g").select("anchor"),
        "unsettled",
    )
    ranked = found.join(firsts.select("anchor", "extent", "n", "first"), ["anchor", "extent", "n"])
    later = ranked.where(place != F.col("first")).select("doc_id", "start", F.col("n").cast("long").alias("n"))
    windows = (
        ranked.where(place == F.col("first"))
        .join(unsettled, "anchor", "left_semi")
        .select("anchor", "doc_id", "start", F.posexplode("windows").alias("k", "hash"))
        .select("anchor", "hash", "doc_id", (F.col("start") + F.col("k")).alias("start"))
    )
    windows = durable(windows, "windows")
    lowest = windows.groupBy("anchor", "hash").agg(F.min(place).alias("first"), F.count("*").alias("c")).where("c > 1")
    lowest = durable(lowest.drop("c"), "lowest")
    single = (
        windows.join(lowest, ["anchor", "hash"])
        .where(place != F.col("first"))
        .select("doc_id", "start", F.lit(1).cast("long").alias("n"))
    )
    return later.unionByName(single)


def without_repeats(docs: DataFrame, window: int = WINDOW, seed_words: int = SEED_WORDS, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every document, and ``kept_text`` on request.

    Words covered by a window that occurs earlier are removed; windows are judged on
    the input. Null and empty texts have no words. A repeated row is the same
    document, so it removes nothing from its copy; documents without an id neither
    remove words nor lose any; an empty table gives none; other columns play no part,
    whatever their names.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marks = durable(
        repeats(docs, window, seed_words)
        .groupBy("doc_id")
        .agg(F.collect_set(F.struct("start", "n")).alias("marks")),
        "marks",
    )
    schema = "doc_id string, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text, found in zip(batch["doc_id"], batch["text"], batch["marks"], strict=True):
                words = split(text)
                kept = words
                if found is not None:
                    step = np.zeros(len(words) + 1, dtype=np.int64)
                    for m in found:
                        step[m["start"]] += 1
                        step[m["start"] + m["n"] + window - 1] -= 1
                    stays = np.cumsum(step)[:-1] == 0
                    kept = [w for w, s in zip(words, stays, strict=True) if s]
                whole = b" ".join(kept)
                row = (doc, len(words), len(words) - len(kept), hashlib.sha256(whole).hexdigest())
                rows.append((*row, whole.decode("utf-8", "surrogatepass")) if keep_text else row)
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: 4 + keep_text]
            yield pd.DataFrame(rows, columns=names)

    whole = docs.join(marks, "doc_id", "left").withColumn("doc_id", id_text("doc_id"))
    return whole.mapInPandas(run, schema).withColumn("doc_id", id_long("doc_id"))
