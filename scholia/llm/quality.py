"""Document quality by attention-based multiple-instance learning.

Method: a document is a bag of passages of ``PASSAGE`` bytes. Every passage of the
whole text is encoded from the shapes of its characters: how often each of twelve
character classes follows each other one, how evenly the passage is filled, and how
much of it repeats itself or earlier passages. A learned layer turns that into a hidden
vector, gated attention weighs the passages, and a logistic unit scores the weighted
sum. All weights are learned together from document labels by Adam. What is written,
as counts of hashed four-byte runs, was tried too and left out (see the README).

The fit uses a bounded sample of labelled documents, in the order of hashes of their
ids at most ``FIT_DOCUMENTS`` that have at most ``FIT_PASSAGES`` passages together, and
every passage of each; scoring reads every passage of every document. Label, language,
source and id are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.frames import named, positional
from scholia.llm.words import ranges, slices

PASSAGE = 384
#: Bounds of the sample of labelled documents, which are taken whole.
FIT_DOCUMENTS, FIT_PASSAGES = 6_000, 80_000
#: Bytes of a long text that are encoded at a time (whole passages).
STRETCH = 4_096 * PASSAGE
HIDDEN, GATE = 24, 12
THRESHOLD = 0.3
_CLASSES = 12


def _class_of_bytes() -> np.ndarray:
    out = np.full(256, 11, dtype=np.uint8)  # other punctuation
    for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r\x0b\x0c", b".", b",;:", b"!?", b"'\"()-")):
        out[list(chars)] = k
    out[128:] = 9
    out[:9] = 10
    out[14:32] = 10
    return out


_CLASS = _class_of_bytes()
WIDTH = _CLASSES * _CLASSES + 4
_ODD = np.uint64(0x9E3779B97F4A7C15)


def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Passage features of a batch of texts, and the number of passages of each (at least one)."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    if any(len(r) > STRETCH for r in raw):
        parts = [_encode_long(r) if len(r) > STRETCH else _encode([r])[0] for r in raw]
        return np.concatenate(parts), np.array([len(p) for p in parts])
    x, bags, _ = _encode(raw)
    return x, bags


def _encode_long(raw: bytes) -> np.ndarray:
    """Features of one long text, stretch by stretch; the runs seen so far are carried on."""
    seen, parts = np.empty(0, dtype=np.int64), []
    for i in range(0, len(raw), STRETCH):
        x, _, (codes, at, again) = _encode([raw[i : i + STRETCH]])
        again |= np.isin(codes, seen)
        x[:, -2] = np.bincount(at, weights=again, minlength=len(x)) / np.maximum(1, np.bincount(at, minlength=len(x)))
        x[:, -1] = np.log1p(len(raw)) / 12
        parts.append(x)
        seen = np.union1d(seen, codes)
    return np.concatenate(parts)


def _again(key: np.ndarray) -> np.ndarray:
    """Whether a key stood before."""
    order = np.argsort(key, kind="stable")
    out = np.zeros(len(key), dtype=bool)
    out[order[1:]] = key[order[1:]] == key[order[:-1]]
    return out


def _encode(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Features, passages of each text, and of each eight-byte run its code, passage and whether its text had it before."""
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    bags = np.maximum(1, -(-sizes // PASSAGE))
    first = np.cumsum(bags) - bags
    x = np.zeros((int(bags.sum()), WIDTH), dtype=np.float32)
    none = np.empty(0, dtype=np.int64)
    runs = (none, none, none.astype(bool))
    if sizes.sum():
        whole = np.frombuffer(b"".join(raw), dtype=np.uint8)
        kind = _CLASS[whole]
        passage = np.repeat(first.astype(np.int32), sizes) + (ranges(sizes) // PASSAGE).astype(np.int32)
        filled = np.bincount(passage, minlength=len(x)).astype(np.float32)
        cell = passage[:-1] * np.int64(_CLASSES**2) + (kind[:-1] * np.uint8(_CLASSES) + kind[1:])
        counts = np.bincount(cell[passage[:-1] == passage[1:]], minlength=len(x) * _CLASSES**2)
        x[:, : _CLASSES**2] = counts.reshape(len(x), -1)
        x[:, : _CLASSES**2] /= np.maximum(filled, 1)[:, None]
        x[:, -4] = filled / PASSAGE
        # Eight-byte runs that stand before in the passage, or in the document.
        if len(whole) >= 8:
            run = np.lib.stride_tricks.sliding_window_view(whole, 8).copy().view("<u8").ravel() * _ODD
            inside = passage[: len(run)] == passage[7:]
            at = passage[: len(run)][inside]
            code = (run[inside] >> np.uint64(24)).astype(np.int64)
            document = np.repeat(np.arange(len(raw)), sizes)[: len(run)][inside]
            for column, group in ((-3, at.astype(np.int64)), (-2, document)):
                again = _again((group << 40) ^ code)
                x[:, column] = np.bincount(at, weights=again, minlength=len(x)) / np.maximum(1, np.bincount(at, minlength=len(x)))
            runs = (code, at, again)
    x[:, -1] = np.repeat(np.log1p(sizes) / 12, bags)
    return x, bags, runs


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class AttentionScorer:
    """Gated attention over encoded passages; arrays only, so it travels in a closure."""

    def __init__(self, seed: int = 3):
        draw = np.random.default_rng(seed)
        scale = lambda *s: draw.normal(0, 1 / np.sqrt(s[0]), s)
        self.mean, self.spread = np.zeros(WIDTH), np.ones(WIDTH)
        self.p = {"W": scale(WIDTH, HIDDEN), "b": np.zeros(HIDDEN), "V": scale(HIDDEN, GATE), "U": scale(HIDDEN, GATE), "w": scale(GATE, 1), "c": scale(HIDDEN, 1), "d": np.zeros(1)}

    def _forward(self, x: np.ndarray, bags: np.ndarray) -> dict:
        p, first = self.p, np.cumsum(bags) - bags
        s = np.clip((x - self.mean) / self.spread, -8, 8)
        h = np.tanh(s @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["w"][:, 0]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), bags))
        a = e / np.repeat(np.add.reduceat(e, first), bags)
        z = np.add.reduceat(a[:, None] * h, first)
        return {"s": s, "h": h, "t": t, "g": g, "a": a, "z": z, "y": _sigmoid(z @ p["c"][:, 0] + p["d"])}

    def score(self, x: np.ndarray, bags: np.ndarray) -> np.ndarray:
        """Chance of label 1 of each bag."""
        return self._forward(x, bags)["y"]

    def fit(self, x: np.ndarray, bags: np.ndarray, labels: np.ndarray, epochs: int = 25, rate: float = 0.01, batch: int = 64, decay: float = 1e-4, seed: int = 5) -> AttentionScorer:
        draw = np.random.default_rng(seed)
        self.mean, self.spread = x.mean(axis=0, dtype=np.float64), x.std(axis=0, dtype=np.float64) + 0.01
        first = np.cumsum(bags) - bags
        share = np.clip(labels.mean(), 0.01, 0.99)
        self.p["d"][:] = np.log(share / (1 - share))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = draw.permutation(len(bags))
            for i in range(0, len(order), batch):
                at = order[i : i + batch]
                rows = np.concatenate([np.arange(first[k], first[k] + bags[k]) for k in at])
                grad = self._gradient(x[rows].astype(np.float64), bags[at], labels[at])
                step += 1
                pace = rate * (1 - epoch / epochs) + 1e-4
                for k, g in grad.items():
                    g = g + decay * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v2[k] = 0.999 * v2[k] + 0.001 * g * g
                    self.p[k] -= pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradient(self, x: np.ndarray, bags: np.ndarray, labels: np.ndarray) -> dict:
        p, f = self.p, self._forward(x, bags)
        first = np.cumsum(bags) - bags
        dy = (f["y"] - labels) / len(labels)
        dz = np.repeat(dy[:, None] * p["c"][:, 0], bags, axis=0)
        da = (dz * f["h"]).sum(axis=1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, first), bags))
        gate = f["t"] * f["g"]
        dgate = de[:, None] * p["w"][:, 0]
        dt, dg = dgate * f["g"] * (1 - f["t"] ** 2), dgate * f["t"] * f["g"] * (1 - f["g"])
        dh = f["a"][:, None] * dz + dt @ p["V"].T + dg @ p["U"].T
        dpre = dh * (1 - f["h"] ** 2)
        return {"W": f["s"].T @ dpre, "b": dpre.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (gate * de[:, None]).sum(axis=0)[:, None], "c": f["z"].T @ dy[:, None], "d": np.array([dy.sum()])}


def held_out(id_col: str = "doc_id"):
    """Documents that labels are never learned from: checksum of the id as text, modulo 5, is 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", documents: int = FIT_DOCUMENTS, passages: int = FIT_PASSAGES) -> AttentionScorer | None:
    """Learn from labelled documents that are not held out; None if there are none.

    A document with several labels counts with the largest; null labels and null ids do
    not count; a repeated document is learned from once.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), label_col)
    known = known.where(~held_out()).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("label"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = known.join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents)
    sizes = texts.join(F.broadcast(some), "doc_id").groupBy("doc_id", "label").agg(F.max(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size"))
    chosen, held = {}, 0
    for r in sizes.orderBy(F.xxhash64("doc_id"), "doc_id").collect():  # at most ``documents`` rows
        bags = max(1, -(-r["size"] // PASSAGE))
        if held + bags <= passages:
            held += bags
            chosen[r["doc_id"]] = r["label"]
    if not chosen:
        return None
    # By Arrow: a list of tuples would start a second Python daemon with workers in the executors.
    columns = {"doc_id": pa.array(list(chosen), pa.int64()), "label": pa.array(list(chosen.values()), pa.int32())}
    wanted = docs.sparkSession.createDataFrame(pa.table(columns))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, j in slices(b["text"].tolist()):
                part = b.iloc[i:j]
                x, bags = encode(part["text"].tolist())
                ends = np.cumsum(bags)
                parts = [x[e - n : e].astype("<f4").tobytes() for e, n in zip(ends, bags, strict=True)]
                yield pd.DataFrame({"doc_id": part["doc_id"], "label": part["label"], "x": parts})

    rows = texts.join(F.broadcast(wanted), "doc_id").mapInPandas(run, "doc_id long, label int, x binary").toPandas()
    rows = rows.drop_duplicates("doc_id").sort_values("doc_id")
    parts = [np.frombuffer(r, dtype="<f4").reshape(-1, WIDTH) for r in rows["x"]]
    return AttentionScorer().fit(
        np.concatenate(parts), np.array([len(p) for p in parts]), (rows["label"].to_numpy() > 0).astype(float)
    )


def scored(docs: DataFrame, model: AttentionScorer | None, text_col: str = "text") -> DataFrame:
    """The columns ``c0, c1, ...`` of ``docs``, and ``score``, their text's.

    Only texts go to Python, once, and only scores come back, so that buffers outside the
    heap hold no other column. Without a model, as without labels, every score is 0.5.
    Null and empty texts are one empty passage.
    """
    rows, _, (place,) = positional(docs, text_col)

    @F.arrow_udf("double")
    def score(batch: pa.Array) -> pa.Array:
        texts = batch.to_pylist()
        found = [
            model.score(*encode(texts[i:j])) if model is not None else np.full(j - i, 0.5) for i, j in slices(texts)
        ]
        return pa.array(np.concatenate(found) if found else [], pa.float64())

    return rows.withColumn("score", score(F.col(place).cast("string")))


def score_quality(docs: DataFrame, model: AttentionScorer | None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document.

    Repeated rows are scored alike, documents without an id too; other columns play no
    part; an empty table gives none.
    """
    found = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    found = found.select(F.col("c0").alias("doc_id"), "score")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: AttentionScorer | None, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns as they are, whose score reaches the threshold."""
    kept = scored(docs, model).where(F.col("score") >= threshold)
    return named(kept, docs.columns)
