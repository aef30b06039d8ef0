"""Near-duplicate groups by SetSketch registers.

Method: each document's set of word shingles is sketched into registers that hold
truncated logarithms of exponential minima (base ``BASE``, rate ``RATE``, values 0
to ``TOP``). Registers of a union are the larger of two registers, so sketches
merge. Bands of four registers are joined; candidate pairs pass a joint likelihood
estimate of their similarity, and every link is confirmed on the full sets.

Work that a group of copies would square is avoided. Equal sets are one
representative. Members of a band are first paired with its smallest member alone;
pairs with a hopeful estimate make families. In a family every member is first compared
with its lead alone, on full sets, in blocks that hold the lead once. Only where that
leaves a family in parts are the members outside its largest part compared with all
members, again in blocks, whose tasks return a spanning forest, never pairs. Members of
a band in different families are estimated too, and what is hopeful is confirmed pair
by pair; a small band's pairs are joined, a large one's compared in blocks, which is a
choice of plan that tests hold equal.

The chance to miss a link of similarity s is (1 - s^4)^32: at 0.85 under 1e-10, at
0.8 under 1e-7.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm.embeddings import forest
from scholia.llm.frames import id_long, id_text
from scholia.llm.words import WordHashes, lower_split, shingles
from scholia.operators.components import connected_components
from scholia.plans.durable import durable

BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
BASE, RATE, TOP = 1.001, 20.0, 65535
#: Standard errors that an estimate may lie below the threshold.
SLACK = 5.0
#: Members of a family or band in one block.
BLOCK = 512
#: Characters of a family in one block, about.
BLOCK_CHARS = 32_000_000
#: Members of a large band in one block.
BAND_BLOCK = 512
#: Members of a band up to which its pairs are joined, not compared in blocks.
JOINED = 24
_SEED = np.random.default_rng(7)
_MULTIPLY = _SEED.integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _SEED.integers(0, 2**63, REGISTERS, dtype=np.uint64)


def registers(hashes: np.ndarray) -> np.ndarray:
    """Registers of a set of 64-bit hashes (at least one)."""
    low = np.full(REGISTERS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), 1024):
        np.minimum(low, (hashes[i : i + 1024, None] * _MULTIPLY + _ADD).min(axis=0), out=low)
    uniform = (low.astype(np.float64) + 0.5) / 2.0**64
    exponential = -np.log1p(-uniform) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, TOP).astype("<u2")


def estimate(k_u: np.ndarray, k_v: np.ndarray, n_u: np.ndarray, n_v: np.ndarray, steps: int = 24) -> np.ndarray:
    """Joint maximum-likelihood Jaccard similarity of pairs of sketches with known set sizes.

    ``k_u`` and ``k_v`` are (pairs, registers). The likelihood of the numbers of
    larger, smaller and equal registers is concave in the similarity.
    """
    up, down = (k_u > k_v).sum(axis=1), (k_u < k_v).sum(axis=1)
    same = k_u.shape[1] - up - down
    u = n_u / (n_u + n_v)
    v = 1 - u

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def score(j: np.ndarray) -> np.ndarray:
        a, b = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
        return up * np.log(a) + down * np.log(b) + same * np.log(np.maximum(1 - a - b, 1e-12))

    lo, hi = np.zeros_like(u), np.minimum(u / v, v / u)
    golden = (5**0.5 - 1) / 2
    for _ in range(steps):
        a, b = hi - golden * (hi - lo), lo + golden * (hi - lo)
        left = score(a) > score(b)
        hi, lo = np.where(left, b, hi), np.where(left, lo, a)
    return (lo + hi) / 2


def hopeful(k_u: np.ndarray, k_v: np.ndarray, n_u: np.ndarray, n_v: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs that may reach the threshold: by size, which is exact, and by estimate, within ``SLACK``."""
    fits = np.minimum(n_u, n_v) >= threshold * np.maximum(n_u, n_v) - 1e-9
    cut = threshold - SLACK * (threshold * (1 - threshold) / REGISTERS) ** 0.5
    out = np.zeros(len(n_u), dtype=bool)
    at = np.flatnonzero(fits)
    # Registers are equal about as often as the sets are similar; most pairs end here.
    at = at[(k_u[at] == k_v[at]).mean(axis=1) >= cut - 0.04]
    for i in range(0, len(at), 4096):
        k = at[i : i + 4096]
        out[k] = estimate(k_u[k], k_v[k], n_u[k].astype(float), n_v[k].astype(float)) >= cut
    return out


def sketch(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, set_a, set_b, bands``: set size, a 128-bit set fingerprint, and the sketch.

    ``bands`` holds the registers, four to a long. Without words the size is 0 and
    the sketch is null. ``words`` words make a shingle.
    """
    schema = "doc_id string, n_shingles long, set_a long, set_b long, bands array<long>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                found = shingles(hashes.of(lower_split(text)), words)
                if len(found):
                    a, b = found.sum(dtype=np.uint64), (found * (found >> np.uint64(7))).sum(dtype=np.uint64)
                    bands = registers(found).view("<i8")
                    rows.append((doc, len(found), a.astype(np.int64), b.astype(np.int64), bands))
                else:
                    rows.append((doc, 0, 0, 0, None))
            yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    rows = docs.select(id_text(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInPandas(run, schema)
    return rows.withColumn("doc_id", id_long("doc_id"))


def _unpack(bands: pd.Series) -> np.ndarray:
    return np.stack(bands.to_numpy()).astype("<i8").view("<u2").reshape(len(bands), REGISTERS)


def _hopeful_pairs(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """Of pairs ``(x, y)`` of representatives, those that may be similar enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                ok = hopeful(_unpack(b["bx"]), _unpack(b["by"]), b["nx"].to_numpy(), b["ny"].to_numpy(), threshold)
                yield b.loc[ok, ["x", "y"]]

    x = sketches.select(F.col("rep").alias("x"), F.col("n").alias("nx"), F.col("bands").alias("bx"))
    y = sketches.select(F.col("rep").alias("y"), F.col("n").alias("ny"), F.col("bands").alias("by"))
    near = (F.least("nx", "ny") >= F.lit(threshold) * F.greatest("nx", "ny") - F.lit(1e-9))
    return pairs.join(x, "x").join(y, "y").where(near).mapInPandas(run, "x long, y long")


def shared_sizes(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of two lists of hash sets, by products of slices of their incidence matrices."""
    both = left + right
    code = np.unique(np.concatenate(both), return_inverse=True)[1]
    row = np.repeat(np.arange(len(both)), [len(x) for x in both])
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    often = np.bincount(code)[code] > 1
    code, row = np.unique(code[often], return_inverse=True)[1], row[often]
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    for first in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
        lo, hi = np.searchsorted(code, [first, first + 4096])
        hit = np.zeros((len(both), 4096), dtype=np.float32)
        hit[row[lo:hi], code[lo:hi] - first] = 1
        out += hit[: len(left)] @ hit[len(left) :].T
    return out


def _similar(left: list[np.ndarray], right: list[np.ndarray], ratio: Fraction) -> np.ndarray:
    """Which sets are similar enough, exactly."""
    n, m = (np.array([len(x) for x in side], dtype=np.float64) for side in (left, right))
    both = shared_sizes(left, right).astype(np.float64)
    return ratio.denominator * both >= ratio.numerator * (n[:, None] + m[None, :] - both)


def _blocks(rows: Column | None = None) -> Column:
    """Blocks for the rows of a group, or those of them that a condition names, by number and by characters of ``size``."""
    counted = F.lit(True) if rows is None else rows
    by_size = F.sum(F.when(counted, F.col("size")).otherwise(0)) / F.lit(BLOCK_CHARS)
    return F.ceil(F.greatest(F.count_if(counted) / F.lit(BLOCK), by_size)).cast("int")


def _star_links(stars: DataFrame, texts: DataFrame, words: int, ratio: Fraction) -> DataFrame:
    """Of pairs ``(x, y)`` of a lead and a member those that are similar enough; a block holds a lead's text once."""
    sized = stars.join(texts.select(F.col("doc_id").alias("y"), "size"), "y")
    sizes = sized.groupBy("x").agg(_blocks().alias("blocks"))
    dealt = stars.join(sizes, "x").withColumn("block", F.pmod(F.xxhash64("y"), "blocks").cast("int"))
    leads = sizes.select("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("x").alias("doc_id"))
    rows = dealt.select("x", "block", F.col("y").alias("doc_id")).unionByName(leads)
    hashes = WordHashes()

    def compare(b: pd.DataFrame) -> pd.DataFrame:
        sets = [shingles(hashes.of(lower_split(t)), words) for t in b["text"]]
        rep = b["doc_id"].to_numpy()
        lead = int(np.flatnonzero(rep == b["x"].iloc[0])[0])
        both = np.array([np.isin(s, sets[lead], assume_unique=True).sum() for s in sets], dtype=np.int64)
        n = np.array([len(s) for s in sets], dtype=np.int64)
        linked = ratio.denominator * both >= ratio.numerator * (n + n[lead] - both)
        linked[lead] = False
        return pd.DataFrame({"x": rep[lead], "y": rep[linked]}, dtype="int64")

    return rows.join(texts.drop("size"), "doc_id").groupBy("x", "block").applyInPandas(compare, "x long, y long")


def _open_members(families: DataFrame, stars: DataFrame) -> DataFrame:
    """Members ``(node, component, outside)`` of families that links to leads leave in parts; ``outside`` of the largest part."""
    parts = connected_components(stars, "x", "y").select("node", F.col("component").alias("part"))
    placed = durable(families.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node")), "parts")
    sizes = placed.groupBy("component", "part").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("component").agg(F.max_by("part", F.struct("n", -F.col("part"))).alias("main"), F.count("*").alias("parts"))
    left = placed.join(largest.where("parts > 1"), "component")
    return durable(left.select("node", "component", (F.col("part") != F.col("main")).alias("outside")), "open")


def _family_links(members: DataFrame, texts: DataFrame, words: int, ratio: Fraction) -> DataFrame:
    """Links ``(x, y)`` that span what is similar between members ``outside`` and all members of a family."""
    sized = members.join(texts.select(F.col("doc_id").alias("node"), "size"), "node")
    sizes = sized.groupBy("component").agg(_blocks(F.col("outside")).alias("outsides"), _blocks().alias("alls"))
    sized, hashed = members.join(sizes, "component"), F.xxhash64("node")
    columns = [F.col("component").alias("family"), F.col("node").alias("doc_id")]
    left = sized.where("outside").select(
        *columns, F.lit(True).alias("left"),
        F.pmod(hashed, "outsides").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("alls") - 1)).alias("j"),
    )
    right = sized.select(
        *columns, F.lit(False).alias("left"),
        F.explode(F.sequence(F.lit(0), F.col("outsides") - 1)).alias("i"), F.pmod(F.shiftright(hashed, 7), "alls").cast("int").alias("j"),
    )
    hashes = WordHashes()

    def compare(b: pd.DataFrame) -> pd.DataFrame:
        own = {r: shingles(hashes.of(lower_split(t)), words) for r, t in zip(b["doc_id"], b["text"], strict=True)}
        a, z = (b["doc_id"].to_numpy()[b["left"].to_numpy() == side] for side in (True, False))
        if not len(a) or not len(z):
            return pd.DataFrame({"x": [], "y": []}, dtype="int64")
        linked = _similar([own[r] for r in a], [own[r] for r in z], ratio) & (a[:, None] != z[None, :])
        return pd.DataFrame(forest(a, z, linked), columns=["x", "y"], dtype="int64")

    return left.unionByName(right).join(texts.drop("size"), "doc_id").groupBy("family", "i", "j").applyInPandas(compare, "x long, y long")


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, ratio: Fraction) -> DataFrame:
    """Of pairs ``(x, y)`` of documents, those whose full sets are similar enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batches:
            keep = [
                bool(_similar([shingles(hashes.of(lower_split(tx)), words)], [shingles(hashes.of(lower_split(ty)), words)], ratio))
                for tx, ty in zip(b["tx"], b["ty"], strict=True)
            ]
            yield b.loc[np.array(keep, dtype=bool), ["x", "y"]]

    return (
        pairs.join(texts.select(F.col("doc_id").alias("y"), F.col("text").alias("ty")), "y")
        .join(texts.select(F.col("doc_id").alias("x"), F.col("text").alias("tx")), "x")
        .select("x", "y", "tx", "ty")
        .mapInPandas(run, "x long, y long")
    )


def _across(members: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """Hopeful pairs of members ``(key, rep, comp)`` of one band that are in different families."""
    sized = members.groupBy("key").agg(F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    sized = durable(sized.where("lo <> hi").select("key", "m"), "mixed")
    mixed = durable(members.join(sized, "key"), "mixed")
    few = mixed.where(F.col("m") <= JOINED).join(sketches.select("rep", "n"), "rep").select("key", "rep", "comp", "n")
    few = durable(few, "few")
    other = few.select("key", F.col("rep").alias("y"), F.col("comp").alias("comp_y"), F.col("n").alias("ny"))
    joined = (
        few.withColumnRenamed("rep", "x")
        .join(other, "key")
        .where((F.col("x") < F.col("y")) & (F.col("comp") != F.col("comp_y")))
        .where(F.least("n", "ny") >= F.lit(threshold) * F.greatest("n", "ny") - F.lit(1e-9))
        .select("x", "y")
        .distinct()
    )
    joined = _hopeful_pairs(joined, sketches, threshold)
    many = mixed.where(F.col("m") > JOINED).join(sketches, "rep")
    blocks = F.ceil(F.col("m") / F.lit(BAND_BLOCK)).cast("int")
    dealt = (
        many.select("key", "rep", "comp", "n", "bands", blocks.alias("blocks"))
        .withColumn("own", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("i", F.least("own", "other"))
        .withColumn("j", F.greatest("own", "other"))
    )

    def compare(b: pd.DataFrame) -> pd.DataFrame:
        n, comp, rep, own = (b[c].to_numpy() for c in ("n", "comp", "rep", "own"))
        k = _unpack(b["bands"])
        found = []
        left = np.flatnonzero(own == b["i"].iloc[0])
        right = np.flatnonzero(own == b["j"].iloc[0])
        same = b["i"].iloc[0] == b["j"].iloc[0]
        for at, x in enumerate(left):
            y = right[at + 1 :] if same else right
            y = y[comp[y] != comp[x]]
            if len(y):
                ok = hopeful(np.broadcast_to(k[x], (len(y), REGISTERS)), k[y], np.full(len(y), n[x]), n[y], threshold)
                found += [(min(rep[x], r), max(rep[x], r)) for r in rep[y[ok]]]
        return pd.DataFrame(found, columns=["x", "y"], dtype="int64")

    # Blocks are few bytes and much work, so they are dealt widely.
    parts = 4 * int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "key", "i", "j")
    return joined.unionByName(dealt.groupBy("key", "i", "j").applyInPandas(compare, "x long, y long")).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, threshold: Fraction | float = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document.

    Documents are linked when their shingle sets have a Jaccard similarity of at
    least ``threshold``; a component's id is its smallest document, which is kept.
    Null and empty texts have no shingles, are linked with nothing and are kept, and so
    are documents without an id, whose component is null. Rows that repeat an id and a
    text are one document, reported row by row; other columns play no part, whatever
    their names; an empty table gives none.
    """
    ratio = Fraction(threshold).limit_denominator(10_000)
    limit = float(ratio)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketched = durable(sketch(docs, words), "sketches")
    full = sketched.where("n_shingles > 0 and doc_id is not null")
    # Equal sets have equal sketches, so one of them stands for all.
    reps = durable(
        full.groupBy("n_shingles", "set_a", "set_b").agg(
            F.min("doc_id").alias("rep"), F.first("bands").alias("bands")
        ).withColumnRenamed("n_shingles", "n"),
        "representatives",
    )
    keyed = reps.select("rep", F.posexplode("bands").alias("band", "value")).select(
        "rep", F.xxhash64("band", "value").alias("key")
    )
    shared = durable(
        keyed.groupBy("key").agg(F.min("rep").alias("lead"), F.count("*").alias("m")).where("m > 1").select("key", "lead"),
        "bands",
    )
    members = durable(keyed.join(shared, "key"), "members")
    tried = members.where("rep <> lead").select(F.col("lead").alias("x"), F.col("rep").alias("y")).distinct()
    near = durable(_hopeful_pairs(tried, reps, limit), "near")
    families = durable(connected_components(near, "x", "y"), "families")
    placed = members.join(families, F.col("rep") == F.col("node"), "left").select(
        "key", "rep", F.coalesce("component", "rep").alias("comp")
    )
    across = durable(_across(placed, reps.select("rep", "n", "bands"), limit), "across")
    wanted = families.select(F.col("node").alias("doc_id")).union(across.select("x")).union(across.select("y")).distinct()
    # One plan at every size: a merge join, whose sides spill.
    texts = docs.join(durable(wanted, "wanted").hint("merge"), "doc_id", "left_semi")
    texts = durable(texts.groupBy("doc_id").agg(F.max("text").alias("text")).withColumn("size", F.length("text")), "texts")  # a repeated row is one document
    stars = durable(_star_links(near.groupBy("y").agg(F.min("x").alias("x")).select("x", "y"), texts, words, ratio), "stars")
    rest = _family_links(_open_members(families, stars), texts, words, ratio)
    links = durable(stars.unionByName(rest).unionByName(_confirmed(across, texts, words, ratio)), "links")
    whole = durable(connected_components(links, "x", "y"), "components")
    named = reps.join(whole, F.col("rep") == F.col("node"), "left").select(
        F.col("n").alias("n_shingles"), "set_a", "set_b", F.coalesce("component", "rep").alias("component")
    )
    named = durable(named, "named")
    return (
        sketched.select("doc_id", "n_shingles", "set_a", "set_b")
        .join(named, ["n_shingles", "set_a", "set_b"], "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )

