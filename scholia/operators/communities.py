"""Louvain's local moves over packed neighbours, for graphs whose nodes fit a vector (GRF-04, GRF-05).

The edges lie in the shared folder as blocks: nodes, their numbers of neighbours, the
neighbours and the weights, as bytes. The community of each node is a vector that is
sent to every task, so that a round reads the blocks once and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.plans.durable import durable

#: Parts that nodes are dealt to by a hash; rows held before they are dealt out; neighbours of a block, a node's own aside.
PARTS, HELD, BLOCK = 1024, 1 << 20, 1 << 18
DEALT = "part int, a binary, b binary, w binary"
BLOCKS = "ids binary, counts binary, ends binary, w binary"


def packed(dealt: DataFrame) -> DataFrame:
    """Blocks of the rows of each part, with equal pairs summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                held.setdefault(row["part"], []).append([np.frombuffer(row["a"], "i8"), np.frombuffer(row["b"], "i8"), np.frombuffer(row["w"], "f8")])
        for part in list(held):
            a, b, w = map(np.concatenate, zip(*held.pop(part), strict=True))
            order = np.lexsort((b, a))
            a, b, w = a[order], b[order], w[order]
            first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
            a, b, w = a[first], b[first], np.add.reduceat(w, first)
            starts = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
            counts = np.diff(np.append(starts, len(a)))
            at = 0
            while at < len(starts):  # whole nodes
                to = max(at + 1, int(np.searchsorted(starts + counts, starts[at] + BLOCK, "right")))
                rows = slice(starts[at], starts[to - 1] + counts[to - 1])
                yield pa.RecordBatch.from_pylist(
                    [{"ids": a[starts[at:to]].tobytes(), "counts": counts[at:to].astype("i8").tobytes(), "ends": b[rows].tobytes(), "w": w[rows].tobytes()}],
                    pa.schema([(c, pa.binary()) for c in ("ids", "counts", "ends", "w")]),
                )
                at = to

    return durable(dealt.repartition("part").mapInArrow(run, BLOCKS), "louvain")


def dealt_out(df: DataFrame, rows_of, both: bool) -> DataFrame:
    """Rows ``(part, a, b, w)`` of many pairs each; ``rows_of`` gives the pairs of a batch, ``both`` adds them turned round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def deal(pairs: list) -> pa.RecordBatch:
            a, b, w = map(np.concatenate, zip(*pairs, strict=True))
            if both:
                a, b, w = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((w, w))
            part = ((a.astype("u8") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (PARTS - 1).bit_length())).astype("i2")
            order = np.argsort(part, kind="stable")
            a, b, w, part = a[order], b[order], w[order], part[order]
            cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
            rows = [{"part": int(part[i]), "a": a[i:j].tobytes(), "b": b[i:j].tobytes(), "w": w[i:j].tobytes()} for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            return pa.RecordBatch.from_pylist(rows, pa.schema([("part", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("w", pa.binary())]))

        held, n = [], 0
        for batch in batches:
            for pairs in rows_of(batch):
                held.append(pairs)
                n += len(pairs[0])
                if n >= HELD:
                    yield deal(held)
                    held, n = [], 0
        if n:
            yield deal(held)

    return df.mapInArrow(run, DEALT)


def blocks_of(edges: DataFrame, most: int) -> tuple[DataFrame, np.ndarray] | None:
    """Blocks of edges with long ends, both ways, ends as places in the sorted nodes; and these. None where nodes are over ``most``."""

    def plain(batch: pa.RecordBatch) -> Iterator[list]:
        if batch.num_rows:
            yield [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]

    whole = edges.where("src is not null and dst is not null").select(
        F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight")
    )
    named = packed(dealt_out(whole, plain, both=True))
    if (named.agg(F.sum(F.octet_length("ids") / 8)).first()[0] or 0) > most:
        return None
    nodes = np.sort(np.concatenate([np.empty(0, "i8"), *(np.frombuffer(r[0], "i8") for r in named.select("ids").toLocalIterator())]))
    shared = edges.sparkSession.sparkContext.broadcast(nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                ids, counts, ends, w = (np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in enumerate(("i8", "i8", "i8", "f8")))
                # Each node is an end of its own, with the weight of what it holds within: twice, as both ways of its edges.
                at = np.cumsum(counts)
                row = {
                    "ids": np.searchsorted(of, ids).astype("i4").tobytes(), "counts": (counts + 1).astype("i8").tobytes(),
                    "ends": np.searchsorted(of, np.insert(ends, at, ids)).astype("i4").tobytes(), "w": np.insert(w, at, 0.0).tobytes(),
                }
                yield pa.RecordBatch.from_pylist([row], pa.schema([(c, pa.binary()) for c in row]))

    blocks = durable(named.mapInArrow(run, BLOCKS), "louvain")
    shared.destroy()
    return blocks, nodes


def joined_up(blocks: DataFrame, into: np.ndarray) -> DataFrame:
    """Blocks of the graph whose nodes are the communities ``into`` of the nodes; what lies within one is its end of its own."""
    shared = blocks.sparkSession.sparkContext.broadcast(into)

    def summed(batch: pa.RecordBatch) -> Iterator[list]:
        of, n = shared.value, int(shared.value.max()) + 1
        for i in range(batch.num_rows):
            ids, counts, ends, w = (np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in enumerate(("i4", "i8", "i4", "f8")))
            key = np.repeat(of[ids].astype("i8") * n, counts) + of[ends]
            order = np.argsort(key)
            key = key[order]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            yield [key[first] // n, key[first] % n, np.add.reduceat(w[order], first)]

    named = packed(dealt_out(blocks, summed, both=False))

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                row |= {c: np.frombuffer(row[c], "i8").astype("i4").tobytes() for c in ("ids", "ends")}
                yield pa.RecordBatch.from_pylist([row], pa.schema([(c, pa.binary()) for c in row]))

    made = durable(named.mapInArrow(narrow, BLOCKS), "louvain")
    shared.destroy()
    return made


def strengths(blocks: DataFrame, n: int) -> np.ndarray:
    """The weight at each node, its own twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                counts = np.frombuffer(batch.column(1)[i].as_py(), "i8")
                k = np.add.reduceat(np.frombuffer(batch.column(2)[i].as_py(), "f8"), np.cumsum(counts) - counts)
                yield pa.RecordBatch.from_pylist([{"ids": batch.column(0)[i].as_py(), "k": k.tobytes()}], pa.schema([("ids", pa.binary()), ("k", pa.binary())]))

    k = np.zeros(n)
    for r in blocks.select("ids", "counts", "w").mapInArrow(run, "ids binary, k binary").collect():
        k[np.frombuffer(r["ids"], "i4")] = np.frombuffer(r["k"], "f8")
    return k


def wanted(blocks: DataFrame, community: np.ndarray, k: np.ndarray, resolution: float) -> np.ndarray:
    """The community of the largest gain for each node, its own if none gains."""
    context, m2 = blocks.sparkSession.sparkContext, float(k.sum())
    shared = context.broadcast((community, k, np.bincount(community, k, len(k))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, k, total = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                ids, counts, ends, w = (np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in enumerate(("i4", "i8", "i4", "f8")))
                row = np.repeat(np.arange(len(ids)), counts)
                w = np.where(ends == ids[row], 0.0, w)  # a node takes its own along
                key = row * len(of) + of[ends]
                order = np.argsort(key)
                key = key[order]
                first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                w, row, to = np.add.reduceat(w[order], first), row[order][first], key[first] % len(of)
                mine = to == of[ids][row]
                own = k[ids][row]
                gain = w - resolution * own * (total[to] - np.where(mine, own, 0.0)) / m2
                starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
                round9 = np.round(gain, 9)
                best = np.maximum.reduceat(round9, starts)
                last = np.maximum.reduceat(np.where(round9 == best[row], np.arange(len(row)), -1), starts)
                want = np.where(best > gain[mine] + 1e-7, to[last], of[ids]).astype("i4")
                yield pa.RecordBatch.from_pylist([{"ids": ids.tobytes(), "want": want.tobytes()}], pa.schema([("ids", pa.binary()), ("want", pa.binary())]))

    want = community.copy()
    for r in blocks.mapInArrow(run, "ids binary, want binary").collect():
        want[np.frombuffer(r["ids"], "i4")] = np.frombuffer(r["want"], "i4")
    shared.destroy()
    return want


def turned(n: int, *seeds: int) -> np.ndarray:
    """A seeded half of the nodes."""
    h = np.arange(n, dtype="u8")
    for s in (*seeds, 0):
        h = (h + np.uint64((s * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
    return (h & np.uint64(1)) == 0


def placed(edges: DataFrame, resolution: float, seed: int, levels: int, rounds: int, most: int) -> DataFrame | None:
    """``node, community`` of a graph with integer nodes, as ``graph.louvain`` says; None where nodes are over ``most``."""
    spark, kind = edges.sparkSession, edges.schema["src"].dataType
    found = blocks_of(edges, most)
    if found is None:
        return None
    blocks, nodes = found
    inside = np.arange(len(nodes), dtype="i4")  # the node of this level that holds each node
    name = inside  # the node after which each node of this level is named
    for level in range(levels if len(nodes) else 0):
        k = strengths(blocks, len(name))
        community, moved_any = np.arange(len(name), dtype="i4"), False
        for turn in range(rounds if k.sum() else 0):
            want = wanted(blocks, community, k, resolution)
            moves = (want != community) & turned(len(name), seed, level, turn)
            moved_any = moved_any or bool(moves.any())
            ended = bool((want == community).all())
            community = np.where(moves, want, community)
            if ended:
                break
        if not moved_any:
            break
        used, into = np.unique(community, return_inverse=True)
        inside, name = into.astype("i4")[inside], name[used]
        if level + 1 < levels and len(used) > 1:
            blocks = joined_up(blocks, into.astype("i4"))
        else:
            break
    shared = spark.sparkContext.broadcast((nodes, nodes[name[inside]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(x[at]) for x in shared.value], ["node", "community"])

    found = spark.range(len(nodes)).mapInArrow(run, "node long, community long")
    made = durable(found.select(*[F.col(c).cast(kind).alias(c) for c in found.columns]), "louvain")
    shared.destroy()
    return made
