"""Best-two-fit packing of token sequences.

Method: fill a bin greedily, always with the longest piece that still fits, then
take its smallest piece out again if two unpacked pieces fill the widened gap more
tightly. How pieces pack depends on their lengths alone, and there are at most
``capacity - 1`` different lengths, so the driver packs the histogram of lengths:
each step repeats one pattern of lengths as often as the counts allow. Pieces of
one length are then ranked, without any global sort, and a rank names a bin: ``n``
pieces of a length are ranked in about ``sqrt(n)`` buckets, so that no task sees more
than that, however many documents are as long as one another.

Tokenizing is the only work on text and runs once; its digest is kept in the
shared folder.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scholia.llm.frames import id_long, id_text, named, positional
from scholia.llm.words import slices
from scholia.plans.durable import durable

CAPACITY = 1024
END_ID = 2


def load(path: str):
    """The byte-level BPE of a JSON file of ``tokenizers``, run by ``tiktoken``, which gives the same ids in a fifth of the time.

    A piece's id is its rank. A special token's string inside a text is that token.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    special = {t["content"]: t["id"] for t in whole["added_tokens"]}
    byte = _bytes_of_characters()
    ranks = {bytes(byte[c] for c in piece): i for piece, i in whole["model"]["vocab"].items() if piece not in special}
    return tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def _bytes_of_characters() -> dict[str, int]:
    """The characters by which byte-level BPE writes bytes: printable ones are themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def token_ids(encoding, texts: list[str | None]) -> list[np.ndarray]:
    """Ids of each text and the end id."""
    return [np.array([*encoding.encode(t or "", allowed_special="all"), END_ID], dtype="<u4") for t in texts]


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of ``n`` ids; only the first may be shorter than ``capacity``."""
    head = n % capacity
    found = [(0, head)] if head else []
    return found + [(s, capacity) for s in range(head, n, capacity)]


def tokenized_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document (null text: empty)."""
    schema = "doc_id string, piece int, start long, length long, ids_crc32 long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = load(path)
        for batch in batches:
            rows = []
            for i, j in slices(batch["text"].tolist()):
                for doc, ids in zip(batch["doc_id"].iloc[i:j], token_ids(encoding, batch["text"].iloc[i:j].tolist()), strict=True):
                    for k, (start, length) in enumerate(cut(len(ids), capacity)):
                        rows.append((doc, k, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(id_text(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(run, schema).withColumn("doc_id", id_long("doc_id"))


class _Lengths:
    """Counts of unpacked pieces by length, with the lengths in order."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v > 0}
        self.keys = sorted(self.n)

    def longest(self, most: int, used: dict[int, int]) -> int:
        """The longest length up to ``most`` that is left beside ``used``; 0 if none."""
        i = bisect_right(self.keys, most) - 1
        while i >= 0 and self.n[self.keys[i]] <= used.get(self.keys[i], 0):
            i -= 1
        return self.keys[i] if i >= 0 else 0

    def take(self, used: dict[int, int], times: int) -> None:
        for k, u in used.items():
            self.n[k] -= u * times
            if not self.n[k]:
                del self.n[k]
                self.keys.remove(k)


def _tally(pattern: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for x in pattern:
        out[x] = out.get(x, 0) + 1
    return out


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Pack a histogram of lengths: ``(lengths of a bin, number of such bins)`` in order.

    Swaps spend short pieces early, which may cost bins at the end, so the plan is made
    for several largest gaps that a swap may leave, and the one with the fewest bins wins.
    """
    plans = (_plan(counts, capacity, most) for most in (capacity, 64, 16, 4, 1, 0))
    return min(plans, key=lambda plan: sum(times for _, times in plan))


def _plan(counts: dict[int, int], capacity: int, most_left: int) -> list[tuple[list[int], int]]:
    """One plan, in which a swap leaves a gap of at most ``most_left``."""
    left, plan = _Lengths(counts), []
    while left.keys:
        pattern, gap = [], capacity
        used: dict[int, int] = {}
        while gap and (x := left.longest(gap, used)):
            pattern.append(x)
            used[x] = used.get(x, 0) + 1
            gap -= x
        if gap and len(pattern) > 1:
            small = pattern[-1]
            rest = dict(used)
            rest[small] -= 1
            best, room = (small, 0), small + gap
            for a in reversed(left.keys[: bisect_right(left.keys, room - 1)]):
                if 2 * a < room and a + min(a, room - a) <= sum(best):
                    break
                if left.n[a] <= rest.get(a, 0):
                    continue
                b = left.longest(min(a, room - a), {**rest, a: rest.get(a, 0) + 1})
                if b and a + b > sum(best):
                    best = (a, b)
                    if a + b == room:
                        break
            if best[1] and room - sum(best) <= most_left:
                pattern[-1:] = best
        used = _tally(pattern)
        times = min(left.n[k] // u for k, u in used.items())
        plan.append((pattern, times))
        left.take(used, times)
    return plan


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces of ``length`` 1 to ``capacity``.

    Sequences are numbered from 0 without gaps and filled from offset 0 without
    gaps. Repeated rows are packed one by one; other columns may have any names; an
    empty input gives an empty result. The pieces are written once.
    """
    spark = pieces.sparkSession
    rows, names, (place,) = positional(pieces, "length")
    rows = durable(rows.withColumn("_row", F.monotonically_increasing_id()), "pieces").withColumnRenamed(place, "_length")
    counts = {r["_length"]: r["n"] for r in rows.groupBy("_length").agg(F.count("*").alias("n")).collect()}
    first, base = {}, 0
    # At most a few slots per pattern and a few patterns per length: bounded by the capacity.
    by_length: dict[int, list] = {x: [] for x in counts}
    for pattern, times in best_two_fit(counts, capacity):
        offset = 0
        for x in pattern:
            begin = first.get(x, 0)
            by_length[x].append({"lo": begin, "hi": begin + times, "base": base, "offset": offset})
            first[x] = begin + times
            offset += x
        base += times
    table = spark.range(1).select(
        F.inline(
            F.from_json(
                F.lit(json.dumps([{"_length": k, "buckets": int(np.ceil(np.sqrt(counts[k]))), "slots": v} for k, v in by_length.items()])),
                "array<struct<_length:bigint,buckets:bigint,slots:array<struct<lo:bigint,hi:bigint,base:bigint,offset:bigint>>>>",
            )
        )
    )
    dealt = rows.join(F.broadcast(table.drop("slots")), "_length").withColumn("_bucket", F.pmod(F.xxhash64("_row"), "buckets"))
    held = dealt.groupBy("_length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select("_length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_length", "_bucket").orderBy("_row")
    ranked = dealt.withColumn("_rank", F.row_number().over(within) - 1)
    ranked = ranked.join(starts, ["_length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_start"))
    slot = F.element_at(F.filter("slots", lambda s: (s.lo <= F.col("_rank")) & (F.col("_rank") < s.hi)), 1)
    placed = ranked.join(F.broadcast(table.select("_length", "slots")), "_length").withColumn("_slot", slot).withColumnRenamed("_length", place)
    return named(placed, names, sequence_id=F.col("_slot.base") + F.col("_rank") - F.col("_slot.lo"), offset=F.col("_slot.offset"))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize, cut and pack whole documents; one row per piece.

    A null or empty text is the end id alone; nulls in other columns, extra columns
    and repeated documents do no harm (each row is packed). Documents with a null
    id are packed too; an empty table gives none. ``path`` names a tokenizer's JSON file.
    """
    return packed(tokenized_pieces(docs, path, capacity), capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
