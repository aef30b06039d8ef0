"""Uniform sharding with exact shard sizes through a communication matrix.

Method: every input partition learns how many of its rows go to each shard before
any row moves. The counts are one draw of the multivariate hypergeometric law, the
law that a uniform shuffle of all rows would give, so they add up to the exact
partition and shard sizes. Each partition then permutes its rows, cuts them at the
drawn counts, sends the pieces, and each shard permutes what arrives. The result
is a uniform shuffle, and no count is ever repaired afterwards.

Main path: DataFrame functions only. The driver draws the matrix, which has one
row per partition and one column per shard and holds no document.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scholia.llm.frames import named, positional
from scholia.plans.durable import durable

#: Rows that one task orders when a shard is permuted.
ROWS_PER_SLICE = 1_000_000
#: ``monotonically_increasing_id`` keeps the partition above this bit.
PARTITION_BIT = 33


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Sizes of ``shards`` shards that are at most one row apart."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def communication_matrix(partition_rows: list[int], sizes: list[int], seed: int) -> np.ndarray:
    """Draw rows-per-(partition, shard) with the given margins, as a uniform shuffle would."""
    return np.concatenate([np.zeros((0, len(sizes)), dtype=np.int64), *matrix_blocks(partition_rows, sizes, seed)])


def matrix_blocks(partition_rows: list[int], sizes: list[int], seed: int, block: int = 2_000) -> Iterator[np.ndarray]:
    """The matrix in blocks of its rows, so that the driver holds one block at a time."""
    draw = np.random.default_rng(seed)
    left = np.array(sizes, dtype=np.int64)
    for begin in range(0, len(partition_rows), block):
        part = partition_rows[begin : begin + block]
        out = np.zeros((len(part), len(sizes)), dtype=np.int64)
        for p, n in enumerate(part):
            rest, need = int(left.sum()), int(n)
            for s in range(len(sizes)):
                if not need:
                    break
                rest -= int(left[s])
                out[p, s] = hypergeometric(draw, int(left[s]), rest, need)
                need -= int(out[p, s])
            left -= out[p]
        yield out


#: Populations from which numpy's own sampler refuses to draw.
NUMPY_LIMIT = 1_000_000_000


def hypergeometric(draw: np.random.Generator, good: int, bad: int, n: int) -> int:
    """One exact draw: how many of ``n`` rows from ``good + bad`` are good, at every size."""
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    return int(draw.hypergeometric(good, bad, n)) if good + bad < NUMPY_LIMIT else ratio_of_uniforms(draw, good, bad, n)


def ratio_of_uniforms(draw: np.random.Generator, good: int, bad: int, n: int) -> int:
    """The hypergeometric law by rejection under a table mountain hat (Stadlober's ratio of uniforms).

    Only ratios of probabilities to that of the mode are needed; they come from Loader's
    expansion of binomial probabilities, whose terms stay near one, so that no digits
    are lost where log factorials would be of the size of the population.
    """
    total = good + bad
    low, high = max(0, n - bad), min(n, good)
    mode = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    top = log_chance(mode, good, bad, n)
    mean = n * (good / total)
    sd = math.sqrt((total - n) / (total - 1) * mean * (bad / total) + 0.5)
    width = 2 * math.sqrt(2 / math.e) * sd + 3 - 2 * math.sqrt(3 / math.e)
    while True:
        u, v = 1 - draw.random(), draw.random()
        k = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if low <= k <= high and 2 * math.log(u) <= log_chance(k, good, bad, n) - top:
            return k


def log_chance(k: int, good: int, bad: int, n: int) -> float:
    """Log probability of ``k`` good rows among ``n``, as three binomial terms with one chance."""
    p = n / (good + bad)
    return _log_binomial(k, good, p) + _log_binomial(n - k, bad, p) - _log_binomial(n, good + bad, p)


def _log_binomial(x: int, n: int, p: float) -> float:
    if x in (0, n):
        return n * (math.log1p(-p) if x == 0 else math.log(p)) if 0 < p < 1 else 0.0
    return (
        _stirling_rest(n) - _stirling_rest(x) - _stirling_rest(n - x) - _deviance(x, n * p) - _deviance(n - x, n * (1 - p))
        + 0.5 * math.log(n / (2 * math.pi * x * (n - x)))
    )


def _stirling_rest(n: int) -> float:
    """What Stirling's formula leaves of log n!."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi)
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * n * n)) / (n * n)) / (n * n)) / n


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x without loss of digits near the mean."""
    if abs(x - mean) < 0.1 * (x + mean):
        v = (x - mean) / (x + mean)
        s, term, j = (x - mean) * v, 2 * x * v, 1
        while True:
            term *= v * v
            more = s + term / (2 * j + 1)
            if more == s:
                return s
            s, j = more, j + 1
    return x * math.log(x / mean) + mean - x


def _literal(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small frame from a literal, without a Python worker."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _matrix_table(spark: SparkSession, parts: list[int], blocks: Iterator[np.ndarray]) -> DataFrame:
    """``_part, _ends``: where each partition's random order is cut; written block by block."""
    schema, at, tables = "_part:int,_ends:array<bigint>", 0, []
    for matrix in blocks:
        ends = np.cumsum(matrix, axis=1)
        tables.append(durable(_literal(spark, [{"_part": parts[at + i], "_ends": e.tolist()} for i, e in enumerate(ends)], schema), "matrix"))
        at += len(matrix)
    return reduce(DataFrame.unionByName, tables) if tables else _literal(spark, [], schema)


def assign_shards(rows: DataFrame, shards: int, seed: int = 20240229) -> DataFrame:
    """Add ``shard`` (0 to shards-1) and ``slot`` (gapless from 0 in each shard) to every row.

    Shard sizes differ by at most one row whatever the rows hold; nulls, ties and
    repeated rows count like any others, and an empty input gives an empty result.
    ``rows`` should be narrow, as it is written once so that counting and dealing see
    the same partitions. Its columns may have any names, but ``shard`` and ``slot`` are
    replaced.
    """
    spark = rows.sparkSession
    rows, names, _ = positional(rows.drop("shard", "slot"))
    kept = durable(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    kept = kept.withColumn("_part", F.shiftright("_row", PARTITION_BIT).cast("int"))
    counts = sorted((r["_part"], r["n"]) for r in kept.groupBy("_part").agg(F.count("*").alias("n")).collect())
    total = sum(n for _, n in counts)
    sizes = shard_sizes(total, shards)
    matrix = _matrix_table(spark, [p for p, _ in counts], matrix_blocks([n for _, n in counts], sizes, seed))
    # Permute within the partition, then cut at the drawn counts. Spark knows the size of the matrix and chooses the join.
    order = Window.partitionBy("_part").orderBy(F.xxhash64("_row", F.lit(seed)), "_row")
    dealt = (
        kept.withColumn("_rank", F.row_number().over(order))
        .join(matrix, "_part")
        .withColumn("_shard", F.size(F.filter("_ends", lambda e: e < F.col("_rank"))))
        .drop("_ends", "_rank", "_part")
    )
    # Permute within the shard: slices of the random order are sorted apart.
    slices = max(1, -(-max(sizes, default=0) // ROWS_PER_SLICE))
    dealt = dealt.withColumn("_order", F.xxhash64(F.lit(seed + 1), "_row"))
    dealt = dealt.withColumn("_slice", F.pmod(F.shiftright("_order", 20), F.lit(slices)).cast("int"))
    if slices > 1:
        dealt = durable(dealt, "dealt")
        held = dealt.groupBy("_shard", "_slice").agg(F.count("*").alias("_n"))
        before = Window.partitionBy("_shard").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        starts = held.select("_shard", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
        dealt = dealt.join(starts, ["_shard", "_slice"])
    else:
        dealt = dealt.withColumn("_start", F.lit(0).cast("long"))
    again = Window.partitionBy("_shard", "_slice").orderBy("_order", "_row")
    slot = (F.row_number().over(again) - 1 + F.col("_start")).cast("long")
    return named(dealt.withColumn("_slot", slot), names, shard=F.col("_shard"), slot=F.col("_slot"))


def document_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32``: UTF-8 bytes of the text plus 16, and its checksum (null: no bytes)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )


def write_shards(docs: DataFrame, path: str, shards: int, seed: int = 20240229, rows_per_file: int = 500_000) -> None:
    """Write whole documents, one folder per shard, in files of slots that follow one another and are sorted within.

    A shard is written by as many tasks as it has files; ``slots`` names a file's first slot.
    """
    dealt = assign_shards(docs, shards, seed).withColumn("slots", F.floor(F.col("slot") / F.lit(rows_per_file)) * F.lit(rows_per_file))
    dealt.repartition("shard", "slots").sortWithinPartitions("shard", "slot").write.partitionBy("shard", "slots").parquet(path)


def shard_report(docs: DataFrame, shards: int = 40, seed: int = 20240229) -> DataFrame:
    """One row per document: its size, checksum, shard and slot under the ``rows`` law."""
    return assign_shards(document_digest(docs), shards, seed).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
