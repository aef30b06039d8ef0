"""Writers (SNK-*)."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """SNK-01, SNK-02."""
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """SNK-04: CSV with a header; one file on request, for small tables."""
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True, escape='"')


def write_excel(df: DataFrame, path: str, most: int = 100_000) -> None:
    """SNK-05: a small table as a workbook; needs ``openpyxl`` and refuses more than ``most`` rows."""
    try:
        import openpyxl  # noqa: F401
    except ImportError as e:
        raise RuntimeError("writing workbooks needs openpyxl; use write_csv or write_parquet") from e
    if df.limit(most + 1).count() > most:
        raise ValueError(f"a workbook takes at most {most} rows")
    df.toPandas().to_excel(path)


def save_model(model, path: str) -> None:
    """SNK-11: a fitted ``pyspark.ml`` model."""
    model.write().overwrite().save(path)


def append_log(df: DataFrame, path: str) -> None:
    """SNK-07: results as JSON lines, which ``read_log`` resumes from."""
    df.write.mode("append").json(path)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """SNK-09: a table without rows but with types."""
    return spark.createDataFrame([], schema)


def _files(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def replace_table(df: DataFrame, path: str) -> None:
    """SNK-03: write beside, then rename; readers see the old or the new table, and ``df`` may read the old one."""
    spark = df.sparkSession
    fresh, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    write_parquet(df, fresh)
    place, fs = _files(spark, path)
    if fs.exists(place):
        fs.rename(place, _files(spark, old)[0])
    if not fs.rename(_files(spark, fresh)[0], place):
        raise OSError(f"cannot move the new table to {path}")
    fs.delete(_files(spark, old)[0], True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """SNK-06, SNK-10: a small text through Hadoop's file systems."""
    place, fs = _files(spark, path)
    out = fs.create(place, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_manifest(spark: SparkSession, path: str, **fields) -> None:
    """SNK-10: a JSON record of a run."""
    write_text(spark, path, json.dumps(fields, indent=2, sort_keys=True, default=str))


def write_progress(spark: SparkSession, folder: str, summary: dict) -> None:
    """SNK-06: the latest progress as a text and a table, and a line of history, which is only ever added to."""
    write_text(spark, f"{folder}/progress.txt", "\n".join(f"{k}: {v}" for k, v in summary.items()) + "\n")
    spark.createDataFrame([summary]).write.mode("overwrite").parquet(f"{folder}/progress.parquet")
    append_text(spark, f"{folder}/history.tsv", "\t".join(str(v) for v in summary.values()) + "\n")


def append_text(spark: SparkSession, path: str, text: str) -> None:
    """SNK-06: add to the end of a file, whose earlier bytes are not read; the file system must be able to append."""
    place, fs = _files(spark, path)
    if hasattr(fs, "getRawFileSystem"):  # a local file's checksums cannot be appended to
        fs = fs.getRawFileSystem()
    out = fs.append(place) if fs.exists(place) else fs.create(place, False)
    out.write(bytearray(text.encode()))
    out.close()


def back_up(spark: SparkSession, path: str) -> str:
    """SNK-08: copy a table once before it is repaired; a later repair keeps the first copy. Returns its path."""
    copy = f"{path}.before_repair"
    place, fs = _files(spark, f"{copy}/_SUCCESS")
    if not fs.exists(place):
        spark.read.parquet(path).write.mode("overwrite").parquet(copy)
    return copy


def apply_by_shard(df: DataFrame, path: str, files: Sequence[str] | None = None) -> None:
    """SNK-03, SNK-08: write a table by ``file``, replacing only the partitions that it holds."""
    part = df if files is None else df.where(df["file"].isin(list(files)))
    part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file").parquet(path)
