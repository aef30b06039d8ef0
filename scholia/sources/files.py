"""Readers of files and paged services (SRC-*)."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from scholia.functions.parsing import preferred_text
from scholia.operators.columns import filled_text, keep_first, require_columns, valid_year, with_missing


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None, where: str | None = None) -> DataFrame:
    """SRC-01, SRC-02: a lazy scan; the filter and the columns reach the files."""
    df = spark.read.parquet(path)
    df = df.where(where) if where else df
    return df.select(*columns) if columns else df


def missing_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> list[str]:
    """SRC-03: wanted columns that a file lacks, from its footer."""
    return [c for c in columns if c not in spark.read.parquet(path).columns]


def read_shards(spark: SparkSession, folder: str, columns: Mapping[str, str] | None = None, excluded: Sequence[str] = ()) -> DataFrame:
    """SRC-04, SRC-05: Parquet files of a folder under one schema, with the file's stem as ``file``.

    Absent columns are null; named files are left out.
    """
    df = spark.read.option("mergeSchema", "true").option("pathGlobFilter", "*.parquet").parquet(folder)
    name = F.col("_metadata.file_name")
    df = df.where(~name.isin(list(excluded))) if excluded else df
    df = df.withColumn("file", F.regexp_replace(name, r"\.parquet$", ""))
    return with_missing(df, columns or {})


def union_drifting(frames: Sequence[DataFrame]) -> DataFrame:
    """SRC-05: rows of frames whose columns differ; a column of several types becomes text."""
    kinds: dict[str, set] = {}
    for f in frames:
        for c, t in f.dtypes:
            kinds.setdefault(c, set()).add(t)
    numbers = {"int", "bigint", "smallint", "tinyint", "float", "double"}

    def widest(found: set) -> str:
        if len(found) == 1:
            return next(iter(found))
        return ("double" if found & {"float", "double"} else "bigint") if found <= numbers else "string"

    same = [f.select(*[F.col(c).cast(widest(kinds[c])).alias(c) for c in f.columns]) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), same)


def read_input_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC-06: ``id, title, abstract, year``: trimmed ids, unwrapped texts, no blank ids or abstracts, first row of each id."""
    df = require_columns(spark.read.csv(path, header=True, multiLine=True, escape='"'), ["id", "title", "abstract", "year"])
    df = df.withColumn("_row", F.monotonically_increasing_id())
    df = df.select(
        F.trim("id").alias("id"), preferred_text("title").alias("title"), preferred_text("abstract").alias("abstract"), valid_year("year").alias("year"), "_row"
    )
    return keep_first(df.where(filled_text("id") & filled_text("abstract")), ["id"], ["_row"]).drop("_row")


def read_csv_any(spark: SparkSession, path: str, **options) -> DataFrame:
    """SRC-07: CSV as UTF-8, or as Latin-1 where its bytes are no UTF-8."""
    raw = spark.read.format("binaryFile").load(path).select(F.col("content"))
    broken = raw.where(~F.is_valid_utf8(F.col("content").cast("string"))).limit(1).count()
    df = spark.read.csv(path, header=True, encoding="ISO-8859-1" if broken else "UTF-8", **options)
    return df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns})


def merge_csv(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-10: rows of all CSV files of a folder by name; files without rows add none."""
    files = [r["f"] for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).where("length > 0").select(F.col("path").alias("f")).collect()]
    return union_drifting([f for f in (spark.read.csv(p, header=True) for p in sorted(files)) if f.columns])


def read_excel(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """SRC-09: a workbook's first sheet by its index column, through pandas; needs ``openpyxl``. For small files."""
    try:
        import openpyxl  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading workbooks needs openpyxl; convert them to Parquet once") from e
    frame = pd.read_excel(path, index_col=0)
    return spark.createDataFrame(frame[list(columns)] if columns else frame)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-15: JSON lines; lines that cannot be read are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """SRC-08, SRC-14: the table at a path that names its content, made once."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def monthly_download(spark: SparkSession, fetch: Callable[[], bytes], folder: str, name: str, month: str) -> DataFrame:
    """SRC-08: a tab-separated download, fetched once a month (``yyyyMM``) into a folder that the cluster shares."""
    from scholia.sources.sinks import _files

    place, fs = _files(spark, f"{folder}/{name}_{month}.txt")
    if not fs.exists(place):
        out = fs.create(place, False)
        out.write(bytearray(fetch()))
        out.close()
    return spark.read.csv(place.toString(), sep="\t", header=True)


def country_dimension(spark: SparkSession, path: str | None = None) -> DataFrame:
    """SRC-13: ``iso2, iso3, admin`` of countries: a CSV, else all that the Java runtime's ISO 3166 table knows; no geometry."""
    if path:
        return spark.read.csv(path, header=True)
    from scholia.functions.entity import iso_countries

    rows = ", ".join("('{}', '{}', '{}')".format(*(x.replace("'", "\\'") for x in r)) for r in iso_countries(spark))
    return spark.sql(f"select * from values {rows} t(iso2, iso3, admin)")


#: Pages of a search: (term, year, rows to skip, rows to take) -> (rows, total).
Search = Callable[[str, int, int, int], tuple[list[tuple], int]]


def fetch_pages(search: Search, term: str, year: int, page: int = 1000, cap: int = 50_000, tries: int = 8, pause: Callable[[float], None] = time.sleep) -> Iterator[tuple]:
    """SRC-11a: rows of one search until its total, a short page or the service's own cap; failures are tried again."""
    skip = 0
    while skip < cap:
        for n in range(1, tries + 1):
            try:
                rows, total = search(term, year, skip, min(page, cap - skip))
                break
            except Exception:
                if n == tries:
                    raise
                pause(min(120.0, 0.25 * 2 ** (n - 1)))
        yield from rows
        skip += len(rows)
        if skip >= total or len(rows) < page:
            return


class _Slice(InputPartition):
    def __init__(self, term: str, year: int):
        self.term, self.year = term, year


class _SearchReader(DataSourceReader):
    def __init__(self, search: Search, terms: Sequence[str], years: Sequence[int], page: int, cap: int):
        self.search, self.slices, self.page, self.cap = search, [(t, y) for t in terms for y in years], page, cap

    def partitions(self) -> list[InputPartition]:
        return [_Slice(t, y) for t, y in self.slices]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        for row in fetch_pages(self.search, partition.term, partition.year, self.page, self.cap):
            yield (*row, partition.term)


def paged_source(spark: SparkSession, search: Search, schema: str, terms: Sequence[str], years: Sequence[int], page: int = 1000, cap: int = 50_000) -> DataFrame:
    """SRC-11a, SRC-11b: a paged service as a table with ``search_term``, one partition per term and year."""

    class PagedSearch(DataSource):
        @classmethod
        def name(cls) -> str:
            return "paged_search"

        def schema(self) -> str:
            return f"{schema}, search_term string"

        def reader(self, schema) -> DataSourceReader:
            return _SearchReader(search, terms, years, page, cap)

    spark.dataSource.register(PagedSearch)
    return spark.read.format("paged_search").load()


def lookup(keys: DataFrame, key: str, fetch: Callable[[list], pd.DataFrame], schema: str, batch: int = 200) -> DataFrame:
    """SRC-11c: records of distinct keys, asked for in batches within each task."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in parts:
            wanted = b[key].tolist()
            for i in range(0, len(wanted), batch):
                yield fetch(wanted[i : i + batch])

    return keys.where(F.col(key).isNotNull()).select(key).distinct().mapInPandas(run, schema)
