"""Readers, writers and streams on small files."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from scholia.sources import files, sinks
from scholia.streaming import streams


def test_csv(spark, tmp_path):
    (tmp_path / "in.csv").write_text("id,title,abstract,year\n 1 ,\"{'preferred': 'T'}\",abc,2001\n1,x,y,2002\n,x,y,2002\n2,x, ,2003\n3,\"a\nb\",y,1700\n")
    rows = files.read_input_csv(spark, str(tmp_path / "in.csv")).orderBy("id").collect()
    assert [(r["id"], r["title"], r["year"]) for r in rows] == [("1", "T", 2001), ("3", "a\nb", None)]
    (tmp_path / "latin.csv").write_bytes("a,b\ncafé,1\n".encode("latin-1"))
    assert files.read_csv_any(spark, str(tmp_path / "latin.csv")).first()["a"] == "café"
    (tmp_path / "utf.csv").write_bytes("﻿a,b\ncafé,1\n".encode())
    assert files.read_csv_any(spark, str(tmp_path / "utf.csv")).first()["a"] == "café"
    os.makedirs(tmp_path / "many")
    for name, body in {"a.csv": "x,y\n1,2\n", "b.csv": "", "c.csv": "y,z\n3,4\n"}.items():
        (tmp_path / "many" / name).write_text(body)
    assert sorted((r["x"], r["y"], r["z"]) for r in files.merge_csv(spark, str(tmp_path / "many")).na.fill("").collect()) == [("", "3", "4"), ("1", "2", "")]


def test_shards(spark, tmp_path):
    folder = str(tmp_path / "raw")
    os.makedirs(folder)
    pd.DataFrame({"id": ["a"], "n": [1]}).to_parquet(f"{folder}/0000.parquet")
    pd.DataFrame({"id": ["b"], "m": ["x"]}).to_parquet(f"{folder}/0001.parquet")
    pd.DataFrame({"id": ["c"]}).to_parquet(f"{folder}/all.parquet")
    rows = files.read_shards(spark, folder, {"q": "int"}, excluded=["all.parquet"]).orderBy("id").collect()
    assert [(r["id"], r["file"], r["q"]) for r in rows] == [("a", "0000", None), ("b", "0001", None)]
    assert files.missing_columns(spark, f"{folder}/0000.parquet", ["id", "zz"]) == ["zz"]
    both = files.union_drifting([spark.createDataFrame([(1, 2)], "a int, b int"), spark.createDataFrame([("x", 2.5)], "a string, b double")])
    assert sorted((r["a"], r["b"]) for r in both.collect()) == [("1", 2.0), ("x", 2.5)]


def test_paged_source(spark):
    def search(term, year, skip, take):
        total = 23 if year == 2001 else 0
        return [(f"{term}-{year}-{k}", year) for k in range(skip, min(skip + take, total))], total

    df = files.paged_source(spark, search, "id string, year int", ["a", "b"], [2000, 2001], page=10)
    assert df.count() == 46 and df.select("search_term").distinct().count() == 2
    waits, calls = [], []

    def flaky(term, year, skip, take):
        calls.append(skip)
        if len(calls) < 3:
            raise OSError("busy")
        return [("x",)], 1

    assert list(files.fetch_pages(flaky, "t", 1, pause=waits.append)) == [("x",)] and waits == [0.25, 0.5]
    with pytest.raises(ZeroDivisionError):
        list(files.fetch_pages(lambda *a: 1 / 0, "t", 1, tries=2, pause=waits.append))


def test_lookup_and_cache(spark, tmp_path):
    keys = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "k string")
    assert files.lookup(keys, "k", lambda ks: pd.DataFrame({"k": ks, "v": [len(ks)] * len(ks)}), "k string, v long").count() == 2
    made = []
    for _ in range(2):
        files.cached(spark, str(tmp_path / "c"), lambda: made.append(1) or spark.range(3))
    assert made == [1]
    (tmp_path / "log.jsonl").write_text('{"id": 1}\nbroken\n{"id": 2}\n')
    assert files.read_log(spark, str(tmp_path / "log.jsonl"), "id int").count() == 2


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_parquet(spark.range(5), path)
    sinks.replace_table(spark.read.parquet(path).where("id > 2"), path)
    assert spark.read.parquet(path).count() == 2 and os.listdir(tmp_path) == ["t"]
    for k in range(2):
        sinks.write_progress(spark, str(tmp_path / "p"), {"done": k, "total": 2})
    assert (tmp_path / "p" / "history.tsv").read_text().split() == ["0", "2", "1", "2"]
    sinks.write_manifest(spark, str(tmp_path / "m.json"), rows=3)
    assert '"rows": 3' in (tmp_path / "m.json").read_text()
    assert sinks.empty(spark, "a int, b array<string>").dtypes == [("a", "int"), ("b", "array<string>")]
    shards = str(tmp_path / "s")
    base = spark.createDataFrame([(1, "x"), (2, "y")], "id int, file string")
    sinks.apply_by_shard(base, shards)
    sinks.apply_by_shard(base.withColumn("id", F.col("id") + 10), shards, ["x"])
    assert sorted(r["id"] for r in spark.read.parquet(shards).collect()) == [2, 11]


def test_streams(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    events = spark.createDataFrame([(k % 3, k) for k in range(9)], "user long, n long").withColumn("ts", F.timestamp_seconds(F.col("n") * 600))
    events.write.parquet(source)
    for _ in range(2):
        streams.resume_new(streams.file_stream(spark, source, events.schema), sink, "n", str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(sink).count() == 9
    events.write.mode("append").parquet(source)
    query = streams.resume_new(streams.file_stream(spark, source, events.schema), sink, "n", str(tmp_path / "cp"))
    query.awaitTermination()
    assert spark.read.parquet(sink).count() == 9 and streams.progress(query)[0]["rows"] == 9
    counted = streams.session_counts(streams.file_stream(spark, source, events.schema), "user", "ts", gap="40 minutes")
    q = counted.writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert streams.trailing_counts(streams.file_stream(spark, source, events.schema), "ts").isStreaming
    assert streams.deduplicated(streams.file_stream(spark, source, events.schema), "n", "ts").isStreaming


def test_monthly_download_and_back_up(spark, tmp_path):
    calls = []

    def fetch():
        calls.append(1)
        return b"code\ttitle\n1\tFirst\n"

    for _ in range(2):
        assert files.monthly_download(spark, fetch, str(tmp_path), "fields", "202411").collect() == [("1", "First")]
    assert len(calls) == 1
    path = str(tmp_path / "t")
    sinks.write_parquet(spark.range(3), path)
    copy = sinks.back_up(spark, path)
    sinks.replace_table(spark.range(1), path)
    assert sinks.back_up(spark, path) == copy and spark.read.parquet(copy).count() == 3


def test_logs_models_and_tables(spark, tmp_path):
    for k in range(2):
        sinks.append_log(spark.range(k, k + 1), str(tmp_path / "log"))
    assert sorted(r["id"] for r in files.read_log(spark, str(tmp_path / "log"), "id long").collect()) == [0, 1]
    sinks.write_csv(spark.createDataFrame([(1, 'a "b"')], "i int, s string"), str(tmp_path / "csv"), single=True)
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "csv"), header=True, escape='"').collect()] == [("1", 'a "b"')]
    from pyspark.ml.feature import Tokenizer

    sinks.save_model(Tokenizer(inputCol="a", outputCol="b"), str(tmp_path / "model"))
    assert Tokenizer.load(str(tmp_path / "model")).getInputCol() == "a"
    assert files.country_dimension(spark).where("iso2 = 'KE'").collect() == [("KE", "KEN", "Kenya")]
    assert files.country_dimension(spark).count() > 200
