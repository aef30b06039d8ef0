"""The pipeline's stages on the smallest documents, each against a plain version of its decision."""

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark import SparkContext
from tests.llm.brute import near_duplicates
from tokenizers import Tokenizer

import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows that enter and leave each stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.durable(stage(spark, out[-1], SF), "stage"))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_keep_the_columns_of_documents(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "pii", "packing"]
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes


def test_quality_rejects_the_bad_and_keeps_the_good(spark, stages):
    before, after = texts(stages[0]), texts(stages[1])
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(after[d] == before[d] for d in after)
    wrong = [d for d, q in quality.items() if (d in after) != (q == 1)]
    assert len(wrong) <= 0.05 * len(quality)


def test_quality_sends_python_the_texts_alone(spark, monkeypatch):
    """Whole rows there and back, and workers for the table of labels, took an executor's memory."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    monkeypatch.setattr(SparkContext, "parallelize", lambda *a, **b: pytest.fail("rows made by Python workers"))
    plan = corpus_pipeline.quality_stage(spark, docs, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapIn" not in plan
    (sent,) = [line for line in plan.splitlines() if "ArrowEvalPython" in line]
    (given,) = re.findall(r"ArrowEvalPython \[score\(([^()]*)\)", sent)
    assert "," not in given


def test_near_dedup_equals_brute_force(stages):
    before, after = texts(stages[1]), texts(stages[2])
    want = near_duplicates(before, 5, 4, 5)
    assert set(after) == {d for d, (_, _, kept) in want.items() if kept}


def test_decontamination_drops_documents_with_items(spark, stages):
    before, after = texts(stages[2]), texts(stages[3])
    plain = lambda t: " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()))
    items = [plain(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holds = {d for d, t in before.items() if any(i in plain(t) for i in items)}
    assert holds and not holds & set(after)
    assert len(before) - len(after) <= 1.5 * len(holds) + 1


def test_pii_replaces_private_values_alone(stages):
    before, after = stages[3].collect(), texts(stages[4])
    # A number of sixteen digits is a card, and private, only if its check digit holds.
    private = re.compile(r"[\w.]+@[\w.]+|\+1 \(\d{3}\) \d{3}-\d{4}|\d{1,3}(?:\.\d{1,3}){3}|\b\d{16}\b|\b(?:[0-9a-f]{40}|[0-9A-F]{40})\b")
    luhn = lambda v: sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(v))) % 10 == 0
    assert set(after) == {r["doc_id"] for r in before}
    for r in before:
        found = [v for v in private.findall(r["text"]) if len(v) != 16 or not v.isdigit() or luhn(v)]
        assert (after[r["doc_id"]] != r["text"]) == bool(found)
        assert not any(v in after[r["doc_id"]] for v in found)
        assert private.sub("", r["text"]).split() == private.sub("", after[r["doc_id"]]).split()


def test_packing_holds_every_token(stages):
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    rows = {}
    for r in stages[5].collect():
        rows.setdefault(r["doc_id"], []).append(r)
    before = texts(stages[4])
    assert set(rows) == set(before)
    for d, t in before.items():
        ids = [*encode(t, add_special_tokens=False).ids, 2]
        assert sum(r["length"] for r in rows[d]) == len(ids)
        for r in rows[d]:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], dtype="<u4")
            assert zlib.crc32(part.tobytes()) == r["ids_crc32"]


def test_run_equals_the_stages(spark, stages):
    key = lambda df: sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(stages[-1])


ITEM = " ".join(f"exam{k % 7}{chr(97 + k % 26)}{k}" for k in range(40))
ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, _row int, kept boolean, digest string, c0 string"


def plain(k):
    """A text that shares no five words with that of another number."""
    return " ".join(f"Thing{k}n{i} goes along, and item{k}m{i} stays." for i in range(30))


def odd_rows():
    """Nulls in every column, empty, repeated, tied and very long rows, ids over 2**53."""
    big = 2**60
    rows = [
        (1, plain(1)), (1, plain(1)), (2, None), (3, ""), (None, plain(9)), (None, None), (big + 1, plain(2) + " mail bo@mail1.example.com"),
        (big + 3, plain(2) + " mail bo@mail1.example.com"), (7, plain(3) + " " + ITEM), (None, plain(4) + ITEM), (9, "word " * 60_000 + plain(5)),
    ]
    return [(d, t, *((None,) * 8 if k % 3 == 0 else ("en", "src", len(t or ""), 0.5, 4, True, "x", "y"))) for k, (d, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def odd_folder(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 0), (9, 1, 0), (1, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(5, ITEM), (None, None), (6, ""), (7, "yes")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def ids(rows):
    return sorted((str(r["doc_id"]), r["text"] or "") for r in rows)


@pytest.mark.parametrize("name", ["quality", "near_dedup", "decontamination", "pii", "packing"])
def test_stages_with_odd_rows(spark, odd_folder, name):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, ODD).coalesce(2)
    made = dict(corpus_pipeline.STAGES)[name](spark, docs, odd_folder)
    out = made.collect()
    if name != "packing":
        assert made.columns == docs.columns
    if name == "quality":  # rows pass or go, as they are
        assert {tuple(r) for r in out} <= set(rows) and made.dtypes == docs.dtypes
        assert sum(r["doc_id"] == 1 for r in out) in (0, 2) and len(out) >= 6
    if name == "near_dedup":  # copies of a smaller id go; repeated rows, null ids and empty texts stay
        assert ids(out) == sorted((str(d), t or "") for d, t, *_ in rows if d != 2**60 + 3)
    if name == "decontamination":  # whatever holds the item goes, with or without an id
        assert ids(out) == sorted((str(d), t or "") for d, t, *_ in rows if ITEM not in (t or ""))
    if name == "pii":
        same = [(str(d), t or "") for d, t, *_ in rows if "@" not in (t or "")]
        assert [x for x in ids(out) if "@" not in x[1]] == sorted(same)
        (mail,) = {t.rsplit(" ", 1)[1] for _, t in ids(out) if "@" in t}
        assert mail != "bo@mail1.example.com" and sum("@" in t for _, t in ids(out)) == 2
    if name == "packing":
        assert {r["doc_id"] for r in out} == {d for d, *_ in rows}
        assert sum(r["piece"] == 0 for r in out) == len(rows) and all(0 < r["length"] <= 1024 for r in out)


@pytest.mark.parametrize("name", ["quality", "near_dedup", "decontamination", "pii", "packing"])
def test_stages_with_empty_tables(spark, odd_folder, tmp_path, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, spark.createDataFrame([], ODD), odd_folder).count() == 0
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(odd_rows()[:2], ODD)
    assert stage(spark, docs, str(tmp_path)).count() == 2  # without labels and items nothing is rejected
