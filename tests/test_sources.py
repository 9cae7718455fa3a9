"""Manifest rules, text scans, append-resume and the guard of a built base."""

import json

import pytest
from pyspark.sql import functions as F

from lexloom.functions import text as tx
from lexloom.sources import manifest as mf


@pytest.fixture
def base(tmp_path):
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts/a b.txt").write_bytes(b"one\r\n\r\n\r\n\r\ntwo  \xff" + b"x" * 20)
    (tmp_path / "texts/c.txt").write_text("short")

    def write(docs, policy=mf.POLICY):
        (tmp_path / "m.json").write_text(json.dumps({"source_policy": policy, "documents": docs}))
        return str(tmp_path / "m.json")

    return tmp_path, write


def test_manifest_texts(spark, base):
    top, write = base
    path = write([{"doc_id": "a", "source_path": "texts/a b.txt"}, {"doc_id": "c", "source_path": "texts/c.txt", "enabled": False}])
    (row,) = mf.manifest_texts(spark, path, str(top), "texts", 10).collect()
    assert (row.doc_id, row.text) == ("a", "one\n\ntwo " + "x" * 20)
    assert {r.source_path for r in mf.read_texts(spark, f"file://{top}", least=1).collect()} == {"texts/a b.txt", "texts/c.txt"}


@pytest.mark.parametrize("entry", [{"doc_id": " "}, {"source_path": ""}, {"source_path": "texts/../x.txt"}, {"source_path": "other/x.txt"}, {"source_path": "texts/x.pdf"}, {"doc_id": "a"}])
def test_bad_entries(spark, base, entry):
    path = base[1]([{"doc_id": "a", "source_path": "texts/a.txt"}, {"doc_id": "b", "source_path": "texts/b.txt"} | entry])
    with pytest.raises(ValueError, match="manifest entry"):
        mf.entries(mf.read_manifest(spark, path), "texts")


@pytest.mark.parametrize("docs,policy", [([], mf.POLICY), ([{"doc_id": "a"}], "web")])
def test_bad_manifest(spark, base, docs, policy):
    with pytest.raises(ValueError):
        mf.read_manifest(spark, base[1](docs, policy))


def test_append_and_jsonl(spark, tmp_path):
    out = str(tmp_path / "qa")
    mf.append_new(spark.createDataFrame([("A ", 1), ("b", 2)], "q string, n int"), out, "q")
    mf.append_new(spark.createDataFrame([("a", 3), ("c", 4), (" C", 4)], "q string, n int"), out, "q")
    assert sorted(r.q.strip().lower() for r in mf.read_jsonl(spark, out, "q string, n int").collect()) == ["a", "b", "c"]
    (tmp_path / "bad.jsonl").write_text('{"q": "x", "n": 1}\n\nnot json\n')
    assert mf.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "q string, n int").filter("q is not null").count() == 1
    with pytest.raises(Exception):  # noqa: B017
        mf.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "q string, n int", strict=True).collect()


def test_base(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        mf.load_base(spark, str(tmp_path / "none"))
    docs = spark.createDataFrame([("a", "é")], "doc_id string, text string")
    mf.save_base(docs, docs, str(tmp_path / "kb"), chunk_size="1600")
    assert mf.load_base(spark, str(tmp_path / "kb")).count() == 1
    assert spark.read.parquet(str(tmp_path / "kb/sources")).first().bytes == 2
    with pytest.raises(ValueError):
        mf.load_base(spark, str(tmp_path / "kb"), "web")


def test_unicode(spark):
    row = spark.createDataFrame([("  Nghi\u0323 \u0111i\u0323nh\t\t1\n\n\n\n2 ",), (None,)], "a string")
    assert [r[0] for r in row.select(tx.clean_unicode(F.col("a"))).collect()] == ["Ngh\u1ecb \u0111\u1ecbnh 1\n\n2", None]
    assert [r[0] for r in row.select(tx.slug(F.col("a"))).collect()] == ["nghi_inh_1_2", None]
