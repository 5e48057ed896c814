import json

import pytest
from pyspark.sql import functions as F

from tessera.sources import readers, writers
from tessera.streaming.ingest import ingest


def test_jsonl_counts_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('\n{"id": "x", "text": "hi"}\n \n{"text": 5}\n', encoding="utf-8")
    out = readers.jsonl(spark, str(tmp_path / "a.jsonl")).withColumn("text", readers.string_field("value", "text")).orderBy("line_no").collect()
    assert [(r.line_no, r.record_index, r.default_id, r.text) for r in out] == [(2, 0, "a:2", "hi"), (4, 1, "a:4", None)]
    (tmp_path / "b.jsonl").write_text("{bad\n")
    with pytest.raises(Exception):
        readers.jsonl(spark, str(tmp_path / "b.jsonl")).collect()
    assert readers.jsonl(spark, str(tmp_path / "b.jsonl"), strict=False).first().value is None


def test_csv_text_and_arrays(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'\xef\xbb\xbftext1,text2\n"a\nb",t\n')
    assert readers.csv(spark, str(tmp_path / "a.csv"), "text1", "text2").first()["text1"] == "a\nb"
    with pytest.raises(ValueError):
        readers.csv(spark, str(tmp_path / "a.csv"), "no")
    (tmp_path / "l.json").write_text(json.dumps(["User: a", "User: b"]))
    assert [r.item_no for r in readers.string_arrays(spark, str(tmp_path / "l.json")).collect()] == [0, 1]
    (tmp_path / "f.txt").write_text("1.5, 2\n3")
    assert readers.factors(spark, str(tmp_path / "f.txt")).first().factors == [1.5, 2.0, 3.0]
    spark.createDataFrame([("x", 1.0)], "text string, score double").coalesce(1).write.parquet(str(tmp_path / "p"))
    assert readers.parquet_texts(spark, str(tmp_path / "p")).first().row_no == 1


def test_manifest(spark, tmp_path):
    for name, n in (("a", 4), ("b", 3)):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"id": f"{name}{i}", "text": "t"}) + "\n" for i in range(n)))
    entries = [{"name": "a", "path": "a.jsonl", "weight": 0.5}, {"name": "b", "path": "b.jsonl", "weight": 0}, {"name": "c", "path": "none.jsonl", "enabled": False}]
    (tmp_path / "m.json").write_text(json.dumps({"datasets": entries}))
    assert readers.load_manifest(spark, str(tmp_path / "m.json")).groupBy("source").count().collect() == [("a", 2)]
    (tmp_path / "n.json").write_text(json.dumps({"datasets": entries[1:]}))
    with pytest.raises(ValueError):
        readers.load_manifest(spark, str(tmp_path / "n.json"))


def test_jsonl_keeps_null_extras(spark, tmp_path):
    df = spark.createDataFrame([("1", None, "s"), ("2", "é", None)], "id string, category string, source string")
    seen = writers.jsonl(df, str(tmp_path / "out"), files=1)
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).orderBy("value").collect()]
    assert lines == [{"id": "1", "category": None, "source": "s"}, {"id": "2", "category": "é"}] and seen.get["records"] == 2


def test_report_and_metrics(spark, tmp_path):
    df = spark.createDataFrame([("| a |", 1)], "markdown string, n int")
    writers.report(df, str(tmp_path / "r"))
    writers.metrics(df, str(tmp_path / "m"))
    writers.metrics(df, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 2 and spark.read.text(str(tmp_path / "r/markdown")).first().value == "| a |"


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    run = lambda: ingest(spark, str(tmp_path / "in"), str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "cp")).awaitTermination()
    (tmp_path / "in/1.jsonl").write_text('{"id": "1", "text": " a "}\n\n{"id": "2", "text": 7}\nbad\n')
    run()
    (tmp_path / "in/2.jsonl").write_text('{"id": "3", "text": "b"}\n')
    run()
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "good")).collect()) == ["a", "b"]
    assert spark.read.parquet(str(tmp_path / "bad")).where(F.col("error_code") == "text_missing").count() == 2
