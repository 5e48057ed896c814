"""Converters over several files, the committing sink, and the manifest as a data source."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import convert
from tessera.sources import mixture, sink


def lines(folder):
    return [json.loads(x) for f in sorted(os.listdir(folder)) if f.startswith("part-") for x in open(f"{folder}/{f}", encoding="utf-8")]


def test_payload_language_and_ids_over_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a", "b"):
        rows = [{"content": f"{name} one", "language": " zh ", "subset": "x", "deep": {"k": [1, None]}, "n": 1.5}, None, {"id": f"own-{name}", "content": f"{name} two\n\nlines", "source": "s2", "language": None}, {"content": " "}]
        (tmp_path / "in" / f"{name}.jsonl").write_text("\n".join("" if r is None else json.dumps(r) for r in rows) + "\n")
    assert convert.raw_text(spark, str(tmp_path / "in"), str(tmp_path / "out"), "src") == {"converted": 4, "skipped": 2}
    out = {r["id"]: r for r in lines(tmp_path / "out")}
    assert out["src-000001"] == {"id": "src-000001", "type": "text", "text": "a one", "source": "src", "split": "train", "language": "zh", "subset": "x", "deep": {"k": [1, None]}, "n": 1.5}
    assert out["src-000005"]["text"] == "b one" and set(out) == {"src-000001", "src-000005", "own-a", "own-b"}
    assert out["own-a"] == {"id": "own-a", "type": "text", "text": "a two\n\nlines", "source": "s2", "split": "train"}
    convert.raw_text(spark, str(tmp_path / "in"), str(tmp_path / "out"), "src", most=5)
    assert sorted(r["id"] for r in lines(tmp_path / "out")) == ["own-a-0001", "own-a-0002", "own-b-0001", "own-b-0002", "src-000001", "src-000005"]
    assert sink.counts(str(tmp_path / "out")) == {"converted": 6, "skipped": 2, "errors": {"text_missing": 2}}


def test_parquet_over_files_by_tokens(spark, tmp_path):
    import public_tokenizers

    spark.createDataFrame([(f"line {i} a\nline b\nline c",) for i in range(6)], "text string").repartition(2).write.parquet(str(tmp_path / "p"))
    assert convert.parquet(spark, str(tmp_path / "p"), str(tmp_path / "o"), "p") == {"converted": 6, "skipped": 0}
    assert sorted(r["id"] for r in lines(tmp_path / "o")) == [f"p-{i:06d}" for i in range(1, 7)]
    assert convert.parquet(spark, str(tmp_path / "p"), str(tmp_path / "o2"), "p", most=5, tokenizer=public_tokenizers.path("byte_bpe_50k.json")) == {"converted": 12, "skipped": 0}
    assert sorted(r["id"] for r in lines(tmp_path / "o2")) == sorted(f"p-{i:06d}-{k:04d}" for i in range(1, 7) for k in (1, 2))
    assert sorted({r["text"].split("\n")[-1] for r in lines(tmp_path / "o2")}) == sorted(["line c", *(f"line {i} a" for i in range(6))])


def test_held_out_subset(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text("".join(json.dumps({"instruction": f"q{i}", "context": "" if i % 2 else "c", "response": f"r{i}", "category": "t"}) + "\n" for i in range(10)) + json.dumps({"instruction": "q"}))
    go = lambda n: convert.instructions(spark, str(tmp_path / "c.jsonl"), str(tmp_path / "sft"), "s", held=n, held_output=str(tmp_path / "held"), seed="7")
    assert go(3) == {"converted": 7, "skipped": 1, "held": 3}
    kept, held = lines(tmp_path / "sft"), lines(tmp_path / "held")
    assert (len(kept), len(held)) == (7, 3) and len({r["id"] for r in kept + held}) == 10
    assert all([m["role"] for m in r["messages"]] == ["user", "assistant"] and (r["language"], r["category"], r["source"], r["split"]) == ("zh", "t", "s", "train") for r in kept + held)
    with pytest.raises(ValueError, match="fewer"):
        go(10)
    (tmp_path / "none.jsonl").write_text('{"instruction": "q"}\n')
    with pytest.raises(ValueError, match="no chats"):
        convert.instructions(spark, str(tmp_path / "none.jsonl"), str(tmp_path / "x"), "s")
    (tmp_path / "empty.jsonl").write_text("\n")
    with pytest.raises(ValueError, match="no records"):
        convert.raw_text(spark, str(tmp_path / "empty.jsonl"), str(tmp_path / "x"), "s")


def test_sink_commits_or_leaves_nothing(spark, tmp_path):
    rows = spark.range(0, 100, 1, 5).select(F.col("id").cast("string").alias("value"), F.when(F.col("id") % 10 == 0, "tenth").when(F.col("id") % 7 == 0, "seventh").alias("error_code"))
    assert sink.save(rows, str(tmp_path / "o")) == {"converted": 77, "skipped": 23, "errors": {"seventh": 13, "tenth": 10}}
    before = sorted(lines(tmp_path / "o"))
    assert before == [i for i in range(100) if i % 10 and i % 7]
    bad = [json.loads(x) for f in os.listdir(tmp_path / "o" / "_skipped") for x in open(tmp_path / "o" / "_skipped" / f)]
    assert sorted((int(b["value"]), b["error_code"]) for b in bad) == [(i, "seventh" if i % 10 else "tenth") for i in range(100) if not i % 10 or not i % 7]
    broken = rows.withColumn("value", F.when(F.col("value") == "99", F.raise_error(F.lit("broken")).cast("string")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="broken"):
        sink.save(broken, str(tmp_path / "o"))
    assert sorted(lines(tmp_path / "o")) == before and not [f for f in os.listdir(tmp_path / "o") if f.startswith(".run")]
    with pytest.raises(Exception):
        sink.save(broken, str(tmp_path / "new"))
    assert not os.path.exists(tmp_path / "new") or os.listdir(tmp_path / "new") == []
    assert sink.save(rows.limit(0), str(tmp_path / "o")) == {"converted": 0, "skipped": 0, "errors": {}} and lines(tmp_path / "o") == []


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation(n):
    out = mixture.permuted(np.arange(n), n, "s")
    assert sorted(out.tolist()) == list(range(n))
    assert (mixture.permuted(np.arange(n)[::-1], n, "s")[::-1] == out).all()
    if n > 100:
        assert (out != mixture.permuted(np.arange(n), n, "t")).mean() > 0.9 and abs(np.corrcoef(np.arange(n), out)[0, 1]) < 0.15


def test_lines_of_ranges(tmp_path):
    text = b"one\n\n  \ntwo\r\n" + b"x" * 200 + "\né é\nlast".encode()
    (tmp_path / "f").write_bytes(text)
    whole = [x for x in text.split(b"\n") if x.strip()]
    for size in range(1, len(text) + 2):
        assert [x for a in range(0, len(text), size) for x in mixture.lines_of(str(tmp_path / "f"), a, min(a + size, len(text)))] == whole


def test_manifest_source(spark, tmp_path):
    sizes = {"a": 40, "b": 30, "c": 25, "d": 9, "e": 5}
    for name, n in sizes.items():
        (tmp_path / name).mkdir()
        for k in range(2):
            (tmp_path / name / f"{k}.jsonl").write_text("".join(json.dumps({"at": name, "i": i}) + ("\n\n" if i % 5 == 0 else "\n") for i in range(n) if i * 2 // n == k))
    entries = [{"name": "a", "path": "a", "weight": 0.5}, {"name": "b", "path": "b/", "weight": 2.25, "sample_limit": 10}, {"name": "c", "path": str(tmp_path / "c"), "weight": 0}, {"name": "d", "path": "d/0.jsonl"}, {"name": "e", "path": "e", "enabled": False}]
    (tmp_path / "m.json").write_text(json.dumps({"datasets": entries}))
    rows = mixture.load(spark, str(tmp_path / "m.json"), split=50).collect()
    assert {(r.source, r.record_index, r.copy_no) for r in mixture.load(spark, str(tmp_path / "m.json"), split=1 << 20).collect()} == {(r.source, r.record_index, r.copy_no) for r in rows}
    assert all(json.loads(r.value) == {"at": r.source, "i": r.record_index} for r in rows)
    by = {s: sorted((r.record_index, r.copy_no) for r in rows if r.source == s) for s in "abcde"}
    assert len(by["a"]) == len(set(by["a"])) == 20 and {k for _, k in by["a"]} == {1}
    assert len(by["b"]) == 22 and len({i for i, _ in by["b"]}) == 10 and sorted({k for _, k in by["b"]}) == [1, 2, 3]
    assert by["c"] == by["e"] == [] and by["d"] == [(i, 1) for i in range(5)]
    assert mixture.load(spark, str(tmp_path / "m.json"), seed="8").select("record_index").where("source = 'a'").collect() != [(i,) for i, _ in by["a"]]
    assert mixture.load(spark, str(tmp_path / "m.json"), columns=["source"]).groupBy("source").count().count() == 3
    (tmp_path / "none.json").write_text(json.dumps({"datasets": [{"name": "c", "path": "c", "weight": 0}]}))
    with pytest.raises(ValueError, match="selects no records"):
        mixture.load(spark, str(tmp_path / "none.json"))


def test_shares():
    assert [(s.base, s.copies, s.extra) for s in (mixture.share(n, w, m, "") for n, w, m in [(10, 0.25, None), (10, 0.35, None), (1, 0.01, None), (0, 2.5, None), (10, 3, 4), (10, 1.5, 0), (5, 0, None)])] == [(10, 0, 2), (10, 0, 4), (1, 0, 1), (0, 2, 0), (4, 3, 0), (0, 1, 0), (5, 0, 0)]


def test_no_task_reads_a_whole_file(spark, tmp_path, monkeypatch):
    """Numbers over files come without a shuffle of texts, and there are more files where documents are read in more splits."""
    from tessera.plans import corpus
    from tessera.sources import readers

    spark.createDataFrame([(f"t{i}",) for i in range(40)], "text string").repartition(3).write.parquet(str(tmp_path / "p"))
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.files.maxPartitionBytes": "8k", "spark.sql.files.openCostInBytes": "0"}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        rows = readers.over_files(readers.parquet_texts(spark, str(tmp_path / "p")), "row_no", 1)
        assert sorted(r.n for r in rows.select("n").collect()) == list(range(1, 41))
        assert "SortMergeJoin" not in rows._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(corpus, "scratch", lambda _: str(tmp_path / "s"))
        found = corpus.converted_chunks(spark, "/root/testdata/sf0.001")
        assert len([f for f in os.listdir(tmp_path / "s" / "p") if f.endswith(".parquet")]) > 5
        ids = [r.id for r in found.select("id").collect()]
        assert len(set(ids)) == len(ids) > 200
    finally:
        for k in names:
            spark.conf.unset(k)


def test_a_task_that_outlives_an_abort_leaves_nothing(tmp_path, monkeypatch):
    import pyarrow as pa
    import pyspark

    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda _: type("Own", (), {"partitionId": lambda _: 0, "taskAttemptId": lambda _: 0})()))
    batch = pa.RecordBatch.from_pydict({"value": pa.array(["a"]), "error_code": pa.array([None], pa.string())})
    own = sink.RecordWriter(str(tmp_path / "o"), True)

    def late():
        own.abort([])
        yield batch

    with pytest.raises(OSError):
        own.write(late())
    assert os.listdir(tmp_path / "o") == []
