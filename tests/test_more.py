import json
import math

import pytest
from pyspark.sql import functions as F

from tessera import convert, options
from tessera.functions import ids, tokenizers
from tessera.functions.text import BOS, EOS, PAD
from tessera.operators import chat, encode, metrics, mixing, ordering, planning, records
from tessera.sources import readers

JSON = "/opt/tokenizers/byte_bpe_50k.json"


def test_sparse_ids_have_few_blocks(spark):
    df = spark.range(3000).select((F.xxhash64("id")).alias("id"), F.lit(2).alias("v"))
    own = ordering.by_range(df, "id")
    assert own.select("_block").distinct().count() <= ordering.BLOCKS
    rows = sorted(ordering.running(df, "id", [F.col("id")], F.col("v"), "before").collect())
    assert [r.before for r in rows] == list(range(0, 6000, 2))
    near = spark.createDataFrame([(10**15 + i,) for i in range(20)] + [(-(10**15),), (None,)], "id long")
    assert [r.ordinal for r in sorted(ordering.ordinal(near, "id", [F.col("id")]).collect(), key=lambda r: r.ordinal)] == list(range(22))


def test_line_numbers_over_splits(spark, tmp_path):
    lines = [json.dumps({"id": str(i), "text": "x" * (i % 50)}) if i % 5 else "  " for i in range(1, 4000)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        out = readers.jsonl(spark, str(tmp_path / "a.jsonl"))
        assert spark.read.text(str(tmp_path / "a.jsonl")).rdd.getNumPartitions() > 3
        rows = sorted((r.line_no, r.record_index, json.loads(r.v)["id"]) for r in out.select("line_no", "record_index", F.to_json("value").alias("v")).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [i for i in range(1, 4000) if i % 5]
    assert rows == [(i, n, str(i)) for n, i in enumerate(want)]


def test_library_tokenizer_encodes_segments(spark):
    from tokenizers import Tokenizer

    plain, own = Tokenizer.from_file(JSON), tokenizers.library(JSON)
    texts = [["Hello", "", " world \n", "é中"], [], None, ["", "  "]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, parts array<string>")
    got = {r.i: r.ids for r in df.select("i", own.segments(F.col("parts")).alias("ids")).collect()}
    assert got == {i: None if x is None else [plain.encode(t, add_special_tokens=False).ids for t in x] for i, x in enumerate(texts)}
    parts = F.array(*[F.struct(F.lit(t).alias("text"), F.lit(on).alias("supervise")) for t, on in (("Hello", False), ("", True), (" you", True))])
    e = spark.range(1).select(chat.encoded(parts, 10, own).alias("e")).first().e
    a, b = (plain.encode(t, add_special_tokens=False).ids for t in ("Hello", " you"))
    assert (e.input_ids, e.labels) == (a + b, [-100] * len(a) + b)
    with pytest.raises(ValueError, match="no id for"):
        tokenizers.checked(own)
    assert tokenizers.checked(tokenizers.CHAR, {EOS: 0x110001}) is tokenizers.CHAR
    with pytest.raises(ValueError, match="and not"):
        tokenizers.checked(tokenizers.CHAR, {PAD: 5})
    with pytest.raises(ValueError, match="share"):
        tokenizers.checked(tokenizers.Tokenizer(None, {BOS: 1, EOS: 1, PAD: 2}))


def test_collated_batches(spark):
    rows = [(0, 0, [1, 2, 3], [-100, 2, 3]), (0, 1, [4], [4]), (0, 2, [5, 6], [5, -100]), (1, 0, [7], [7])]
    df = spark.createDataFrame(rows, "batch_no long, batch_pos long, input_ids array<int>, labels array<int>")
    plain = {(r.batch_no, r.batch_pos): (r.input_ids, r.labels, r.attention_mask) for r in encode.collated(df, 9, 4, multiple=4).collect()}
    assert plain == {(0, 0): ([1, 2, 3, 9], [-100, 2, 3, -100], [1, 1, 1, 0]), (0, 1): ([4, 9, 9, 9], [4, -100, -100, -100], [1, 0, 0, 0]), (0, 2): ([5, 6, 9, 9], [5, -100, -100, -100], [1, 1, 0, 0]), (1, 0): ([7, 9, 9, 9], [7, -100, -100, -100], [1, 0, 0, 0])}
    packed = {(r.batch_no, r.bin_no): (r.input_ids, r.position_ids, r.segment_ids, r.attention_mask) for r in encode.collated(df, 9, 4, pack=True).collect()}
    assert packed == {(0, 0): ([1, 2, 3, 4], [0, 1, 2, 0], [1, 1, 1, 2], [1, 1, 1, 1]), (0, 1): ([5, 6, 9, 9], [0, 1, 0, 0], [1, 1, 0, 0], [1, 1, 0, 0]), (1, 0): ([7], [0], [1], [1])}


def test_loss_of_a_sequence(spark):
    logits, labels = [[1.0, 2.0], [0.0, 0.0], [3.0, 1.0]], [0, 1, -100]
    df = spark.createDataFrame([(logits, labels), (logits, [0, -100, -100]), ([], []), ([[1.0]], [0])], "x array<array<double>>, y array<int>")
    a, b, c, d = (r.l for r in df.select(metrics.language_model_loss(F.col("x"), F.col("y")).alias("l")).collect())
    assert a.tokens == 1 and a.loss_sum == pytest.approx(math.log(math.e + math.e**2) - 2)
    assert all(x.tokens == 0 and x.loss_sum == 0 and math.isnan(x.mean_loss) for x in (b, c, d))


def test_buffer_shuffle_keeps_rows_near(spark):
    df = spark.createDataFrame([(i,) for i in range(500)], "id long").repartition(3)
    rows = {r.id: r.place for r in mixing.buffer_shuffled(df, "id", 32, "s").collect()}
    assert sorted(rows.values()) == list(range(500)) and all(abs(p - i) < 32 for i, p in rows.items()) and any(p != i for i, p in rows.items())
    assert all(r.id == r.place for r in mixing.buffer_shuffled(df, "id", 1, "s").collect())


def test_mixed_types(spark):
    rows = [("text", " a ", " t ", None, None), ("chat", None, None, [("user", " q ")], "s"), ("chat", "c", None, [("boss", "q")], " "), ("other", "d", "t", None, None), (None, "e", "t", None, None), ("text", "f", " ", None, None), ("text", "g", None, None, None)]
    df = spark.createDataFrame(rows, "type string, id string, text string, messages array<struct<role:string,content:string>>, source string")
    out = [(r.id, r.text, r.error_code) for r in records.dispatched(df).collect()]
    assert out == [("a", "t", None), (None, None, "id_missing"), ("c", None, "role_unknown"), ("d", None, "type_unknown"), ("e", None, "type_unknown"), ("f", "", "text_blank"), ("g", None, "text_missing")]
    got = records.with_defaults(records.dispatched(df, F.lit("made")), source="src", split="train")
    assert [(r.id, r.source, r.split) for r in got.limit(3).collect()] == [("a", "src", "train"), ("made", "s", "train"), ("c", "src", "train")]


def test_positions_of_any_mask(spark):
    df = spark.createDataFrame([([0, 0, 1, 1],), ([1, 0, 1],), ([0, 0],), ([],)], "m array<int>")
    assert [r.p for r in df.select(ids.positions(F.col("m")).alias("p")).collect()] == [[0, 0, 0, 1], [0, 0, 1], [0, 0], []]


def test_converters(spark, tmp_path):
    (tmp_path / "raw.jsonl").write_text("\n".join(json.dumps(x) for x in [{"content": " one ", "id": "x1", "k": 1}, {"content": ""}, {"other": 1}, {"content": "long line one\nsecond line\nthird", "split": "test"}]))
    read = lambda p: [json.loads(r.value) for r in spark.read.text(str(p)).collect()]
    assert convert.raw_text(spark, str(tmp_path / "raw.jsonl"), str(tmp_path / "o1"), "s") == {"converted": 2, "skipped": 2}
    assert [(r["id"], r["text"][:4], r["source"], r["split"]) for r in read(tmp_path / "o1")] == [("x1", "one", "s", "train"), ("s-000004", "long", "s", "test")]
    convert.raw_text(spark, str(tmp_path / "raw.jsonl"), str(tmp_path / "o2"), "s", most=15)
    assert sorted(r["id"] for r in read(tmp_path / "o2")) == ["s-000004-0001", "s-000004-0002", "s-000004-0003", "x1"]
    (tmp_path / "a.csv").write_text('title,body\nT,"b ""q""\nx"\n,only\n ,\n')
    assert convert.csv(spark, str(tmp_path / "a.csv"), str(tmp_path / "o3"), "c") == {"converted": 2, "skipped": 1}
    assert [(r["id"], r["paper_title"]) for r in sorted(read(tmp_path / "o3"), key=lambda r: r["id"])] == [("c-000001", "T"), ("c-000002", None)]
    spark.createDataFrame([("p",), (None,)], "text string").coalesce(1).write.parquet(str(tmp_path / "p"))
    assert convert.parquet(spark, str(tmp_path / "p"), str(tmp_path / "o4"), "p") == {"converted": 1, "skipped": 1}
    (tmp_path / "t.txt").write_text("whole\ntext")
    convert.main(["txt", str(tmp_path / "t.txt"), str(tmp_path / "o5"), "--source", "t"])
    assert [(r["id"], r["text"]) for r in read(tmp_path / "o5")] == [("t-000001", "whole\ntext")]
    (tmp_path / "i.jsonl").write_text(json.dumps({"instruction": "q", "context": "c", "response": "r"}) + "\n" + json.dumps({"instruction": "q", "response": " "}))
    assert convert.instructions(spark, str(tmp_path / "i.jsonl"), str(tmp_path / "o6"), "i") == {"converted": 1, "skipped": 1}
    (tmp_path / "l.json").write_text(json.dumps([f"User: hi\n\nAssistant: yo{EOS}", "Assistant: no"]))
    assert convert.legacy(spark, str(tmp_path / "l.json"), str(tmp_path / "o7"), "l") == {"converted": 1, "skipped": 1}
    assert read(tmp_path / "o7")[0]["messages"] == [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]


def test_sweep_report(spark, tmp_path):
    from tessera.operators import configs, longctx
    from tessera.sources import writers

    rates = spark.createDataFrame([("a", "needle_in_a_haystack", 2, 2, 0.5), ("a", "qa_retrieval", 1, 1, 1.0), ("b", "qa_retrieval", 1, 0, 0.0)], "name string, task_name string, samples long, succeeded long, exact_match_rate double")
    ppl = spark.createDataFrame([("a", 2048, None), ("a", 1024, 3.25)], "name string, window_size int, perplexity double")
    rows = configs.sweep_rows(longctx.sweep_results(rates, ppl))
    assert sorted(map(tuple, rows.collect())) == [("a", "ok", "0.5", "1", "1024:3.25, 2048:overflow"), ("b", "failed", "-", "-", "-")]
    writers.sweep_report(rows, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r/sweep")).count() == 2
    assert [r.value for r in spark.read.text(str(tmp_path / "r/markdown")).collect()][2:] == ["| a | ok | 0.5 | 1 | 1024:3.25, 2048:overflow |", "| b | failed | - | - | - |"]
    batches = spark.range(4).selectExpr("id div 2 AS batch_no")
    assert encode.first_batches(batches, 1).count() == 2 and encode.first_batches(batches, None).count() == 4


def test_manifest_report(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps({"type": t, "text": "x"}) for t in ("text", "text", "chat")))
    (tmp_path / "m.json").write_text(json.dumps({"datasets": [{"name": "a", "path": "a.jsonl", "weight": 2}]}))
    assert sorted(map(tuple, readers.manifest_report(spark, str(tmp_path / "m.json")).collect())) == [("source", "a", 6), ("type", "chat", 2), ("type", "text", 4)]


def test_devices_by_hand(spark):
    layers, visible = spark.range(3).select(F.col("id").alias("layer")), spark.createDataFrame([("cuda:0",), ("cuda:1",)], "device string")
    spec = lambda *rows: spark.createDataFrame(list(rows), "layer long, device string")
    assert sorted(map(tuple, planning.placed_by_hand(layers, spec((0, "cuda:0"), (1, "cuda:1"), (2, "cuda:1")), visible).collect())) == [(0, "cuda:0"), (1, "cuda:1"), (2, "cuda:1")]
    for bad in ([(0, "cuda:0"), (1, "cuda:1")], [(0, "cuda:0"), (1, "cuda:1"), (2, "cuda:7")], [(i, "cuda:0") for i in range(4)]):
        with pytest.raises(Exception):
            planning.placed_by_hand(layers, spec(*bad), visible).collect()


def test_profiles():
    own = options.PROFILES["chat_sft"].with_changes(seed=1)
    assert own.seed == 1 and own.batch_size == 16 and options.PROFILES["chat_sft"].seed == 7
