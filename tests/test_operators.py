import pytest
from pyspark.sql import functions as F

from tessera.functions import ids
from tessera.functions import text as t
from tessera.operators import chat, decoding, encode, longctx, metrics, mixing, planning, records


def value(spark, column, **cols):
    types = ", ".join(f"{k} {v[0]}" for k, v in cols.items()) or "x int"
    row = tuple(v[1] for v in cols.values()) or (1,)
    return spark.createDataFrame([row], types).select(column.alias("out")).first()["out"]


MESSAGES = "array<struct<role:string,content:string>>"


@pytest.mark.parametrize("given", ["　a b　", "\x1c\x85 x\n", "﻿a", "", " \t", "a"])
def test_strip_is_pythons(spark, given):
    assert value(spark, t.strip("s"), s=("string", given)) == given.strip()


def test_lines_are_pythons(spark):
    given = "a\r\n b\x0bc\x1cd e\n\n f \r"
    assert value(spark, t.lines("s"), s=("string", given)) == [x.strip() for x in given.splitlines() if x.strip()]


def test_tokenizers(spark):
    assert value(spark, t.char_count("s"), s=("string", "你好")) == 2
    assert value(spark, t.char_count("s"), s=("string", t.EOS + "好")) == 2
    assert value(spark, t.char_ids("s"), s=("string", t.EOS + "好\n🙂")) == [0x110001, ord("好"), 10, 0x1F642]
    assert value(spark, t.space_tokens("s"), s=("string", "a  b\nc")) == ["a", "b", "\n", "c"]


def test_prompt_and_segments(spark):
    own = [("system", "你是助手"), ("user", "你好")]
    assert value(spark, chat.prompt(F.col("m"), ask=True), m=(MESSAGES, own)) == t.BOS + "System: 你是助手\n\nUser: 你好\n\nAssistant: "
    found = value(spark, chat.segments(F.col("m")), m=(MESSAGES, [("user", "你好"), ("assistant", "世界")]))
    assert [(s.text, s.supervise) for s in found] == [(t.BOS, False), ("\n\nUser: ", False), ("你好", False), ("\n\nAssistant: ", False), ("世界", True), (t.EOS, True)]
    assert value(spark, chat.segments(F.col("m")), m=(MESSAGES, own)) is None
    both = value(spark, chat.encoded(chat.text_segments(F.col("s"))), s=("string", "ab"))
    assert both.input_ids == both.labels == [97, 98, 0x110001]


def test_transcripts(spark):
    parse = lambda s: value(spark, F.struct(chat.parse_transcript(F.col("s")).alias("m"), chat.transcript_error(chat.parse_transcript(F.col("s"))).alias("e")), s=("string", s))
    found = parse(f"lost User:　hi Assistant: yo{t.EOS} lost User: x")
    assert [(m.role, m.content) for m in found.m] == [("user", "hi"), ("assistant", "yo"), ("user", "x")] and found.e is None
    assert parse("User: Assistant: a").e == "content_blank"
    assert parse("nothing").e == "messages_empty"
    assert parse("Assistant: a").e == "user_not_first"


def test_instructions(spark):
    ask = chat.instruction(F.col("i"), F.col("c"), F.col("r"))
    run = lambda i, c, r: value(spark, ask, i=("string", i), c=("string", c), r=("string", r))
    assert run("a", " ", "b")[0].content == "a" and run("a", "k", "b")[0].content == "a\n\n补充上下文：\nk"
    assert run("a", "k", " ") is None
    with pytest.raises(Exception, match="blank instruction"):
        run(" ", "k", "b")
    assert value(spark, chat.titled_text(F.col("b"), F.col("h")), b=("string", "x"), h=("string", "y")) == "标题：y\n\n正文：\nx"


def test_records(spark):
    df = spark.createDataFrame([("1", " a ", " "), ("2", "　", "s"), ("3", None, None), (" ", "a", None)], "id string, text string, source string")
    out = {r.text: r for r in records.normalize_text(df, record_id=F.col("id")).collect()}
    assert [(r.id, r.source, r.error_code) for r in records.normalize_text(df, record_id=F.col("id")).orderBy("id").collect()] == [("", None, "id_missing"), ("1", None, None), ("2", "s", "text_blank"), ("3", None, "text_missing")]
    assert out["a"].type == "text"
    with pytest.raises(Exception, match="bad record"):
        records.strict(records.normalize_text(df, record_id=F.col("id"))).collect()


def test_packing_is_next_fit(spark):
    df = spark.createDataFrame([(0, i, n) for i, n in enumerate([5, 4, 3, 9, 1])], "batch_no long, batch_pos long, n int")
    got = {r.batch_pos: (r.bin_no, r.bin_pos, r.position) for r in encode.packed(df, "n", 10).collect()}
    assert got == {0: (0, 0, 0), 1: (0, 1, 5), 2: (1, 0, 0), 3: (2, 0, 0), 4: (2, 1, 9)}
    with pytest.raises(Exception, match="more than 8"):
        encode.packed(df, "n", 8).collect()


@pytest.mark.parametrize("parts", [1, 7])
def test_windows_cross_records(spark, parts):
    df = spark.createDataFrame([(1, 8), (2, 8), (3, 0)], "id long, n long").repartition(parts)
    out = encode.windows(df, "n", 6, "id", [F.col("id")], "id", most=2)
    assert sorted(map(tuple, out.collect())) == [(0, 1, 0, 6), (1, 1, 6, 3), (1, 2, 0, 3)]


def test_mixing_rounds_half_even(spark):
    df = spark.createDataFrame([(s, i) for s, n in (("a", 50), ("b", 2), ("c", 4), ("d", 3)) for i in range(n)], "source string, i long")
    weights = mixing.weights_table(spark, [("a", 0.25, None, None), ("b", 0.1, None, True), ("c", 2.5, 3, True), ("d", 1.0, None, False)])
    plans = {r.source: (r.base, r.copies, r.extra) for r in mixing.plan(df, weights, "source").collect()}
    assert plans == {"a": (50, 0, 12), "b": (2, 0, 1), "c": (3, 2, 2)}
    out = mixing.mixed(df, mixing.plan(df, weights, "source"), "source", "i", "s")
    assert {r["source"]: r["count"] for r in out.groupBy("source").count().collect()} == {"a": 12, "b": 1, "c": 8}
    again = mixing.mixed(df.repartition(7), mixing.plan(df, weights, "source"), "source", "i", "s")
    assert sorted(out.collect()) == sorted(again.collect())


def test_split_and_shuffle(spark):
    df = spark.range(10).withColumnRenamed("id", "i")
    assert mixing.split(df, 3, "i", "42").groupBy("held").count().orderBy("held").collect()[0]["count"] == 7
    assert sorted(r.place for r in mixing.shuffled(df, "i", 1, 0).collect()) == list(range(10))
    assert mixing.sample(df, 99, "i", "x").count() == 10 and mixing.sample(df, 0, "i", "x").count() == 0


def test_line_chunks(spark):
    df = spark.createDataFrame([(1, "aa\nbb\n\n cccccccc \nd"), (2, " \n")], "id long, text string")
    assert [(r.chunk_no, r.chunk) for r in encode.line_chunks(df, "text", 5, ["id"]).orderBy("chunk_no").collect()] == [(1, "aa\nbb"), (2, "ccccc"), (3, "ccc"), (4, "d")]


def test_ids(spark):
    assert value(spark, ids.trimmed(F.col("a"), 1, 0), a=("array<int>", [5, 0, 1, 7])) == [5]
    assert value(spark, ids.trimmed(F.col("a"), 1, 0), a=("array<int>", [1, 7])) == []
    assert value(spark, ids.positions(F.col("a")), a=("array<int>", [0, 0, 1, 1])) == [0, 0, 0, 1]
    assert value(spark, ids.supervised(F.col("a")), a=("array<int>", [7, -100, 3])) == 1


def test_decoding(spark):
    rows = decoding.token_rows(spark.createDataFrame([(1, [1.0, 3.0, 3.0, 0.0])], "k long, x array<double>"), "k", "x")
    assert {r.token_id for r in decoding.nucleus(rows, "k", 1.0, 1, 1.0).collect()} == {1, 2}
    assert {r.token_id for r in decoding.nucleus(rows, "k", 1.0, 0, 0.1).collect()} == {1}
    assert value(spark, decoding.argmax(F.col("x"), pad=1), x=("array<double>", [1.0, 3.0, 3.0])) == 2
    assert value(spark, decoding.penalized(F.col("x"), F.col("h"), 2.0, 2), x=("array<double>", [1.0, -1.0, 4.0]), h=("array<int>", [2, 0, 1])) == [0.5, -2.0, 4.0]


def test_metrics(spark):
    df = spark.createDataFrame([("a", 790.0, 10), ("b", 810.0, 10)], "k string, loss double, n int")
    assert {r.k: r.eval_ppl == float("inf") for r in metrics.evaluation(df, ["k"], "loss", "n").collect()} == {"a": False, "b": True}
    assert {r.k: r.ppl is None for r in metrics.window_perplexity(df, "k", "loss", "n").collect()} == {"a": False, "b": True}
    for given, mode in (([2.0, 2.0], "uniform"), ([1.5, 2.0, 2.5], "per_dimension"), (None, "missing")):
        assert value(spark, metrics.factor_summary(F.col("f")), f=("array<double>", given)).mode == mode
    assert value(spark, longctx.matched("p", "e"), p=("string", " 代号 是 NIAH-1。"), e=("string", "NIAH-1"))


def test_planning(spark):
    layers = spark.range(4).withColumnRenamed("id", "layer")
    devices = spark.createDataFrame([("cuda:0", 0, 8), ("cuda:1", 1, 8)], "device string, ordinal long, memory long")
    placed = planning.placed(layers, devices)
    assert [r.device for r in placed.orderBy("layer").collect()] == ["cuda:0", "cuda:0", "cuda:1", "cuda:1"]
    assert sorted((r["first"], r["last"]) for r in planning.ranges(placed, "layer", "device").collect()) == [(0, 1), (2, 3)]
    chosen = planning.window_choice(layers, "layer", [4, 8], [0.0, 1.0], "s")
    assert {r.window_length for r in chosen.collect()} == {8}


def test_configs(spark, tmp_path):
    from tessera.operators import configs

    row = (2, 4, 2, 8, None, 1e4, 128, 256, [2.0], None, ["attention", "retnet"], None, "mixed", "dynamic")
    df = spark.createDataFrame([row], configs.CONFIG)
    own = configs.checked(df).first()
    assert own.hidden_size == 32 and own.longrope2_long_factors == [2.0] * 4
    configs.write_config(df, str(tmp_path / "c"))
    assert configs.read_config(spark, str(tmp_path / "c")).first().asDict() == df.first().asDict()
    with pytest.raises(Exception, match="num_layers"):
        configs.checked(df.withColumn("num_layers", F.lit(3))).collect()
    one = spark.createDataFrame([("a", [1.0], "x")], "name string, long_factors array<double>, source string")
    with pytest.raises(Exception, match="single"):
        configs.candidates(one, one).collect()
    sweep = spark.createDataFrame([("a", "ok", 0.5, None, [(1024, 12.0), (2048, None)]), ("b", "error", 1.0, 1.0, [])], "name string, status string, needle double, retrieval double, ppl array<struct<window_size:int,perplexity:double>>")
    assert [tuple(r) for r in configs.sweep_rows(sweep).collect()] == [("a", "ok", "0.5", "-", "1024:12, 2048:overflow"), ("b", "error", "-", "-", "-")]
    assert [tuple(r) for r in configs.summary(sweep, [("no", "x"), ("needle", "x"), ("name", "n"), ("status", "n")]).collect()] == [(0.5, "a"), (1.0, "b")]
    text = configs.decoded(spark.createDataFrame([([1, 2],)], "ids array<int>"), "ids", F.create_map(F.lit(1), F.lit("a"), F.lit(2), F.lit("b"))).first()
    assert (text.text, text.tokens) == ("ab", 2)
