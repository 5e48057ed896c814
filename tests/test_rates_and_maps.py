import pytest
from pyspark.sql import functions as F

from tessera.operators import configs, metrics, mixing, planning


def test_rates_of_steps_without_time(spark):
    df = spark.createDataFrame([(0, 1, 0.0, 4), (0, 2, 0.0, 4), (0, 3, 0.5, 1)], "epoch int, step int, s double, tokens int")
    rows = sorted(metrics.log_rates(df, "epoch", "step", 2, F.col("s"), ["tokens"]).collect(), key=lambda r: r.log_no)
    assert [(r.last_step, r.tokens, r.tokens_per_sec) for r in rows] == [(2, 8, pytest.approx(8e6)), (3, 1, 2.0)]


def test_counts_of_a_mix(spark):
    df = spark.createDataFrame([("text", "a", i) for i in range(4)] + [("chat", "b", i) for i in range(3)] + [(None, "c", 0)], "type string, source string, i int")
    weights = mixing.weights_table(spark, [("a", 2.0, None, True), ("b", 1.0, 2, True), ("c", 1.0, None, None)])
    mix = mixing.mixed(df, mixing.plan(df, weights, "source"), "source", "i", "s")
    assert {tuple(r) for r in mixing.weighted_summary(mix, ["type", "source"]).collect()} == {("type", "text", 8), ("type", "chat", 2), ("type", "<unknown>", 1), ("source", "a", 8), ("source", "b", 2), ("source", "c", 1)}


def test_devices_that_must_be_visible(spark):
    visible = spark.createDataFrame([("cuda:0",), ("cuda:0",), ("cpu",)], "device string")
    assert configs.visible_only(spark.createDataFrame([("cpu", 1), ("cuda:0", 2)], "device string, k int"), visible).count() == 2
    with pytest.raises(Exception, match="isn't visible: cuda:9"):
        configs.visible_only(spark.createDataFrame([("cuda:9", 1)], "device string, k int"), visible).collect()


def test_device_maps_of_any_shape(spark):
    specs = {
        "list": ('["a", " b "]', [("0", "a", None), ("1", "b", None)]), "nested": ('{"layers": {"0": "a", "1": "b", "7": "c"}, "modules": {"norm": "a", "lm_head": "x"}, "lm_head": "b"}', [("0", "a", None), ("1", "b", None), ("lm_head", "b", None), ("norm", "a", None)]),
        "few": ('["a"]', [(None, None, "1 devices for 2 layers")]), "gap": ('{"layers": {"1": "b"}}', [(None, None, "no device for layers 0")]), "text": ('"auto"', [(None, None, "neither a list nor an object")]),
        "null": (None, [(None, None, "neither a list nor an object")]), "no": ("{}", [(None, None, "no layers")]), "odd": ('{"layers": 3}', [(None, None, "layers are neither a list nor an object")]), "number": ('["a", 5]', [("0", "a", None), ("1", None, "no device: 1")]),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in specs.items()], "k string, s string").select("k", F.parse_json("s").alias("v"), F.lit(2).alias("n"))
    found: dict = {}
    for r in planning.device_maps(df, "k", "v", "n").collect():
        found.setdefault(r.k, []).append((r.part, r.device, r.error))
    assert {k: sorted(v, key=str) for k, v in found.items()} == {k: sorted(v[1], key=str) for k, v in specs.items()}
    with pytest.raises(Exception, match="1 devices for 2 layers"):
        planning.device_maps(df.where("k = 'few'"), "k", "v", "n", strict=True).collect()
