"""Settings as tables: model configurations with checks, factor candidates, sweeps, summaries of saved metadata, and device lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import strip

#: Fixed value: the version of configuration files that is read and written.
VERSION = 1
#: Ways of embedding positions.
MODES = ["static", "dynamic", "mixed"]
CONFIG = """
num_layers int, num_heads int, num_kv_heads int, head_dim int, hidden_size int, rope_base double, original_max_len int, longrope2_target_length int,
longrope2_long_factors array<double>, longrope2_factor_max_sequence_length int, layer_block_types array<string>, layer_state_group_ids array<int>,
longrope2_train_embedding_mode string, longrope2_inference_embedding_mode string
"""


def must(condition: Column, what: str, value: Column) -> Column:
    """``value``, or a failure where the condition isn't true."""
    return F.when(F.coalesce(condition, F.lit(False)), value).otherwise(F.raise_error(F.lit(what)))


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """The configuration of a file with its version, which must be VERSION."""
    df = spark.read.schema(f"model_config_schema_version int, model_config struct<{CONFIG.replace(' int', ':int').replace(' double', ':double').replace(' array', ':array').replace(' string', ':string')}>").json(path, multiLine=True)
    return df.select(must((F.col("model_config_schema_version") == VERSION) & F.col("model_config").isNotNull(), f"model_config_schema_version must be {VERSION}", F.col("model_config")).alias("c")).select("c.*")


def write_config(df: DataFrame, path: str) -> None:
    df.select(F.lit(VERSION).alias("model_config_schema_version"), F.struct(*df.columns).alias("model_config")).coalesce(1).write.mode("overwrite").json(path)


def checked(df: DataFrame) -> DataFrame:
    """Derives the hidden size, repeats a single factor for each pair of dimensions, and fails on what doesn't fit."""
    size = F.col("num_heads") * F.col("head_dim")
    factors = F.col("longrope2_long_factors")
    return df.withColumns(
        {
            "hidden_size": must(F.coalesce(F.col("hidden_size"), size) == size, "hidden_size must be num_heads * head_dim", size),
            "original_max_len": must(F.col("original_max_len") > 0, "original_max_len must be above 0", F.col("original_max_len")),
            "longrope2_target_length": must(F.col("longrope2_target_length") >= F.col("original_max_len"), "longrope2_target_length can't be under original_max_len", F.col("longrope2_target_length")),
            "layer_block_types": must(F.size("layer_block_types") == F.col("num_layers"), "layer_block_types must have num_layers", F.col("layer_block_types")),
            "longrope2_train_embedding_mode": must(F.col("longrope2_train_embedding_mode").isin(MODES), "unknown embedding mode", F.col("longrope2_train_embedding_mode")),
            "longrope2_long_factors": F.when(F.size(factors) == 1, F.array_repeat(factors[0], F.greatest(F.lit(1), F.floor(F.col("head_dim") / 2).cast("int")))).otherwise(factors),
        }
    )


def uniform_factors(longest: Column, target: Column, original: Column, head_dim: Column) -> Column:
    """One factor for each pair of dimensions: by how much the longer of both lengths exceeds the original one."""
    return F.array_repeat(F.greatest(F.greatest(longest, target) / original, F.lit(1.0)), F.floor(head_dim / 2).cast("int"))


def factors_due(config: DataFrame, longest: DataFrame) -> DataFrame:
    """Adds reuse and factors: known ones that reach the longest sample (max_tokens) stay, else they are made anew."""
    both = config.crossJoin(F.broadcast(longest.select("max_tokens")))  # one row each
    known, reach = F.col("longrope2_long_factors"), F.col("longrope2_factor_max_sequence_length")
    reuse = known.isNotNull() & (reach.isNull() | (reach >= F.col("max_tokens")))
    new = uniform_factors(F.col("max_tokens"), F.col("longrope2_target_length"), F.col("original_max_len"), F.col("head_dim"))
    return both.withColumn("reuse", reuse).withColumn("factors", F.when(reuse, known).otherwise(new)).withColumn("factor_length", F.when(reuse & reach.isNotNull(), reach).otherwise(F.col("max_tokens")))


def candidates(*parts: DataFrame) -> DataFrame:
    """All of (name, long_factors, source) in order; fails on names that repeat or are blank, and on factors that aren't above 0."""
    own = reduce(DataFrame.unionByName, [p.select(strip("name").alias("name"), "long_factors", "source", F.lit(i).alias("part")) for i, p in enumerate(parts)])
    twice = own.groupBy("name").agg(F.count(F.lit(1)).alias("_n"))
    own = own.join(twice, "name").withColumn("name", must((F.col("_n") == 1) & (F.col("name") != ""), "names of candidates must be single and not blank", F.col("name")))
    fine = (F.size("long_factors") > 0) & F.forall("long_factors", lambda x: x > 0)
    return own.withColumn("long_factors", must(fine, "factors must be above 0", F.col("long_factors"))).drop("_n")


def four_digits(c: Column) -> Column:
    """As %.4g of C and Python: without zeros at the end, which Java's keeps."""
    shown = F.format_string("%.4g", c)
    return F.when(c.isNotNull(), F.regexp_replace(F.regexp_replace(shown, r"(\.[0-9]*?)0+(e|\z)", "$1$2"), r"\.(e|\z)", "$1"))


def sweep_rows(results: DataFrame) -> DataFrame:
    """Cells of a sweep's report, of name, status, needle, retrieval (rates) and ppl (array of window_size, perplexity): four digits,
    overflow for no perplexity, - where a candidate failed."""
    ok = F.col("status") == "ok"
    rate = lambda c: F.when(ok & F.col(c).isNotNull(), four_digits(F.col(c))).otherwise("-")
    items = F.transform("ppl", lambda p: F.concat(p["window_size"].cast("string"), F.lit(":"), F.coalesce(four_digits(p["perplexity"]), F.lit("overflow"))))
    shown = F.when(ok & (F.size("ppl") > 0), F.array_join(items, ", ")).otherwise("-")
    return results.select("name", "status", rate("needle").alias("needle"), rate("retrieval").alias("retrieval"), shown.alias("ppl"))


def summary(df: DataFrame, fields: list[tuple[str, str]]) -> DataFrame:
    """The first column that is there and not null for each label: one column a label, in the order of ``fields`` (column, label)."""
    own: dict[str, list[str]] = {}
    for column, label in fields:
        if column in df.columns:
            own.setdefault(label, []).append(column)
    return df.select(*[F.coalesce(*[F.col(c) for c in cs]).alias(label) for label, cs in own.items()])


def visible_devices(value: Column) -> Column:
    """Devices of a setting: null if it is unset, none if it is blank, -1 or none, else what is between commas."""
    own = strip(value)
    parts = F.filter(F.transform(F.split(own, ","), strip), lambda x: x != "")
    return F.when(own.isNull(), F.lit(None)).when(own.isin("", "-1", "none", "None"), F.array().cast("array<string>")).otherwise(parts)


def missing_devices(wanted: DataFrame, visible: DataFrame) -> DataFrame:
    """Devices that aren't visible."""
    return wanted.join(visible, "device", "left_anti")


def visible_only(wanted: DataFrame, visible: DataFrame) -> DataFrame:
    """The devices that are wanted; fails on one that isn't visible."""
    own = wanted.join(visible.select("device", F.lit(True).alias("_seen")).distinct(), "device", "left")
    fine = F.when(F.col("_seen"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("device isn't visible: "), F.coalesce("device", F.lit("none")))).cast("boolean"))
    return own.where(fine).select(wanted.columns)


def state_slots(layers: DataFrame) -> DataFrame:
    """How many groups of layers keep a state."""
    return layers.agg(F.countDistinct("group_id").alias("slots"))


def decoded(df: DataFrame, ids: str, vocabulary: Column) -> DataFrame:
    """Adds text of ids by a map from id to token, and their number."""
    return df.withColumn("text", F.array_join(F.transform(ids, lambda i: F.element_at(vocabulary, i)), "")).withColumn("tokens", F.size(ids))
