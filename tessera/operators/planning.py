"""Small plans as tables: layer groups, placement on devices, differences of settings, windows of training, rotary tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def layer_groups(layers: DataFrame, share: int) -> DataFrame:
    """Adds group_id, slot and updates to layers (layer, block_type): attention layers share groups of ``share``, others have their own after these."""
    attention = F.col("block_type") == "attention"
    nth = F.row_number().over(Window.partitionBy("block_type").orderBy("layer")) - 1
    groups = F.ceil(F.sum(F.when(attention, 1).otherwise(0)).over(Window.partitionBy(F.lit(0))) / share)
    own = layers.withColumn("group_id", F.when(attention, F.floor(nth / share)).otherwise(groups + nth).cast("long"))
    first = F.min("layer").over(Window.partitionBy("group_id"))
    own = own.withColumn("_first", first)
    return own.withColumn("slot", (F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("_first")) - 1).cast("long")).withColumn("updates", F.col("layer") == F.col("_first")).drop("_first")


def placed(layers: DataFrame, devices: DataFrame) -> DataFrame:
    """Adds device to layers (layer): the first of the devices (device, ordinal, memory) whose memory, summed up to it, reaches the
    layer's middle; unknown memory counts 1."""
    up_to = Window.partitionBy(F.lit(0)).orderBy("ordinal")
    own = devices.withColumn("_w", F.coalesce(F.col("memory").cast("double"), F.lit(1.0))).withColumn("_sum", F.sum("_w").over(up_to))
    own = own.withColumn("_total", F.sum("_w").over(Window.partitionBy(F.lit(0)))).withColumn("_last", F.max("ordinal").over(Window.partitionBy(F.lit(0))))
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    both = layers.withColumn("_n", n).join(F.broadcast(own), ((F.col("layer") + 0.5) / F.col("_n") * F.col("_total") <= F.col("_sum")) | (F.col("ordinal") == F.col("_last")))
    return both.groupBy(*layers.columns).agg(F.min_by("device", "ordinal").alias("device"))


def placed_by_hand(layers: DataFrame, spec: DataFrame, visible: DataFrame) -> DataFrame:
    """Adds device to layers (layer) from ``spec`` (layer, device); fails if a layer has none, if ``spec`` has layers that aren't there, or
    a device isn't visible (device)."""
    fail = lambda bad, said, fine: F.when(bad, F.raise_error(said).cast("string")).otherwise(fine)
    own = layers.join(spec.withColumn("_spec", F.col("layer")), "layer", "full").join(visible.select("device", F.lit(True).alias("_seen")), "device", "left")
    device = fail(F.col("device").isNull(), F.concat(F.lit("no device for layer "), F.col("layer").cast("string")), F.col("device"))
    device = fail(F.col("device").isNotNull() & F.col("_seen").isNull(), F.concat(F.lit("device isn't visible: "), F.col("device")), device)
    known = layers.select("layer", F.lit(True).alias("_layer"))
    own = own.join(known, "layer", "left")
    device = fail(F.col("_layer").isNull(), F.concat(F.lit("no such layer: "), F.col("layer").cast("string")), device)
    return own.select(*[c for c in layers.columns], device.alias("device"))


def device_maps(specs: DataFrame, key: str, spec: str, layers: str, strict: bool = False) -> DataFrame:
    """Placements of device maps of any shape: ``key``, part (a layer's number or a module's name), device, error. A map (a variant) is a list of devices, or an object whose
    layers are a list or an object by number, with devices of modules by name, and of embedding, lm_head and final_norm. A map that doesn't fit the
    number of ``layers`` is one row with its error, or fails with ``strict``; so does a device that isn't a string."""
    own = specs.select(key, F.col(spec).alias("_v"), F.col(layers).cast("int").alias("_n"))
    kind = lambda v: F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0)
    get = lambda name: F.try_variant_get("_v", f"$.{name}", "variant")
    own = own.withColumn("_layers", F.when(kind("_v") == "ARRAY", F.col("_v")).when(kind("_v") == "OBJECT", get("layers")))
    as_list, as_map = F.try_variant_get("_layers", "$", "array<variant>"), F.try_variant_get("_layers", "$", "map<string,variant>")
    numbers = F.when(F.col("_n") > 0, F.sequence(F.lit(0), F.col("_n") - 1)).otherwise(F.array().cast("array<int>"))
    missing = F.filter(numbers, lambda i: ~F.map_contains_key(as_map, i.cast("string")))
    error = (
        F.when(F.col("_v").isNull() | ~kind("_v").isin("ARRAY", "OBJECT"), "neither a list nor an object").when(F.col("_layers").isNull() | (kind("_layers") == "VOID"), "no layers")
        .when((kind("_layers") == "ARRAY") & (F.size(as_list) != F.col("_n")), F.concat(F.size(as_list).cast("string"), F.lit(" devices for "), F.col("_n").cast("string"), F.lit(" layers")))
        .when((kind("_layers") == "OBJECT") & (F.size(missing) > 0), F.concat(F.lit("no device for layers "), F.array_join(missing.cast("array<string>"), ", ")))
        .when(~kind("_layers").isin("ARRAY", "OBJECT"), "layers are neither a list nor an object")
    )
    one = lambda part, v: F.struct(part.alias("part"), v.alias("v"))
    parts = F.when(kind("_layers") == "ARRAY", F.transform(as_list, lambda v, i: one(i.cast("string"), v))).otherwise(F.transform(numbers, lambda i: one(i.cast("string"), F.element_at(as_map, i.cast("string")))))
    named = F.transform(F.map_entries(F.coalesce(F.try_variant_get("_v", "$.modules", "map<string,variant>"), F.create_map().cast("map<string,variant>"))), lambda e: one(e["key"], e["value"]))
    more = F.filter(F.array(*[one(F.lit(c), get(c)) for c in ("embedding", "lm_head", "final_norm")]), lambda x: x["v"].isNotNull())
    named = F.concat(F.filter(named, lambda x: ~F.exists(more, lambda y: y["part"] == x["part"])), more)
    out = own.withColumn("error", error).select(key, "error", F.explode_outer(F.when(F.col("error").isNull(), F.concat(parts, F.when(kind("_v") == "OBJECT", named).otherwise(F.filter(named, lambda _: F.lit(False)))))).alias("p"))
    text = F.when(kind("p.v") == "STRING", F.trim(F.try_variant_get("p.v", "$", "string")))
    said = F.coalesce("error", F.when(text.isNull() | (text == ""), F.concat(F.lit("no device: "), F.col("p.part"))))
    out = out.select(key, F.col("p.part").alias("part"), F.when(said.isNull(), text).alias("device"), said.alias("error"))
    fine = F.when(F.col("error").isNull(), F.lit(True)).otherwise(F.raise_error(F.col("error")).cast("boolean"))
    return out.where(fine) if strict else out


def ranges(df: DataFrame, order: str, value: str) -> DataFrame:
    """first, last and value of runs of equal values."""
    w = Window.partitionBy(F.lit(0)).orderBy(order)
    own = df.withColumn("_new", F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1))
    own = own.withColumn("_run", F.sum("_new").over(w))
    return own.groupBy("_run", value).agg(F.min(order).alias("first"), F.max(order).alias("last")).drop("_run")


def differences(current: DataFrame, saved: DataFrame, key: str, value: str) -> DataFrame:
    """Keys of ``current`` whose saved value isn't equal, <missing> where there is none; keys that only ``saved`` has don't count."""
    own = saved.select(F.col(key).alias("_key"), F.col(value).alias("saved"), F.lit(True).alias("_there"))
    both = current.join(own, F.col(key) == F.col("_key"), "left").where(F.col("_there").isNull() | ~F.col(value).eqNullSafe(F.col("saved")))
    return both.select(key, F.col(value).alias("current"), F.when(F.col("_there"), F.col("saved")).otherwise("<missing>").alias("saved"))


def window_choice(batches: DataFrame, batch: str, lengths: list[int], weights: list[float], seed: str, evaluating: bool = False) -> DataFrame:
    """Adds window_length by weights and a hash of the batch; the longest when evaluating, or if there is one length only."""
    if evaluating or len(lengths) == 1:
        return batches.withColumn("window_length", F.lit(max(lengths)))
    total, below = sum(weights), 0.0
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(batch).cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    own, last = None, max(i for i, w in enumerate(weights) if w > 0)
    for i, (n, w) in enumerate(zip(lengths, weights, strict=True)):
        below += w / total
        if w > 0 and i < last:
            own = F.when(u < below, n) if own is None else own.when(u < below, n)
    return batches.withColumn("window_length", F.lit(lengths[last]) if own is None else own.otherwise(lengths[last]))


def rotary(positions: Column, factors: list[float], head: int, base: float = 10000.0, scale: float = 1.0, original: int = 4096, policy: str = "su") -> Column:
    """(dim, cos, sin) of a position for each pair of dimensions, with scaled frequencies and magnitude."""
    if scale <= 1:
        size = F.lit(1.0)
    elif policy == "su":
        size = F.sqrt(1 + F.log(F.lit(scale)) / F.log(F.lit(float(original))))
    else:
        size = 0.1 * F.log(F.lit(scale)) + 1.0
    own = F.array(*[F.struct(F.lit(i).alias("dim"), F.lit(f).alias("factor")) for i, f in enumerate(factors)])

    def of(x: Column) -> Column:
        angle = positions / (x["factor"] * F.pow(F.lit(base), 2.0 * x["dim"] / head))
        return F.struct(x["dim"].alias("dim"), (F.cos(angle) * size).alias("cos"), (F.sin(angle) * size).alias("sin"))

    return F.transform(own, of)


def dynamic_factors(factors: Column, length: Column, original: int, longest: int) -> Column:
    """Factors for a sequence of some length: none of their effect at the original length, all of it at the longest."""
    share = (length / original - 1) / (longest / original - 1)
    return F.transform(factors, lambda f: 1 + (f - 1) * share)


def rotary_mixed(positions: Column, factors: list[float], head: int, start: int, **options: float) -> Column:
    """As ``rotary``, but positions before ``start`` keep the unscaled tables."""
    plain = rotary(positions, [1.0] * len(factors), head, base=options.get("base", 10000.0))
    return F.when(positions < start, plain).otherwise(rotary(positions, factors, head, **options))


def relative_decay(head: Column, heads: int, distance: Column) -> Column:
    """How much of a token a head keeps over a distance; nothing of later tokens. Rates are 1 - 2 ** -n, n from 5 to 9 over the heads."""
    rate = 1 - F.pow(F.lit(2.0), -5.0 - head * (4.0 / max(1, heads - 1)))
    return F.when(distance >= 0, F.pow(rate, distance)).otherwise(0.0)


def position_scale(positions: Column, pair: Column, size: int, base: float = 512.0, down: bool = False) -> Column:
    """What a pair of dimensions of queries is scaled by at a position (keys: ``down``). 0.4 and 1.4."""
    return F.pow((2.0 * pair + 0.4 * size) / (1.4 * size), (-1.0 if down else 1.0) * positions / base)
