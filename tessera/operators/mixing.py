"""Mixing corpora by weights and limits, deterministic samples, splits and shuffles. Ranks are by md5 of seed and ordinal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ordering import DIGITS, ordinal, pick_lowest


def hashed(seed: str, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), *[p.cast("string") for p in parts]))


def plan(df: DataFrame, weights: DataFrame, corpus: str) -> DataFrame:
    """For each corpus in ``weights`` (corpus, weight, sample_limit, enabled): rows, base (after the limit), copies, extra.

    A limit comes first. A weight of 0 takes none, under 1 a share (rounded half to even, at least one), and above 1 so many
    copies and a share of the rest. Entries that aren't enabled, where enabled is false, don't count.
    """
    counts = df.groupBy(corpus).agg(F.count(F.lit(1)).alias("rows"))
    own = counts.join(F.broadcast(weights.where(~F.col("enabled").eqNullSafe(False))), corpus)
    base = F.least("rows", F.coalesce("sample_limit", "rows"))
    own = own.withColumn("base", base).withColumn("copies", F.floor("weight"))
    part = F.col("weight") - F.col("copies")
    share = F.greatest(F.lit(1), F.bround(F.col("base") * part).cast("long"))
    return own.withColumn("extra", F.when((part > 0) & (F.col("base") > 0), share).otherwise(0)).select(corpus, "rows", "base", "copies", "extra")


def weighted_summary(mix: DataFrame, kinds: list[str]) -> DataFrame:
    """How many records of a mix there are by each of ``kinds`` (type, source), copies included, in one pass: kind, name, records."""
    named = F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(k, F.lit("<unknown>")).alias("name")) for k in kinds])
    return mix.select(F.explode(named).alias("_k")).groupBy("_k.kind", "_k.name").agg(F.count(F.lit(1)).alias("records"))


def mixed(df: DataFrame, plans: DataFrame, corpus: str, order: str, seed: str) -> DataFrame:
    """Rows with copy_no; copies are made last. Picks of limit and of share are by different hashes. plans: as ``plan`` gives them, a row for
    each corpus that weights name; they are made once, and tell which corpora need a pick at all."""
    spark, rows = df.sparkSession, plans.select(corpus, "rows", "base", "copies", "extra").collect()
    schema = plans.select(corpus, F.col("base").alias("n")).schema

    def wanted(some: list[tuple]) -> DataFrame:
        return F.broadcast(spark.createDataFrame(some, schema))

    def picked(rows_: DataFrame, name: str, some: list[tuple]) -> DataFrame:
        key = hashed(f"{seed}:{name}", F.col(corpus), F.col(order))
        return pick_lowest(rows_.withColumn("_key", key), [corpus], "_key", wanted(some)).drop("_key")

    limited = df.join(wanted([(r[0], r["base"]) for r in rows if r["base"] == r["rows"]]), corpus).select(df.columns)
    if cut := [(r[0], r["base"]) for r in rows if r["base"] < r["rows"]]:
        limited = limited.unionByName(picked(df, "limit", cut))
    copies = wanted([(r[0], r["copies"]) for r in rows if r["copies"] > 0])
    out = limited.join(copies, corpus).withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("n")
    if extra := [(r[0], r["extra"]) for r in rows if r["extra"] > 0]:
        out = out.unionByName(picked(limited, "extra", extra).withColumn("copy_no", F.lit(0)))
    return out


def sample(df: DataFrame, n: int, order: str, seed: str) -> DataFrame:
    """Exactly ``n`` rows (all if there are fewer), in no order."""
    wanted = df.sparkSession.createDataFrame([(n,)], "n long")
    return pick_lowest(df.withColumn("_key", hashed(seed, F.col(order))), [], "_key", wanted).drop("_key")


def split(df: DataFrame, n: int, order: str, seed: str) -> DataFrame:
    """Adds held: true for exactly ``n`` rows."""
    held = sample(df.select(order), n, order, seed).select(order, F.lit(True).alias("held"))
    return df.join(held, order, "left").withColumn("held", F.coalesce("held", F.lit(False)))


def shuffled(df: DataFrame, order: str, seed: int, epoch: int) -> DataFrame:
    """Adds place: a permutation by hash, of its own in each epoch."""
    key = hashed(str(seed + epoch), F.col(order))
    return ordinal(df.withColumn("_key", key), F.substring("_key", 1, DIGITS), [F.col("_key"), F.col(order)], "place").drop("_key")


def buffer_shuffled(df: DataFrame, order: str, size: int, seed: str) -> DataFrame:
    """Adds place: a shuffle within a buffer. Rows come in the order of the number ``order``, and each is held back by less than ``size``
    rows, as its hash says, so that what was near stays near; up to a size of 1 the order stays."""
    own = ordinal(df, order, [F.col(order)], "_ordinal")
    if size <= 1:
        return own.withColumnRenamed("_ordinal", "place")
    back = F.conv(F.substring(hashed(seed, F.col(order)), 1, 8), 16, 10).cast("double") / 2.0**32 * size
    own = own.withColumn("_when", F.col("_ordinal") + F.floor(back))
    return ordinal(own, "_when", [F.col("_when"), F.col("_ordinal")], "place").drop("_when", "_ordinal")


def slot_shuffled(df: DataFrame, order: str, size: int, seed: str) -> DataFrame:
    """Adds place: a shuffle through a buffer of ``size`` rows. Rows come in the order of the number ``order`` and fill the buffer; each further one draws a
    slot, takes the place of the row there, and that one leaves. What is left at the end leaves shuffled. Up to a size of 1 the order stays.

    A row leaves when its slot is drawn next, so that no task replays the buffer: rows of a slot follow one another, and there are ``size`` slots.
    Draws are by hash of seed and ordinal.
    """
    own = ordinal(df, order, [F.col(order)], "_ordinal")
    if size <= 1:
        return own.withColumnRenamed("_ordinal", "place")
    key = hashed(seed, F.col("_ordinal"))
    drawn = F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / 2.0**32 * size)
    own = own.withColumns({"_slot": F.when(F.col("_ordinal") < size, F.col("_ordinal")).otherwise(drawn), "_key": key})
    own = own.withColumn("_next", F.lead("_ordinal").over(Window.partitionBy("_slot").orderBy("_ordinal")))
    first = F.col("_next") - size
    left = own.where("_next IS NULL").select("_ordinal", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_key", "_ordinal")) - 1).alias("_rank"))  # ``size`` rows at most
    rows = df.agg(F.greatest(F.count(F.lit(1)) - size, F.lit(0)).alias("_before"))
    out = own.join(F.broadcast(left), "_ordinal", "left").crossJoin(F.broadcast(rows))
    return out.withColumn("place", F.coalesce(first, F.col("_before") + F.col("_rank"))).drop("_ordinal", "_slot", "_key", "_next", "_rank", "_before")


def weights_table(spark: SparkSession, rows: list[tuple[str, float, int | None, bool | None]]) -> DataFrame:
    return spark.createDataFrame(rows, "source string, weight double, sample_limit long, enabled boolean")
