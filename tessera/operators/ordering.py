"""Ranks, running sums and exact picks over a whole table, without a window that has one partition for all rows.

A block is a coarse key that orders as the rows do; there are at most BLOCKS, whatever the number of rows and however uneven their
ids are. Blocks are counted, their counts are summed in order (one row for each block), and rows are ranked within
their block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hex digits that make a block where rows are ordered by a hash.
DIGITS = 4
#: Blocks of a table, at most.
BLOCKS = 16**DIGITS
#: Parts of a table that quantiles bound, a power of two; each is cut into BLOCKS / PARTS equal steps.
PARTS = 1024


def by_range(df: DataFrame, c: str, name: str = "_block") -> DataFrame:
    """Adds the block of the number ``c``. Quantiles bound PARTS parts of about as many rows each, and a part is cut into equal steps between its bounds: an id far off
    stretches the steps of its own part alone. Rows with one value are in one block; nulls come first. The quantiles are taken at once, in one pass
    over ``c`` that merges sketches, and are PARTS + 1 numbers."""
    cuts = ", ".join(f"{i / PARTS!r}D" for i in range(PARTS + 1))
    found = df.select(F.col(c).alias("c")).agg(F.expr(f"percentile_approx(c, array({cuts}), {10 * PARTS})")).first()[0]
    if found is None:
        return df.withColumn(name, F.lit(-1).cast("long"))
    bounds = F.split(F.lit(" ".join(map(str, found))), " ").cast(T.ArrayType(df.schema[c].dataType))
    steps = F.array(*[F.lit(PARTS >> i) for i in range(1, PARTS.bit_length())])
    part = F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(bounds, at + s) <= F.col(c), at + s).otherwise(at))  # a binary search
    least, most = F.get(bounds, F.col("_part")).cast("double"), F.get(bounds, F.col("_part") + 1).cast("double")
    step = F.floor((F.col(c).cast("double") - least) / (most - least + 1) * (BLOCKS // PARTS))
    place = F.col("_part") * (BLOCKS // PARTS) + F.greatest(F.lit(0), F.least(step, F.lit(BLOCKS // PARTS - 1)))
    return df.withColumn("_part", part).withColumn(name, F.coalesce(F.when(F.col(c).isNotNull(), place), F.lit(-1))).drop("_part")


def running(df: DataFrame, block: Column | str, order: list[Column], values: dict[str, Column] | Column, name: str = "running") -> DataFrame:
    """Adds, by their names, the sums of ``values`` (or of one, as ``name``) over all rows before each, in one pass. block: a key of at most BLOCKS values, or the name of a
    number that rows are ordered by first."""
    values = values if isinstance(values, dict) else {name: values}
    own = (by_range(df, block) if isinstance(block, str) else df.withColumn("_block", block)).withColumns({f"_value{i}": v for i, v in enumerate(values.values())})
    every = range(len(values))
    sums = own.groupBy("_block").agg(*[F.sum(f"_value{i}").alias(f"_sum{i}") for i in every])
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # BLOCKS rows at most
    sums = sums.select("_block", *[F.coalesce(F.sum(f"_sum{i}").over(before), F.lit(0)).alias(f"_before{i}") for i in every])
    within = Window.partitionBy("_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = own.withColumns({f"_sum{i}": F.coalesce(F.sum(f"_value{i}").over(within), F.lit(0)) for i in every}).join(F.broadcast(sums), "_block")
    out = out.withColumns({n: F.col(f"_sum{i}") + F.col(f"_before{i}") for i, n in enumerate(values)})
    return out.drop("_block", *[f"{x}{i}" for x in ("_value", "_sum", "_before") for i in every])


def ordinal(df: DataFrame, block: Column | str, order: list[Column], name: str = "ordinal") -> DataFrame:
    """Adds each row's place, from 0."""
    return running(df, block, order, {name: F.lit(1)}).withColumn(name, F.col(name).cast("long"))


def pick_lowest(df: DataFrame, groups: list[str], key: str, wanted: DataFrame) -> DataFrame:
    """Of each group the rows with the ``n`` lowest keys, exactly. wanted: groups and n, small; key: a column of lower-case hex digits.

    Blocks of keys are counted by group. Rows of blocks before the one that the limit falls in are in, rows after it are not, and
    only those of that block are shuffled and ranked: a group may be of any size.
    """
    df = df.withColumn("_block", F.substring(key, 1, DIGITS))
    counts = df.groupBy(*groups, "_block").agg(F.count(F.lit(1)).alias("_rows"))
    before = (Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    counts = counts.join(F.broadcast(wanted), groups) if groups else counts.crossJoin(F.broadcast(wanted))
    edge = F.max(F.struct("_block", "_rows", (F.col("n") - F.col("_before")).alias("_room")))
    edges = F.broadcast(counts.where("_before < n").groupBy(*groups).agg(edge.alias("_edge")))  # one row for each of wanted
    near = (df.join(edges, groups) if groups else df.crossJoin(edges)).where("_block <= _edge._block")
    all_in = (F.col("_block") < F.col("_edge._block")) | (F.col("_edge._rows") <= F.col("_edge._room"))
    rank = F.row_number().over(Window.partitionBy(*groups, "_block").orderBy(key))
    cut = near.where(~all_in).withColumn("_rank", rank).where("_rank <= _edge._room").drop("_rank")
    return near.where(all_in).unionByName(cut).drop("_block", "_edge")
