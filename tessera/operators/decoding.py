"""Choosing the next token from logits held as arrays: penalties, top-k and nucleus filters, argmax and draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def token_rows(df: DataFrame, key: str, logits: str) -> DataFrame:
    """key, token_id, logit."""
    return df.select(key, F.posexplode(F.col(logits)).alias("token_id", "logit")).withColumn("logit", F.col("logit").cast("double"))


def nucleus(rows: DataFrame, key: str, temperature: float, k: int, p: float) -> DataFrame:
    """Adds prob to the tokens that stay: of the k highest logits (ties with the last stay), the most likely ones whose cumulative
    share is at most ``p``, at least one. Ties are in the order of ids. One row's vocabulary is one window."""
    each = Window.partitionBy(key)
    rows = rows.withColumn("scaled", F.col("logit") / temperature)
    if k > 0:
        rows = rows.withColumn("_rank", F.rank().over(each.orderBy(F.desc("scaled")))).where(F.col("_rank") <= k).drop("_rank")
    rows = rows.withColumn("_e", F.exp(F.col("scaled") - F.max("scaled").over(each)))
    rows = rows.withColumn("prob", F.col("_e") / F.sum("_e").over(each))
    down = each.orderBy(F.desc("prob"), "token_id")
    rows = rows.withColumn("_sum", F.sum("prob").over(down.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(down))
    rows = rows.where((F.col("_sum") <= p) | (F.col("_n") == 1))
    return rows.withColumn("prob", F.col("prob") / F.greatest(F.sum("prob").over(each), F.lit(1e-12))).drop("_e", "_sum", "_n", "scaled")


def penalized(logits: Column, history: Column, penalty: float, last: int) -> Column:
    """Logits of tokens among the last ``last`` of the history divided by the penalty, or multiplied if they aren't above 0."""
    size = F.size(history)
    recent = F.slice(history, F.greatest(F.lit(1), size - last + 1), F.lit(last))
    lower = lambda x: F.when(x > 0, x / penalty).otherwise(x * penalty)
    return F.transform(logits, lambda x, i: F.when(F.array_contains(recent, i.cast("int")), lower(x)).otherwise(x))


def argmax(logits: Column, pad: int | None = None) -> Column:
    """The id of the highest logit, the first of ties; ``pad`` can't win."""
    own = F.transform(logits, lambda x, i: F.struct(x.alias("x"), (-i).alias("i")))
    if pad is not None:
        own = F.filter(own, lambda s: s["i"] != -pad)
    return -F.array_max(own)["i"]


def drawn(rows: DataFrame, key: str, seed: str) -> DataFrame:
    """One token of each key by its probabilities and a uniform number from a hash."""
    uniform = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    down = Window.partitionBy(key).orderBy("token_id").rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn("_sum", F.sum("prob").over(down)).withColumn("_u", uniform)
    return own.groupBy(key).agg(F.coalesce(F.min(F.when(F.col("_sum") > F.col("_u"), F.col("token_id"))), F.max("token_id")).alias("token_id"))
