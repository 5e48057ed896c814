"""Aggregates of training and evaluation: losses, rates, schedules, factors, parameters, and their reports."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.ids import IGNORED

from .ordering import running

#: Fixed value: losses from which a perplexity counts as too large.
OVERFLOW = 80.0


def perplexity(loss: Column, too_large: Column) -> Column:
    return F.when(loss < OVERFLOW, F.exp(loss)).otherwise(too_large)


def evaluation(df: DataFrame, groups: list[str], loss: str, tokens: str) -> DataFrame:
    """loss and perplexity (infinite beyond the limit) over batches that have a loss sum and supervised tokens; fails without tokens."""
    own = df.groupBy(*groups).agg(F.sum(loss).alias("loss_sum"), F.sum(tokens).alias("tokens"), F.count(F.lit(1)).alias("batches"))
    mean = F.when(F.col("tokens") > 0, F.col("loss_sum") / F.col("tokens")).otherwise(F.raise_error(F.lit("no supervised tokens")).cast("double"))
    return own.select(*groups, "batches", "tokens", mean.alias("eval_loss"), perplexity(mean, F.lit(math.inf)).alias("eval_ppl"))


def language_model_loss(logits: Column, labels: Column) -> Column:
    """(loss_sum, tokens, mean_loss) of a sequence: position t predicts label t + 1, and IGNORED labels don't count. logits are an array
    for each position. The mean of no token is NaN."""
    last = F.size(labels) - 1
    pairs = F.when(last > 0, F.zip_with(F.slice(logits, 1, last), F.slice(labels, 2, last), lambda x, y: F.struct(x.alias("x"), y.alias("y"))))
    used = F.coalesce(F.filter(pairs, lambda p: p["y"] != IGNORED), F.array())

    def surprise(p: Column) -> Column:
        top = F.array_max(p["x"]).cast("double")
        total = F.aggregate(p["x"], F.lit(0.0), lambda a, v: a + F.exp(v.cast("double") - top))
        return top + F.log(total) - F.get(p["x"], p["y"]).cast("double")

    loss, n = F.aggregate(used, F.lit(0.0), lambda a, p: a + surprise(p)), F.size(used)
    return F.struct(loss.alias("loss_sum"), n.alias("tokens"), F.when(n > 0, loss / n).otherwise(math.nan).alias("mean_loss"))


def window_perplexity(df: DataFrame, size: str, nll: str, tokens: str) -> DataFrame:
    """By window size; null beyond the limit and without tokens."""
    own = df.groupBy(size).agg(F.sum(nll).alias("nll_sum"), F.sum(tokens).alias("tokens"), F.count(F.lit(1)).alias("windows"))
    mean = F.when(F.col("tokens") > 0, F.col("nll_sum") / F.col("tokens"))
    return own.select(size, "windows", "tokens", mean.alias("avg_nll"), F.when(mean <= OVERFLOW, F.exp(mean)).alias("ppl"))


def generation_rates(df: DataFrame, groups: list[str]) -> DataFrame:
    """Of samples with status, matched, latency: counts, the share of matches among all, mean latency of those that ran."""
    fine = F.col("status") == "ok"
    return df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(fine).alias("succeeded"), F.count_if(~fine).alias("failed"),
        (F.count_if(fine & F.col("matched")) / F.count(F.lit(1))).alias("exact_match_rate"), F.avg(F.when(fine, F.col("latency"))).alias("avg_latency"),
    )


def accumulated(df: DataFrame, epoch: str, batch: str, every: int, loss: str, tokens: str) -> DataFrame:
    """Optimizer steps of each epoch: every ``every`` batches (from 1), and the rest at its end."""
    return df.groupBy(epoch, F.floor((F.col(batch) - 1) / every).alias("step")).agg(F.avg(loss).alias("mean_loss"), F.sum(tokens).alias("tokens"), F.count(F.lit(1)).alias("batches"))


def logged(df: DataFrame, epoch: str, step: str, every: int, values: list[str]) -> DataFrame:
    """Means over steps between logs: at steps that ``every`` divides, and at an epoch's end."""
    return df.groupBy(epoch, F.ceil(F.col(step) / every).alias("log_no")).agg(F.max(step).alias("last_step"), F.count(F.lit(1)).alias("steps"), *[F.avg(v).alias(f"mean_{v}") for v in values])


def log_rates(df: DataFrame, epoch: str, step: str, every: int, seconds: Column, amounts: list[str]) -> DataFrame:
    """What goes through between logs: for each of ``amounts`` its sum and its sum a second (``<amount>_per_sec``), over the same steps as ``logged``. seconds: what
    a step took; an interval counts a microsecond at least."""
    took = F.greatest(F.lit(1e-6), F.sum(seconds))
    out = df.groupBy(epoch, F.ceil(F.col(step) / every).alias("log_no"))
    return out.agg(F.max(step).alias("last_step"), took.alias("seconds"), *[F.sum(a).alias(a) for a in amounts], *[(F.sum(a) / took).alias(f"{a}_per_sec") for a in amounts])


def running_totals(df: DataFrame, block: Column, order: list[Column], values: list[str]) -> DataFrame:
    """Adds <value>_seen: the sum up to each row, itself included."""
    own = running(df, block, order, {f"{v}_seen": F.col(v) for v in values})
    return own.withColumns({f"{v}_seen": F.col(f"{v}_seen") + F.col(v) for v in values})


def norm(values: Column) -> Column:
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def factor_summary(values: Column) -> Column:
    """count, distinct, least, most, mode, and the value of uniform factors."""
    distinct = F.array_distinct(values)
    uniform = F.size(distinct) == 1
    return F.struct(
        F.size(values).alias("count"), F.size(distinct).alias("unique_count"), F.array_min(values).alias("min"), F.array_max(values).alias("max"),
        F.when(values.isNull() | (F.size(values) == 0), "missing").when(uniform, "uniform").otherwise("per_dimension").alias("mode"), F.when(uniform, distinct[0]).alias("uniform_value"),
    )


def learning_rates(spark: SparkSession, batches: int, every: int, epochs: int, warmup: float, peak: float) -> DataFrame:
    """step, lr: linear to the peak, then half a cosine to 0."""
    total = max(1, math.ceil(batches / every) * epochs)
    first = int(total * warmup)
    done = (F.col("step") - first) / F.lit(float(max(1, total - first)))
    rate = F.when(F.col("step") < first, F.col("step") / F.lit(float(max(1, first)))).otherwise(F.greatest(F.lit(0.0), 0.5 * (1 + F.cos(F.lit(math.pi) * done))))
    return spark.range(total).select(F.col("id").alias("step"), (peak * rate).alias("lr"))


def throughput(df: DataFrame, mode: str) -> DataFrame:
    """By mode, of batches with active and padded tokens, samples, ms: utilisation and rates."""
    own = df.groupBy(mode).agg(*[F.sum(c).alias(c) for c in ("active_tokens", "padded_tokens", "samples", "ms")], F.count(F.lit(1)).alias("batches"))
    seconds = F.greatest(F.col("ms") / 1000, F.lit(1e-9))
    return own.select(mode, "batches", "active_tokens", "padded_tokens", (F.col("active_tokens") / F.greatest("padded_tokens", F.lit(1))).alias("utilisation"), (F.col("active_tokens") / seconds).alias("active_per_s"), (F.col("samples") / seconds).alias("samples_per_s"))


def compared(rates: DataFrame, mode: str, new: str, old: str) -> DataFrame:
    """Speedup and gain of mode ``new`` over ``old``."""
    of = lambda m, c: F.max(F.when(F.col(mode) == m, F.col(c)))
    ratio = lambda c: of(new, c) / F.greatest(of(old, c), F.lit(1e-9))
    return rates.agg(ratio("active_per_s").alias("speedup"), (of(new, "utilisation") - of(old, "utilisation")).alias("utilisation_gain"))


def decay_groups(params: DataFrame) -> DataFrame:
    """Adds group of parameters (name, module_class, dims, trainable): decay, no_decay, or frozen."""
    cls = F.lower("module_class")
    none = F.element_at(F.split("name", r"\."), -1).endswith("bias") | cls.isin("embedding", "groupnorm") | F.contains(cls, F.lit("norm"))
    return params.withColumn("group", F.when(~F.col("trainable"), "frozen").when(none, "no_decay").when((cls == "linear") | (F.col("dims") >= 2), "decay").otherwise("no_decay"))


def markdown_table(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """One row, markdown: a table of the rows (a report's, which are few) in order, - for null."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |"))
    rows = df.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))).alias("rows"))
    head = f"| {' | '.join(columns)} |\n|{'---|' * len(columns)}\n"
    return rows.select(F.concat(F.lit(head), F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).alias("markdown"))


def scalars(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Long form of numeric metrics: keys, metric, value."""
    return df.select(*keys, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(keys, values, "metric", "value").where("value IS NOT NULL")


def last_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
