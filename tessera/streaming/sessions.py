"""Running token totals of conversations over a stream of turns, with state by conversation.

The state of a conversation is four numbers, however long it is. A turn that takes the total beyond the length that a model was trained for is marked once, as
from there on its positions must be scaled. State that isn't touched for a while expires, and a conversation that comes back after that starts anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: What keeps the state of such a query.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "conv_id long, turn long, tokens long, total long, turns long, crossed boolean"


class Totals(StatefulProcessor):
    """Rows (conv_id, turn, tokens) to OUT. A turn that was seen before, or an earlier one, counts no more: files that are delivered twice change nothing."""

    def __init__(self, length: int, expiry_ms: int | None):
        self.length, self.expiry_ms = length, expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("totals", "total long, turns long, last long", self.expiry_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows)).sort_values("turn", kind="stable").drop_duplicates("turn")  # the turns of one batch
        total, turns, last = self.state.get() if self.state.exists() else (0, 0, None)
        if last is not None:
            own = own[own["turn"] > last]
        if own.empty:
            return
        sums = total + own["tokens"].cumsum()
        out = pd.DataFrame({"conv_id": key[0], "turn": own["turn"], "tokens": own["tokens"], "total": sums, "turns": turns + 1 + pd.RangeIndex(len(own)), "crossed": (sums > self.length) & (sums - own["tokens"] <= self.length)})
        self.state.update((int(sums.iloc[-1]), turns + len(own), int(own["turn"].iloc[-1])))
        yield out

    def close(self) -> None:
        pass


def running_sessions(turns: DataFrame, length: int, expiry_ms: int | None = None) -> DataFrame:
    """A stream (conv_id, turn, tokens), whose turns come in order but for those of one batch, to OUT. ``STORE`` must be the session's state store.
    expiry_ms: for queries that keep running (one that takes what is there and stops doesn't end while state can expire)."""
    fine = turns.where("conv_id IS NOT NULL AND turn IS NOT NULL").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens"))
    return fine.groupBy("conv_id").transformWithStateInPandas(Totals(length, expiry_ms), OUT, "append", "ProcessingTime" if expiry_ms else "none")


def sessions(turns: DataFrame, length: int) -> DataFrame:
    """The same of a table, all at once. A conversation's turns are bounded."""
    fine = turns.where("conv_id IS NOT NULL AND turn IS NOT NULL").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens")).dropDuplicates(["conv_id", "turn"])
    by = Window.partitionBy("conv_id").orderBy("turn")
    out = fine.withColumns({"total": F.sum("tokens").over(by), "turns": F.row_number().over(by).cast("long")})
    return out.withColumn("crossed", (F.col("total") > length) & (F.col("total") - F.col("tokens") <= length)).select("conv_id", "turn", "tokens", "total", "turns", "crossed")


def follow(spark: SparkSession, folder: str, out: str, checkpoint: str, length: int, files: int | None = None) -> StreamingQuery:
    """Takes the Parquet files of turns (conv_id, turn, tokens) that are in ``folder``, oldest first and ``files`` a batch, and stops; run again it takes what is
    new. Batches are committed to ``out`` once each."""
    source = spark.readStream.schema("conv_id long, turn long, tokens long")
    source = source.option("maxFilesPerTrigger", files) if files else source
    own = running_sessions(source.parquet(folder), length)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STORE)
    try:  # a query keeps the settings that it starts with
        return own.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before)
