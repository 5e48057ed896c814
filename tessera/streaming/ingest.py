"""New JSONL files as they come: records are checked and appended, bad ones to a table of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.text import strip
from tessera.operators.records import normalize_text


def text_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Text records of files that come into ``folder``; ids are theirs or null."""
    raw = spark.readStream.text(folder).where(strip("value") != "").select(F.try_parse_json("value").alias("v"))
    field = lambda n: F.when(F.schema_of_variant(F.variant_get("v", f"$.{n}", "variant")) == "STRING", F.try_variant_get("v", f"$.{n}", "string")).alias(n)
    return normalize_text(raw.select(*[field(n) for n in ("id", "text", "source", "language", "split")]))


def ingest(spark: SparkSession, folder: str, good: str, bad: str, checkpoint: str) -> StreamingQuery:
    """Takes what is there, and stops; run again it takes what is new. Each batch is written under its number, so that one that
    runs again replaces itself."""

    def put(batch: DataFrame, n: int) -> None:
        batch.where("error_code IS NULL").drop("error_code").write.mode("overwrite").parquet(f"{good}/batch={n}")
        batch.where("error_code IS NOT NULL").write.mode("overwrite").parquet(f"{bad}/batch={n}")

    return text_stream(spark, folder).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
