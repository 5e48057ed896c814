"""Raw sources as tables of records. Line numbers count from 1 with blank lines; ids without one are file stem and line."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import numbers, strip
from tessera.operators.chat import instruction
from tessera.operators.records import made_id, with_defaults


def jsonl(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """file, line_no, record_index (blank lines not counted), value (variant), default_id, and n, the line's number over all files in order of their
    names. Bad lines fail, or are null if not ``strict``; strict reading fails also where there is no record at all.

    Lines are numbered within the splits that Spark reads a file in, and splits by the numbers of lines before them, so that
    no task has more than a split.
    """
    meta = lambda c: F.col(f"_metadata.{c}")
    raw = spark.read.text(path).select("value", meta("file_path").alias("file"), meta("file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_at"))
    raw = raw.withColumn("_full", (strip("value") != "").cast("int"))
    if strict and raw.where("_full = 1").isEmpty():
        raise ValueError(f"no records in {path}")
    earlier = Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    over_all = Window.orderBy("file", "_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = raw.groupBy("file", "_split").agg(F.count(F.lit(1)).alias("_lines"), F.sum("_full").alias("_records"))
    before = [F.coalesce(F.sum(c).over(w), F.lit(0)).alias(name) for c, w, name in (("_lines", earlier, "_lines_before"), ("_records", earlier, "_records_before"), ("_lines", over_all, "_all_before"))]
    splits = splits.select("file", "_split", *before)
    within = Window.partitionBy("file", "_split").orderBy("_at")
    out = raw.withColumn("_line", F.row_number().over(within)).withColumn("_record", F.sum("_full").over(within)).where("_full = 1").join(splits, ["file", "_split"])
    out = out.withColumns({"line_no": F.col("_line") + F.col("_lines_before"), "record_index": F.col("_record") + F.col("_records_before") - 1, "n": F.col("_line") + F.col("_all_before")})
    stem = F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?\z", 1)
    parse = F.parse_json if strict else F.try_parse_json
    return out.select("file", "line_no", "record_index", parse("value").alias("value"), F.concat_ws(":", stem, F.col("line_no").cast("string")).alias("default_id"), "n")


def raw_texts(spark: SparkSession, path: str, content: str = "content", **defaults: str) -> DataFrame:
    """Raw-text JSONL: line_no, record_index, n, text (the field ``content``), payload (all other fields, by name), source and split, which are
    the payload's or the defaults. Texts that are missing or no strings are null."""
    own = jsonl(spark, path)
    fields = F.try_variant_get("value", "$", "map<string,variant>")
    out = own.select("file", "line_no", "record_index", "n", "default_id", string_field("value", content).alias("text"), F.map_filter(fields, lambda k, _: k != content).alias("payload"), *[string_field("value", c).alias(c) for c in ("source", "split")])
    return with_defaults(out, **defaults)


def instructions(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Instruction JSONL (instruction, context, response, category) as chats: line_no, record_index, n, id (of source and n), source, category, messages (null
    without a response)."""
    own = jsonl(spark, path)
    f = lambda c: string_field("value", c)
    out = own.select("file", "line_no", "record_index", "n", f("category").alias("category"), instruction(f("instruction"), f("context"), f("response")).alias("messages"))
    return out.withColumn("source", F.lit(source)).withColumn("id", made_id("source", F.col("n")))


def over_files(rows: DataFrame, no: str, first: int) -> DataFrame:
    """Adds n, from 1 over all files in order of their names, to rows (file, ...) that ``no`` numbers within each file from ``first``. Rows stay where
    they are read: what is joined has a row for each file, and a shuffle by file would give a task a whole file."""
    counts = rows.groupBy("file").agg(F.max(no).alias("_last"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    before = counts.select("file", F.coalesce(F.sum(F.col("_last") + (1 - first)).over(earlier), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(before), "file").withColumn("n", F.col("_before") + F.col(no) + (1 - first)).drop("_before")


def string_field(value: str, name: str) -> Column:
    """A field that is a string, unconverted; null if it is missing or of another type."""
    own = F.variant_get(value, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(own) == "STRING", F.try_variant_get(value, f"$.{name}", "string"))


def csv(spark: SparkSession, path: str, body: str, title: str | None = None) -> DataFrame:
    """Rows with a header, quotes that hold line feeds, and a byte order mark that doesn't count; the columns must be there."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    for c in (body, *([title] if title else [])):
        if c not in df.columns:
            raise ValueError(f"no column {c} in {path}")
    return df


def parquet_texts(spark: SparkSession, path: str, text: str = "text") -> DataFrame:
    """file, row_no (from 1, within each file) and text; no other column is read."""
    df = spark.read.parquet(path)
    if text not in df.columns:
        raise ValueError(f"no column {text} in {path}")
    return df.select(F.col("_metadata.file_path").alias("file"), (F.col("_metadata.row_index") + 1).alias("row_no"), F.col(text).alias("text"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """file and text: one row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def string_arrays(spark: SparkSession, path: str) -> DataFrame:
    """file, item_no (from 0) and text of files that are JSON arrays of strings."""
    own = text_files(spark, path).select("file", F.from_json("text", "array<string>").alias("items"))
    return own.select("file", F.posexplode("items").alias("item_no", "text"))


def factors(spark: SparkSession, path: str) -> DataFrame:
    return text_files(spark, path).select("file", numbers("text").alias("factors"))


def manifest(spark: SparkSession, path: str, base: str | None = None) -> list[dict]:
    """Entries of a manifest, which is small: name, path (below ``base`` or beside the manifest if it is relative), weight, sample_limit, enabled."""
    text = spark.read.text(path, wholetext=True).first()[0]
    entries = json.loads(text).get("datasets")
    if not isinstance(entries, list) or not entries:
        raise ValueError("a manifest needs datasets")
    folder = base or path.rsplit("/", 1)[0]
    out = []
    for e in entries:
        weight = float(e.get("weight", 1.0))
        if weight < 0:
            raise ValueError("weights can't be negative")
        own = e["path"] if e["path"].startswith("/") or "://" in e["path"] else f"{folder}/{e['path']}"
        out.append({"name": e.get("name", own), "path": own, "weight": weight, "sample_limit": e.get("sample_limit"), "enabled": e.get("enabled") is not False})
    return out


def load_manifest(spark: SparkSession, path: str, seed: str = "42") -> DataFrame:
    """All entries' JSONL records, mixed by their weights and limits: source is the entry's name; fails if nothing is left."""
    from tessera.operators.mixing import mixed, plan, weights_table

    entries = [e for e in manifest(spark, path) if e["enabled"]]
    parts = [jsonl(spark, e["path"]).select(F.lit(e["name"]).alias("source"), "record_index", "default_id", "value") for e in entries]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    weights = weights_table(spark, [(e["name"], e["weight"], e["sample_limit"], True) for e in entries])
    plans = plan(union, weights, "source")
    if plans.where("base * copies + extra > 0").isEmpty():
        raise ValueError("the manifest selects no records")
    return mixed(union, plans, "source", "record_index", seed)


def manifest_report(spark: SparkSession, path: str, seed: str = "42") -> DataFrame:
    """How many records of each type and source a manifest's mix has: kind, name, records."""
    from tessera.operators.records import summary

    return summary(load_manifest(spark, path, seed).select(string_field("value", "type").alias("type"), "source"))
