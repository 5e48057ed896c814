"""Sinks: JSON lines, metric logs, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

OPTIONAL = ["source", "language", "split"]


def record_line(own: list[str], some: list[str], rest: str | None = None) -> Column:
    """A row as a JSON object: ``own`` fields, nulls too; of ``some`` those that aren't null; then the fields of the JSON object ``rest``."""
    parts = [F.to_json(F.struct(*own), {"ignoreNullFields": "false"}), F.to_json(F.struct(*some)) if some else F.lit("{}"), F.coalesce(F.col(rest), F.lit("{}")) if rest else F.lit("{}")]
    out = parts[0]
    for p in parts[1:]:
        out = F.when(p == "{}", out).otherwise(F.concat(F.substring(out, F.lit(1), F.char_length(out) - 1), F.lit(","), F.substring(p, F.lit(2), F.char_length(p))))
    return out


def jsonl(df: DataFrame, path: str, files: int | None = None) -> Observation:
    """One JSON object a line. Null extras are written; source, language and split aren't when they are null. Returns what
    was counted: records."""
    own = [c for c in df.columns if c not in OPTIONAL]
    whole = F.to_json(F.struct(*own), {"ignoreNullFields": "false"})
    some = [c for c in OPTIONAL if c in df.columns]
    extra = F.to_json(F.struct(*some)) if some else F.lit("{}")
    line = F.when(extra == "{}", whole).otherwise(F.concat(F.expr("left(_a, length(_a) - 1)"), F.lit(","), F.expr("substring(_b, 2)")))
    seen = Observation("jsonl")
    out = df.withColumn("_a", whole).withColumn("_b", extra).observe(seen, F.count(F.lit(1)).alias("records")).select(line.alias("value"))
    (out.coalesce(files) if files else out).write.mode("overwrite").text(path)
    return seen


def in_order(df: DataFrame, path: str, *order: str) -> None:
    """A folder of JSONL files whose names follow the order of the columns ``order``, as the rows in them do; these columns are written too."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "true"}).alias("value")).write.mode("overwrite").text(path)


def one_file(df: DataFrame, path: str) -> None:
    """A JSONL file for tools that read a single one: its rows, which one task writes, in their order."""
    df.coalesce(1).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "true"}).alias("value")).write.mode("overwrite").text(f"{path}.parts")
    spark = df.sparkSession
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    fs = hadoop.Path(path).getFileSystem(conf)
    part = next(s.getPath() for s in fs.listStatus(hadoop.Path(f"{path}.parts")) if s.getPath().getName().startswith("part-"))
    fs.rename(part, hadoop.Path(path))
    fs.delete(hadoop.Path(f"{path}.parts"), True)


def metrics(df: DataFrame, path: str) -> None:
    """Appends metric events as JSON lines."""
    df.write.mode("append").json(path)


def report(df: DataFrame, path: str, formats: str = "both") -> None:
    """A report of one row as json, markdown, or both."""
    if formats in ("json", "both"):
        df.coalesce(1).write.mode("overwrite").json(f"{path}/json")
    if formats in ("markdown", "md", "both"):
        df.select("markdown").coalesce(1).write.mode("overwrite").text(f"{path}/markdown")


def sweep_report(rows: DataFrame, path: str) -> None:
    """A sweep's cells (name, status, needle, retrieval, ppl): as JSON lines, and as a Markdown table by name."""
    from tessera.operators.metrics import markdown_table

    rows.coalesce(1).write.mode("overwrite").json(f"{path}/sweep")
    report(markdown_table(rows, ["name", "status", "needle", "retrieval", "ppl"], "name"), path, "markdown")


def tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True)
