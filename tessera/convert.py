"""Sources to JSONL of records: ``python -m tessera.convert KIND INPUT OUTPUT --source NAME``. Records that aren't fine are left out and counted.

A source is read once, cut into chunks row by row, checked, and written by a sink that commits both counts. Numbers in ids go over all files of a folder.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import optional
from tessera.operators import chat, encode, mixing, records
from tessera.sources import readers, sink, writers
from tessera.sources.scratch import scratch

#: Fixed value: the split of records without one.
SPLIT = "train"
#: Fixed value: the language that chats of instructions get.
LANGUAGE = "zh"
#: Fields that a record has of its own; others of the payload are kept as they are.
OWN = ["id", "type", "text", "source", "split", "language"]


def chunked(df: DataFrame, most: int | None, tokenizer: str | None = None) -> DataFrame:
    """Texts as chunks of whole lines up to ``most`` tokens of the file ``tokenizer``, or characters without one: adds chunk_no and chunks. All other
    columns go along, so that nothing is joined. A text without lines is one chunk, a null."""
    if most is None:
        return df.withColumns({"chunk_no": F.lit(1), "chunks": F.lit(1)})
    keys = [c for c in df.columns if c != "text"]
    out = encode.chunked_rows(df, "text", keys, encode.token_chunker(most, tokenizer) if tokenizer else encode.line_chunker(most), total=True)
    return out.withColumnRenamed("chunk", "text")


def texts(df: DataFrame, output: str, name: str, most: int | None, tokenizer: str | None, extra: list[str] | None = None) -> dict[str, int]:
    """Writes text records of (n, text, source, split, and own_id, language and rest where they are there); ids are own_id, or made of ``name`` and n."""
    own = chunked(df, most, tokenizer)
    made = records.made_id(F.lit(name), F.col("n"))
    suffix = F.when(F.col("chunks") > 1, F.format_string("-%04d", "chunk_no")).otherwise("")
    out = records.normalize_text(own, record_id=F.concat(F.coalesce("own_id", made) if "own_id" in df.columns else made, suffix))
    line = writers.record_line(["id", "type", "text", *(extra or [])], [c for c in ("source", "split", "language") if c in out.columns], "rest" if "rest" in df.columns else None)
    return written(out.select(line.alias("value"), "error_code"), output)


def written(lines: DataFrame, output: str) -> dict[str, int]:
    """Writes what is fine, and what isn't beside it; numbers of records converted and skipped."""
    found = sink.save(lines, output)
    return {k: found[k] for k in ("converted", "skipped")}


def raw_text(spark: SparkSession, path: str, output: str, source: str, content: str = "content", most: int | None = None, tokenizer: str | None = None) -> dict[str, int]:
    """Raw-text JSONL: the text is ``content``; id, source and split are the payload's, or made; language and all other fields are kept."""
    own = readers.raw_texts(spark, path, content, source=source, split=SPLIT)
    field = lambda c: optional(F.try_variant_get(F.col("payload")[c], "$", "string"))
    rest = F.to_json(F.map_filter("payload", lambda k, _: ~k.isin(OWN)))
    return texts(own.select("n", "text", "source", "split", field("id").alias("own_id"), field("language").alias("language"), rest.alias("rest")), output, source, most, tokenizer)


def table_text(df: DataFrame, output: str, source: str, most: int | None, tokenizer: str | None, extra: list[str] | None = None) -> dict[str, int]:
    """Rows (n, text, and ``extra`` fields)."""
    return texts(df.withColumns({"source": F.lit(source), "split": F.lit(SPLIT)}), output, source, most, tokenizer, extra)


def csv(spark: SparkSession, path: str, output: str, source: str, body: str = "body", title: str = "title", most: int | None = None, tokenizer: str | None = None) -> dict[str, int]:
    """CSV with a body under a title; the title is kept as paper_title."""
    from tessera.operators.ordering import ordinal

    rows = readers.csv(spark, path, body, title)
    rows = rows.select(F.monotonically_increasing_id().alias("_at"), chat.titled_text(F.col(body), F.col(title)).alias("text"), optional(title).alias("paper_title"))
    return table_text(ordinal(rows, "_at", [F.col("_at")], "n").withColumn("n", F.col("n") + 1).drop("_at"), output, source, most, tokenizer, ["paper_title"])


def parquet(spark: SparkSession, path: str, output: str, source: str, text: str = "text", most: int | None = None, tokenizer: str | None = None) -> dict[str, int]:
    """The text column of Parquet files."""
    return table_text(readers.over_files(readers.parquet_texts(spark, path, text), "row_no", 1).select("n", "text"), output, source, most, tokenizer)


def txt(spark: SparkSession, path: str, output: str, source: str, most: int | None = None, tokenizer: str | None = None) -> dict[str, int]:
    """Whole text files, each a record or its chunks."""
    from tessera.operators.ordering import ordinal

    own = readers.text_files(spark, path)
    own = ordinal(own.withColumn("_b", F.pmod(F.xxhash64("file"), F.lit(1024))), F.col("_b"), [F.col("file")], "n").withColumn("n", F.col("n") + 1)
    return table_text(own.select("n", "text"), output, source, most, tokenizer)


def instructions(spark: SparkSession, path: str, output: str, source: str, held: int = 0, held_output: str | None = None, seed: str = "42", language: str | None = LANGUAGE) -> dict[str, int]:
    """Instruction JSONL as chats; without a response a record is skipped. ``held`` records, picked by ``seed``, go to ``held_output`` instead, and must be
    fewer than all; no record at all is an error."""
    own = readers.instructions(spark, path, source).withColumns({"type": F.lit("chat"), "text": F.lit(None).cast("string"), "split": F.lit(SPLIT), "language": F.lit(language)})
    out = records.dispatched(own)
    line = writers.record_line(["id", "type", "messages", "category"], ["source", "split", "language"])
    lines = out.select(line.alias("value"), "error_code", "n")
    if not held_output or not held:
        found = written(lines, output)
        if not found["converted"]:
            raise ValueError(f"no chats in {path}")
        return found
    kept = f"{scratch(spark)}/chats"
    lines.write.parquet(kept)
    lines = spark.read.parquet(kept)
    good = lines.where("error_code IS NULL")
    if held >= good.count():
        raise ValueError("fewer records must be held out than there are")
    split = mixing.split(good, held, "n", seed)
    apart = written(split.where("held"), held_output)
    found = written(split.where("NOT held").select("value", "error_code").unionByName(lines.where("error_code IS NOT NULL").select("value", "error_code")), output)
    return found | {"held": apart["converted"]}


def legacy(spark: SparkSession, path: str, output: str, source: str) -> dict[str, int]:
    """JSON arrays of old transcripts as chats."""
    own = readers.over_files(readers.string_arrays(spark, path), "item_no", 0).withColumn("messages", chat.parse_transcript(F.col("text")))
    code = chat.transcript_error(F.col("messages"))
    named = {"source": F.lit(source), "split": F.lit(SPLIT), "type": F.lit("chat")}
    out = own.withColumns(named).withColumn("id", records.made_id("source", F.col("n")))
    return written(out.select(writers.record_line(["id", "type", "messages"], ["source", "split"]).alias("value"), code.alias("error_code")), output)


KINDS = {"raw-text": raw_text, "csv": csv, "parquet": parquet, "txt": txt, "instructions": instructions, "legacy": legacy}


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("kind", choices=KINDS)
    parser.add_argument("input")
    parser.add_argument("output")
    parser.add_argument("--source", required=True)
    parser.add_argument("--most", type=int, help="tokens of a chunk, or characters without a tokenizer (raw-text, csv, parquet, txt)")
    parser.add_argument("--tokenizer", help="a file of the tokenizers library (raw-text, csv, parquet, txt)")
    parser.add_argument("--held", type=int, help="records that are held out (instructions)")
    parser.add_argument("--held-output", help="where they go (instructions)")
    own = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    more = {k: v for k in ("most", "tokenizer", "held", "held_output") if (v := getattr(own, k))}
    print(KINDS[own.kind](spark, own.input, own.output, own.source, **more))


if __name__ == "__main__":
    main()
