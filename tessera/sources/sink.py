"""A sink for records that commits: ``df.write.format("tessera_jsonl").mode("overwrite").save(path)`` after ``register``.

Rows are (value, error_code): lines without an error become ``path/part-*.jsonl``, the others ``path/_skipped/*.jsonl`` with their error. Tasks write
below a folder of the run's own and report what they wrote and counted; the commit moves the files and writes ``_counts.json`` last. A job that
fails leaves nothing, and a task that runs again counts once.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    good: str | None
    bad: str | None
    counts: dict[str, int]


class RecordWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path.rstrip("/"), overwrite, uuid.uuid4().hex
        files, base = opened(self.path)
        files.create_dir(f"{base}/.run-{self.run}")  # once, so that a task that outlives an abort can't make it again

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        files, base = opened(self.path)
        context = TaskContext.get()
        name = f"{context.partitionId():05d}-{context.taskAttemptId()}"
        folder, counts, out = f"{base}/.run-{self.run}", Counter(), {}
        try:
            for batch in iterator:
                error = batch.column("error_code")
                counts.update(error.to_pylist())
                for kind, rows in (("good", batch.filter(pc.is_null(error))), ("bad", batch.filter(pc.is_valid(error)))):
                    if not rows.num_rows:
                        continue
                    if kind not in out:
                        out[kind] = files.open_output_stream(f"{folder}/{name}.{kind}")
                    values = rows.column("value").to_pylist()
                    if kind == "bad":
                        values = [json.dumps({"error_code": e, "value": v}, ensure_ascii=False) for e, v in zip(rows.column("error_code").to_pylist(), values, strict=True)]
                    out[kind].write("".join(f"{v}\n" for v in values).encode())
        finally:
            for stream in out.values():
                stream.close()
        return Written(*(f"{name}.{k}" if k in out else None for k in ("good", "bad")), {k or "converted": n for k, n in counts.items()})

    def commit(self, messages: list[Written | None]) -> None:
        files, base = opened(self.path)
        files.create_dir(base)
        if self.overwrite:
            for info in files.get_file_info(fs.FileSelector(base, allow_not_found=True)):
                if info.base_name.startswith("part-") and info.base_name.endswith(".jsonl"):
                    files.delete_file(info.path)
            with suppress(FileNotFoundError):
                files.delete_dir(f"{base}/_skipped")
        total: Counter = Counter()
        for m in messages:
            if m is None:
                continue
            total.update(m.counts)
            if m.good:
                files.move(f"{base}/.run-{self.run}/{m.good}", f"{base}/part-{self.run[:8]}-{m.good.removesuffix('.good')}.jsonl")
            if m.bad:
                files.create_dir(f"{base}/_skipped")
                files.move(f"{base}/.run-{self.run}/{m.bad}", f"{base}/_skipped/part-{self.run[:8]}-{m.bad.removesuffix('.bad')}.jsonl")
        with suppress(FileNotFoundError):
            files.delete_dir(f"{base}/.run-{self.run}")
        done = total.pop("converted", 0)
        with files.open_output_stream(f"{base}/_counts.json") as f:
            f.write(json.dumps({"converted": done, "skipped": sum(total.values()), "errors": dict(sorted(total.items()))}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        files, base = opened(self.path)
        with suppress(FileNotFoundError):
            files.delete_dir(f"{base}/.run-{self.run}")


class RecordSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera_jsonl"

    def writer(self, schema: StructType, overwrite: bool) -> RecordWriter:
        if schema.fieldNames() != ["value", "error_code"]:
            raise ValueError(f"the sink takes value and error_code, not {schema.fieldNames()}")
        return RecordWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordSink)


def counts(path: str) -> dict:
    """What the last commit counted: converted, skipped, and errors by their code."""
    files, base = opened(path.rstrip("/"))
    with files.open_input_stream(f"{base}/_counts.json") as f:
        return json.loads(f.read())


def save(lines: DataFrame, path: str) -> dict:
    """Writes (value, error_code) in place of what ``path`` had, in one pass over ``lines``; returns the counts."""
    register(lines.sparkSession)
    lines.select(F.col("value").cast("string"), F.col("error_code").cast("string")).write.format("tessera_jsonl").mode("overwrite").save(path)
    return counts(path)
