"""Flat binary files of token ids.

Part p has three files: ``part-p.bin``, ids as little-endian unsigned integers without gaps (16 bits if all ids of the
vocabulary fit, else 32); ``part-p.idx``, unsigned 64-bit offsets, in ids, of its documents in that file and the end; and
``part-p.doc``, signed 64-bit document ids (the least one for null). ``manifest.json`` has the type, each part's numbers of
documents and ids, and its base: the ids of all parts before it. Document ids ascend within and over parts.
"""

from __future__ import annotations

import json
import uuid
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions
from .library import text_encoder
from .packing import with_end
from .pieces import chunks

NO_ID = -(2**63)
READ_IDS, READ_DOCS = 1 << 20, 1 << 16
#: Bytes of text that a part has, about.
PART_BYTES = 256 << 20


def place(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """A file system that Arrow knows, and the path there."""
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


def slices(path: str, kind: str) -> Callable[[int, int], np.ndarray]:
    """Reads a file's values from one place up to another: memory-mapped if it is local, else only the bytes of that range."""
    (fs, at), width = place(path), np.dtype(kind).itemsize
    if isinstance(fs, pyarrow.fs.LocalFileSystem):
        whole = np.memmap(at, kind, "r") if fs.get_file_info(at).size else np.zeros(0, kind)
        return lambda a, b: whole[a:b]
    file = fs.open_input_file(at)
    return lambda a, b: np.frombuffer(file.read_at((b - a) * width, a * width), kind)


def put_in_place(fs: pyarrow.fs.FileSystem, own: str, name: str) -> None:
    """Renames a whole file. Where another attempt at the task has put the same file there, and renaming doesn't replace it, that one stays."""
    try:
        fs.move(own, name)
    except OSError:
        if fs.get_file_info(name).type != pyarrow.fs.FileType.File:
            raise
        fs.delete_file(own)


def bounds_of(df: DataFrame, id_col: str, parts: int) -> np.ndarray:
    """Ids that cut the documents into parts of about the same number, from the id column alone."""
    if parts < 2:
        return np.zeros(0, np.int64)
    found = df.agg(F.percentile_approx(F.col(id_col).cast("long"), [i / parts for i in range(1, parts)], 100_000)).first()[0]
    return np.unique(np.array(found or [], np.int64))


def write_tokens(df: DataFrame, tokenizer: str, path: str, end_id: int | None = 0, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Encodes ``text_col`` and writes the files below ``path``, a folder that all machines share; returns the manifest.

    Only ``id_col`` (an integer) and ``text_col`` are read. A null or empty text has only its end id. Null ids come first; rows
    with the same id are kept, in the order of their ids' bytes. An empty table has a manifest without parts. A task that
    runs again writes the same files again, under a name of its own until they are whole.
    """
    spark = df.sparkSession
    df = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if not parts:
        size = df.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        parts = max(partitions(spark), -(-size // PART_BYTES))
    bounds = bounds_of(df, "id", parts)
    from tokenizers import Tokenizer

    kind = "<u2" if max(Tokenizer.from_file(tokenizer).get_vocab_size() - 1, end_id or 0) < 1 << 16 else "<u4"
    fs, at = place(path)
    fs.create_dir(at, recursive=True)
    rows = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("data", T.BinaryType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, codec = text_encoder(tokenizer), pa.Codec("zstd", 1)
        for batch in batches:
            done = 0
            for texts in chunks(batch.column(1).to_pylist()):
                ids, offsets = with_end(*own.encode(texts), end_id)
                ids, docs = ids.astype(kind), batch.column(0).slice(done, len(texts))
                part = np.searchsorted(bounds, docs.fill_null(NO_ID).to_numpy(), "right").astype(np.int32)
                data = [codec.compress(ids[a:b].tobytes(), asbytes=True) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(part), docs, pa.array(np.diff(offsets)), pa.array(data, pa.binary())], rows.names)
                done += len(texts)

    def put(part: int, docs: array, sizes: array, bin_name: str) -> tuple[int, int, int]:
        there, to = place(path)
        for end, value in (("idx", np.append(0, np.cumsum(sizes)).astype("<u8")), ("doc", np.array(docs, "<i8"))):
            with there.open_output_stream(own := f"{to}/.{uuid.uuid4().hex}") as f:
                f.write(value.tobytes())
            put_in_place(there, own, f"{to}/part-{part:06d}.{end}")
        put_in_place(there, bin_name, f"{to}/part-{part:06d}.bin")
        return part, len(docs), int(np.sum(sizes))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, to = place(path)
        codec, width = pa.Codec("zstd"), np.dtype(kind).itemsize
        now, out, name, docs, sizes, done = None, None, "", array("q"), array("q"), []
        for batch in batches:
            for part, doc, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now:
                    if out:
                        out.close()
                        done.append(put(now, docs, sizes, name))
                    now, name, docs, sizes = part, f"{to}/.{uuid.uuid4().hex}", array("q"), array("q")
                    out = there.open_output_stream(name)
                out.write(codec.decompress(data, decompressed_size=n * width) if n else b"")
                docs.append(NO_ID if doc is None else doc)
                sizes.append(n)
        if out:
            out.close()
            done.append(put(now, docs, sizes, name))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["part", "docs", "ids"])

    encoded = df.mapInArrow(encode, rows).repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "id", "data")
    told = encoded.mapInArrow(write, "part int, docs long, ids long").collect()  # a row for each part
    told, base = sorted(told), 0
    manifest = {"type": kind, "parts": []}
    for part, docs, ids in told:
        manifest["parts"].append({"part": part, "docs": docs, "ids": ids, "base": base})
        base += ids
    with fs.open_output_stream(f"{at}/.manifest") as f:
        f.write(json.dumps(manifest).encode())
    fs.move(f"{at}/.manifest", f"{at}/manifest.json")
    return manifest


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Per document, from the files: ``id_col``, start (ids of all documents before it), n_tokens, ids (binary, little-endian
    unsigned 32-bit)."""
    fs, at = place(path)
    with fs.open_input_stream(f"{at}/manifest.json") as f:
        manifest = json.loads(f.read())
    kind = manifest["type"]
    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, base, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name = f"{path}/part-{part:06d}"
                index, names, flat = slices(f"{name}.idx", "<u8"), slices(f"{name}.doc", "<i8"), slices(f"{name}.bin", kind)
                for first in range(0, n, READ_DOCS):
                    last = min(n, first + READ_DOCS)
                    offsets, docs, at = index(first, last + 1).astype(np.int64), names(first, last), 0
                    while at < len(docs):
                        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + READ_IDS, "right")) - 1)
                        data = flat(int(offsets[at]), int(offsets[to])).astype("<u4")
                        ends = (offsets[at : to + 1] - offsets[at]) * 4
                        lists = pa.Array.from_buffers(pa.large_binary(), to - at, [None, pa.py_buffer(np.ascontiguousarray(ends)), pa.py_buffer(data)])
                        own = np.array(docs[at:to])
                        yield pa.RecordBatch.from_arrays([pa.array(own, mask=own == NO_ID), pa.array(base + offsets[at:to]), pa.array(np.diff(offsets[at : to + 1])), lists.cast(pa.binary())], schema.names)
                        at = to

    parts = [(p["part"], p["base"], p["docs"]) for p in manifest["parts"]]
    return spark.createDataFrame(parts, "part int, base long, docs long").repartition(max(1, len(parts))).mapInArrow(read, schema)


