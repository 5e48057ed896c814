"""A manifest of JSONL corpora as a data source: splits are counted once, and rows are then read once with their weights applied.

``load`` reads a manifest in two jobs. The first counts the records of each split of each file; what comes back is a row for each split. Limits and weights
are then plain numbers, and which of n records are in a share of m is asked of a permutation of 0 to n - 1, a small cipher that each task
computes for its own records: no record is sent, sorted or ranked to be picked.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from . import readers
from .sink import opened

#: Bytes of a split.
SPLIT = 32 << 20
ROUNDS = 6
SCHEMA = "source string, record_index long, copy_no int, value string"
COUNTS = "entry int, file string, begin long, records long"
#: What is read on beyond a split at once, for its last line.
STEP = 1 << 16


def keys_of(seed: str, rounds: int = ROUNDS) -> list[int]:
    return [int.from_bytes(hashlib.md5(f"{seed}:{r}".encode()).digest()[:8], "little") for r in range(rounds)]


def permuted(i: np.ndarray, n: int, seed: str) -> np.ndarray:
    """A permutation of 0 to n - 1: a Feistel network on the next even number of bits, repeated for values beyond n."""
    half = max(1, ((n - 1).bit_length() + 1) // 2) if n > 1 else 1
    mask, out = np.uint64((1 << half) - 1), np.asarray(i, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for key in keys_of(seed):
            x = (right + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((x ^ (x >> np.uint64(32))) & mask)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


@dataclass
class Share:
    """Of an entry's n records: ``base`` after its limit, all of these ``copies`` times, and ``extra`` of them once more."""

    n: int
    base: int
    copies: int
    extra: int
    seed: str

    def copies_of(self, i: np.ndarray) -> np.ndarray:
        """How often each record comes, its extra one included."""
        place = permuted(i, self.n, f"{self.seed}:limit") if self.base < self.n else i
        inside = place < self.base
        out = np.where(inside, self.copies, 0)
        if self.extra:
            own = np.flatnonzero(inside)
            out[own] += permuted(place[own], self.base, f"{self.seed}:extra") < self.extra
        return out


def share(n: int, weight: float, limit: int | None, seed: str) -> Share:
    """A limit comes first. A weight of 0 takes none, under 1 a share (rounded half to even, at least one), above 1 so many copies and a share."""
    base = n if limit is None else min(n, limit)
    copies = int(weight)
    part = weight - copies
    return Share(n, base, copies, min(base, max(1, round(base * part))) if part and base else 0, seed)


@dataclass
class Part(InputPartition):
    entry: int
    file: str
    begin: int
    end: int
    first: int = 0
    name: str = ""
    share: Share | None = None


def files_of(path: str) -> list[tuple[str, int]]:
    """Data files of a path that is a file or a folder, with their sizes; names with a leading dot or underscore don't count."""
    files, base = opened(path.rstrip("/"))
    prefix = path.rstrip("/")[: len(path.rstrip("/")) - len(base)]
    info = files.get_file_info(base)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(base, recursive=True))
    hidden = lambda p: any(x[:1] in "._" for x in p[len(base) :].split("/") if x)
    return sorted((prefix + i.path, i.size) for i in found if i.type == fs.FileType.File and not hidden(i.path))


def lines_of(path: str, begin: int, end: int) -> list[bytes]:
    """Lines that begin in a range of bytes and aren't blank."""
    files, own = opened(path)
    with files.open_input_file(own) as f:
        size = f.size()
        at = begin
        if begin:
            at = begin - 1
            while at < size:  # to the first line that begins here
                some = f.read_at(STEP, at)
                cut = some.find(b"\n")
                if cut >= 0:
                    at += cut + 1
                    break
                at += len(some)
        if at >= min(end, size):
            return []
        data = [f.read_at(end - at, at)]
        upto = end
        while upto < size and not data[-1].endswith(b"\n"):
            some = f.read_at(STEP, upto)
            cut = some.find(b"\n")
            data.append(some[: cut + 1] if cut >= 0 else some)
            upto += len(data[-1])
    return [x for x in b"".join(data).split(b"\n") if x.strip()]


class ManifestReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.entries, self.split = json.loads(options["entries"]), int(options.get("split", SPLIT))
        self.counts = options.get("counts")
        self.counting, self.seed, self.names = "counts" not in options, options.get("seed", "42"), schema.fieldNames()

    def partitions(self) -> Sequence[Part]:
        parts = [Part(k, f, a, min(a + self.split, size), name=e["name"]) for k, e in enumerate(self.entries) for f, size in files_of(e["path"]) for a in range(0, size, self.split)]
        if self.counting:
            return parts
        with opened(self.counts)[0].open_input_stream(opened(self.counts)[1]) as f:
            known = {(k, file, begin): n for k, file, begin, n in json.loads(f.read())}
        total: dict[int, int] = {}
        for p in parts:
            p.first = total.get(p.entry, 0)
            total[p.entry] = p.first + known[p.entry, p.file, p.begin]
        shares = [share(total.get(k, 0), e["weight"], e["sample_limit"], f"{self.seed}:{e['name']}") for k, e in enumerate(self.entries)]
        for p in parts:
            p.share = shares[p.entry]
        return [p for p in parts if p.share.base and (p.share.copies or p.share.extra)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        lines = lines_of(part.file, part.begin, part.end)
        if self.counting:
            yield pa.RecordBatch.from_arrays([pa.array([part.entry], pa.int32()), pa.array([part.file]), pa.array([part.begin]), pa.array([len(lines)])], ["entry", "file", "begin", "records"])
            return
        index = part.first + np.arange(len(lines))
        n = part.share.copies_of(index)
        which = np.repeat(np.arange(len(lines)), n)
        copy_no = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + 1
        for a in range(0, len(which), 4096):
            w = which[a : a + 4096]
            own = {
                "source": lambda w=w: pa.array([part.name] * len(w)), "record_index": lambda w=w: pa.array(index[w]),
                "copy_no": lambda w=w, a=a: pa.array(copy_no[a : a + len(w)].astype(np.int32)), "value": lambda w=w: pa.array([lines[i].decode("utf-8", "replace") for i in w], pa.string()),
            }
            yield pa.RecordBatch.from_arrays([own[c]() for c in self.names], self.names)


class ManifestSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera_manifest"

    def schema(self) -> str:
        return SCHEMA if "counts" in self.options else COUNTS

    def reader(self, schema: StructType) -> ManifestReader:
        return ManifestReader(dict(self.options), schema)


def load(spark: SparkSession, path: str, seed: str = "42", split: int = SPLIT, columns: list[str] | None = None, base: str | None = None) -> DataFrame:
    """source (the entry's name), record_index (from 0, over its files in order of their names), copy_no (from 1) and value (the line) of all records that the
    manifest selects; with ``columns`` only these. Relative paths are below ``base``, or the manifest's folder. Entries that aren't enabled don't count; a manifest that selects nothing fails. The same seed
    picks the same records, whatever the splits are."""
    from .scratch import scratch

    spark.dataSource.register(ManifestSource)
    entries = [e for e in readers.manifest(spark, path, base) if e["enabled"]]
    source = spark.read.format("tessera_manifest").option("entries", json.dumps(entries)).option("split", str(split)).option("seed", seed)
    rows = [tuple(r) for r in source.load().collect()]  # a row for each split
    total = [sum(n for k, _, _, n in rows if k == i) for i in range(len(entries))]
    shares = [share(n, e["weight"], e["sample_limit"], "") for n, e in zip(total, entries, strict=True)]
    if not any(s.base and (s.copies or s.extra) for s in shares):
        raise ValueError("the manifest selects no records")
    counts = f"{scratch(spark)}/counts.json"
    files, own = opened(counts)
    files.create_dir(own.rsplit("/", 1)[0])
    with files.open_output_stream(own) as f:
        f.write(json.dumps(rows).encode())
    source = source.option("counts", counts)
    kinds = dict(x.split(" ") for x in SCHEMA.split(", "))
    return (source.schema(", ".join(f"{c} {kinds[c]}" for c in columns)) if columns else source).load()
