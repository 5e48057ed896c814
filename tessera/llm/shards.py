"""A table of immutable Parquet shards with versioned manifests and size-tiered compaction.

An arrival is written as small shards. Shards of a tier (sizes within a factor of ``ratio``) are merged once there are
``fan_in`` of them, into files of about the target size; full files stay as they are. Each change writes a new manifest and
commits it by a rename that fails if that version exists, so that readers see one version or the next. Of two writers one
loses, and makes its change again on what the other has committed. All data work is DataFrame operations; the driver handles file names
and sizes only.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: New files of a merge, about, at most: more are merged by further commits.
TOGETHER = 64


@dataclass(frozen=True)
class Shard:
    file: str
    bytes: int
    rows: int


class ShardTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, target_bytes: int = 512 << 20, ratio: float = 4.0, fan_in: int = 4):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.target_bytes, self.ratio, self.fan_in = target_bytes, ratio, fan_in
        jvm = spark.sparkContext._jvm
        self.Path, conf = jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.Path(self.path).getFileSystem(conf)
        self.context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)
        self.renaming = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self.fs.mkdirs(self.Path(f"{self.path}/manifests"))

    def version(self) -> int:
        """The last committed version; 0 if there is none."""
        names = [s.getPath().getName() for s in self.fs.listStatus(self.Path(f"{self.path}/manifests"))]
        return max([int(n[1:9]) for n in names if n.startswith("v")], default=0)

    def manifest(self, version: int | None = None) -> list[Shard]:
        version = self.version() if version is None else version
        if not version:
            return []
        stream = self.fs.open(self.Path(f"{self.path}/manifests/v{version:08d}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Shard(**x) for x in json.loads(text)]

    def commit(self, base: int, shards: list[Shard]) -> int:
        """Makes ``shards`` version base + 1; fails if another writer did so first."""
        own = self.Path(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        stream = self.fs.create(own, False)
        stream.write(bytearray(json.dumps([asdict(s) for s in shards]).encode()))
        stream.close()
        self.context.rename(own, self.Path(f"{self.path}/manifests/v{base + 1:08d}.json"), self.renaming)
        return base + 1

    def change(self, new: Callable[[list[Shard]], list[Shard] | None]) -> int | None:
        """Commits what ``new`` makes of the last version's shards; as often as another writer is first, of that one's. None if it makes none."""
        while True:
            base = self.version()
            shards = new(self.manifest(base))
            if shards is None:
                return None
            try:
                return self.commit(base, shards)
            except Py4JJavaError:
                if self.version() == base:  # not another writer's doing
                    raise

    def files(self, paths: list[str]) -> DataFrame:
        """Rows of files; names of folders give no columns."""
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(*paths)

    def write(self, df: DataFrame) -> list[Shard]:
        """New files of the rows, not committed yet."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(folder)
        return self.written(folder)

    def written(self, folder: str) -> list[Shard]:
        """Files of a folder with rows. They are counted without a column, so that only footers are read."""
        if not self.fs.exists(self.Path(folder)):
            return []
        sizes = {s.getPath().getName(): s.getLen() for s in self.fs.listStatus(self.Path(folder)) if s.getPath().getName().startswith("part-")}
        rows = self.files([folder]).groupBy(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("f")).count()
        counts = {r["f"]: r["count"] for r in rows.collect()}  # a row for each file
        return [Shard(f"{folder}/{f}", n, counts[f]) for f, n in sorted(sizes.items()) if counts.get(f)]

    def append(self, df: DataFrame) -> int:
        """Commits the rows as new shards, one for each partition that has rows; nothing is shuffled."""
        shards = self.write(df.select(self.schema.fieldNames()))
        return self.change(lambda now: [*now, *shards])

    def append_dealt(self, df: DataFrame, arrivals: int) -> int:
        """Deals the rows, by a hash of their places, into so many arrivals, which are written in one pass and committed one after another; one without rows isn't.
        How many shards there are depends on the partitions and on ``arrivals``, not on the files that the rows came from."""
        names = self.schema.fieldNames()
        arrival = next(f"arrival{i}" for i in range(len(names) + 1) if f"arrival{i}" not in names)  # a name that no column has
        dealt = df.select(*names, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(arrivals)).alias(arrival))
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        dealt.write.option("compression", "zstd").partitionBy(arrival).parquet(folder)
        for i in range(arrivals):
            if shards := self.written(f"{folder}/{arrival}={i}"):
                self.change(lambda now, shards=shards: [*now, *shards])
        return self.version()

    def tier(self, shard: Shard) -> int:
        """0 for full files, then by how often ``ratio`` goes into the rest."""
        return 0 if shard.bytes * 2 > self.target_bytes else 1 + int(math.log(self.target_bytes / max(1, shard.bytes), self.ratio))

    def compact(self) -> int:
        """Merges tiers until none has ``fan_in`` shards below the target; each merge is a commit of its own. If another writer
        has taken some of a merge's shards meanwhile, what was merged is left to ``vacuum``."""
        while True:
            base = self.version()
            shards = self.manifest(base)
            tiers: dict[int, list[Shard]] = {}
            for s in shards:
                tiers.setdefault(self.tier(s), []).append(s)
            due = [t for t in sorted(tiers, reverse=True) if t and len(tiers[t]) >= self.fan_in]
            if not due:
                return base
            runs, total = [], 0
            for s in tiers[due[0]]:
                if total >= TOGETHER * self.target_bytes and len(runs) >= self.fan_in:
                    break  # the rest is the next merge's
                runs.append(s)
                total += s.bytes
            with self.parts_of_unions_apart():
                merged = self.write(self.grouped(runs))
            gone = set(runs)
            self.change(lambda now: [s for s in now if s not in gone] + merged if gone <= set(now) else None)  # noqa: B023

    @contextmanager
    def parts_of_unions_apart(self) -> Iterator[None]:
        """While it lasts, a union of single partitions has all of them, and isn't a single one."""
        name, conf = "spark.sql.unionOutputPartitioning", self.spark.conf
        before = conf.get(name, "true")
        conf.set(name, "false")
        try:
            yield
        finally:
            conf.set(name, before)

    def grouped(self, runs: list[Shard]) -> DataFrame:
        """Rows of the runs, a partition for each new file: consecutive runs, cut where their bytes reach the next equal part of all. A
        run has at most half the target's bytes, so that files have between a half and three halves of it, unless all runs have less."""
        total = sum(s.bytes for s in runs)
        files = max(1, round(total / self.target_bytes))
        groups: list[list[str]] = [[] for _ in range(files)]
        before = 0
        for s in runs:
            groups[min(files - 1, (2 * before + s.bytes) * files // (2 * total))].append(s.file)
            before += s.bytes
        parts = [self.files(g).coalesce(1) for g in groups if g]
        return reduce(DataFrame.union, parts)

    def vacuum(self, older_than: float = 86_400.0) -> int:
        """Deletes data files that the last version doesn't have and that are older than so many seconds; returns their number. Readers of
        older versions fail then; younger files may be of writers that haven't committed yet."""
        before = (time.time() - older_than) * 1000
        kept, gone = {self.Path(s.file).toUri().getPath() for s in self.manifest()}, 0
        if self.fs.exists(self.Path(f"{self.path}/data")):
            found = self.fs.listFiles(self.Path(f"{self.path}/data"), True)
            while found.hasNext():
                s = found.next()
                if s.getPath().getName().startswith("part-") and s.getModificationTime() <= before and s.getPath().toUri().getPath() not in kept:
                    gone += bool(self.fs.delete(s.getPath(), False))
        return gone

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version; a table without shards has none."""
        files = [s.file for s in self.manifest(version)]
        return self.files(files) if files else self.spark.createDataFrame([], self.schema)


def shard(df: DataFrame, path: str, arrivals: int = 8, **options: float) -> ShardTable:
    """Deals ``df`` into ``arrivals``, appends them to a new table at ``path``, which no other writer knows yet, compacts and vacuums it.

    Rows are kept as they are: nulls, repeated rows, ties, very long texts and all columns, whatever their names. An empty table has no
    version, and no rows.
    """
    table = ShardTable(df.sparkSession, path, df.schema, **options)
    table.append_dealt(df, arrivals)
    table.compact()
    table.vacuum(older_than=0)
    return table
