"""What several operators need: a place that all machines share, written tables and id hashes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a word is split at, everywhere in this subpackage: space, tab, line feed, vertical tab, form feed, return.
WHITE = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it is unset, as in tests on one machine, one of our own is set."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("tessera.shared.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        named = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("tessera.shared.dir", named)
    return named.rstrip("/")


#: Paths that this driver has named, in order.
PATHS: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    PATHS.append(f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}")
    return PATHS[-1]


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def joined(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, whose keys are unique, on ``key``. What ``hot`` has (some rows of ``table``, few) comes by broadcast, so
    that only rows with other keys are shuffled, and those of one hot key don't meet in a task."""
    names = [c for c in table.columns if c != key]
    own = F.broadcast(hot.select(key, F.struct(*names).alias("_hot")))
    seen = rows.join(own, key, "left")
    rest = seen.where("_hot IS NULL").drop("_hot").join(table, key, how)
    return seen.where("_hot IS NOT NULL").select(*rows.columns, "_hot.*").unionByName(rest.select(*rows.columns, *names))


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder that ``new_path`` named."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def marked() -> int:
    """How many paths have been named so far."""
    return len(PATHS)


def drop_since(spark: SparkSession, first: int, last: int) -> None:
    """Deletes what was written to the paths named from one mark to another: tables that a result, written since, came from."""
    for path in PATHS[first:last]:
        drop_path(spark, path)


def remainder(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


#: What Python workers are started with, so that freed arrays go back to the system at once and not only when the worker ends.
FRUGAL = {"MALLOC_MMAP_THRESHOLD_": "262144", "MALLOC_TRIM_THRESHOLD_": "1048576", "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def frugal(spark: SparkSession) -> None:
    """Sets FRUGAL for Python workers of operators that are called after this, where the session hasn't set its own."""
    for name, value in FRUGAL.items():
        spark.sparkContext.environment.setdefault(name, value)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_text(df: DataFrame, kept: list[str], text_col: str) -> tuple[DataFrame, int]:
    """The columns ``kept`` as c0, c1, ..., so that no name clashes, and after them the text if it isn't among them; the text's place."""
    cols = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)]
    if text_col in kept:
        return df.select(cols), kept.index(text_col)
    return df.select(*cols, F.col(text_col).alias("text")), len(kept)
