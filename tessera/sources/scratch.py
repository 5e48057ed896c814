"""A folder for files that a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder that all machines share: below the one that spark.checkpoint.dir names; where it is unset, as in tests on
    one machine, a temporary one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/tessera/files-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return tempfile.mkdtemp(prefix="tessera-files-")
