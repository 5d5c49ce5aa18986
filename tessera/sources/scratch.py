"""A path of its own in the cluster's shared folder, for tables that a query writes and reads again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


GIVEN: list[str] = []


@cache
def _local() -> str:
    """A temporary folder of this process, removed when it ends."""
    path = tempfile.mkdtemp(prefix="tessera-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    shared, master = spark.sparkContext.getConf().get("spark.checkpoint.dir"), spark.sparkContext.master
    if not shared and not (master == "local" or master.startswith("local[")):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    shared = shared or _local()  # one machine does all
    GIVEN.append(f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return GIVEN[-1]


def remove_scratch(spark: SparkSession) -> None:
    """Delete all paths that were given to this process; results that were not written elsewhere can't be read any more."""
    while GIVEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(GIVEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the cluster's shared folder; partitions and their order stay as they are."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(scratch(df.sparkSession, "checkpoints"))
    return df.checkpoint(eager=True)
