"""Folders for files that a query writes and reads again."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: str | None = None
_made: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names; where that is unset in a temporary one, which only
    a local session may use. It is removed when the driver ends."""
    global _local
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = _local = _local or tempfile.mkdtemp(prefix="alnspark-")
    path = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table that is written once: later jobs neither make it again nor need the executors that made it."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _remove() -> None:
    for spark, path in _made:
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001 - the session may be gone
            break
    _made.clear()
