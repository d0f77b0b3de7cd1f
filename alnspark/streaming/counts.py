"""Counts over a directory to which batches of reads are added."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import counts
from ..schema import READS


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(READS).parquet(path)


def flagstat_stream(reads: DataFrame, name: str):
    """A query that keeps the sixteen counts up to date, in a table in memory of this name."""
    return counts.flagstat(reads).writeStream.outputMode("complete").format("memory").queryName(name).start()
