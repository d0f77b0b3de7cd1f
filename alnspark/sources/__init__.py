"""Readers as Python data sources: sam, bam, fasta, fastq; BED is read as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.intervals import parse_bed
from .alignments import BamSource, SamSource
from .sequences import FastaSource, FastqSource

SOURCES = (SamSource, BamSource, FastaSource, FastqSource)


def register(spark: SparkSession) -> None:
    """After this, spark.read.format('sam'), 'bam', 'fasta' and 'fastq' work, and df.write.format('bam'). The bam source
    takes conditions on places, which the session must allow."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    for source in SOURCES:
        spark.dataSource.register(source)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    return parse_bed(spark.read.text(path))
