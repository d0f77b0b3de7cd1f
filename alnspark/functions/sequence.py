"""Bases and qualities as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# IUPAC codes and their complements.
IUPAC, COMPLEMENT = "ACGTUMRWSYKVHDBNacgtumrwsykvhdbn", "TGCAAKYWSRMBDHVNtgcaakywsrmbdhvn"


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, IUPAC, COMPLEMENT))


def gc_count(seq: Column) -> Column:
    return F.length(seq) - F.length(F.translate(seq, "GCgc", ""))


def qualities(qual: Column) -> Column:
    """array<int> of Phred scores; null for null or '*'."""
    return F.when(qual.isNotNull() & (qual != "*"), F.transform(F.split(qual, ""), lambda c: F.ascii(c) - 33))


def quality_sum(qual: Column, least: int = 15) -> Column:
    """Sum of the scores that reach `least`; 0 without qualities."""
    return F.coalesce(F.aggregate(F.filter(qualities(qual), lambda q: q >= least), F.lit(0).cast("long"), lambda a, q: a + q), F.lit(0).cast("long"))


def good(df: DataFrame) -> Column:
    """quality_sum of the qualities, from the plain column `good` where there is one."""
    return F.col("good") if "good" in df.columns else quality_sum(F.col("qual"))


def bin_qualities(qual: Column) -> Column:
    """Scores from 3 on as the middle of their ten."""
    return F.array_join(F.transform(qualities(qual), lambda q: F.char(F.when(q >= 3, (q / 10).cast("int") * 10 + 7).otherwise(q) + 33)), "")
