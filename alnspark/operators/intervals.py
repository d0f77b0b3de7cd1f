"""Intervals: region strings, BED semantics, the binned overlap join, merging."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Bases per bin of the interval join and of the depth sweep.
BIN = 16_384


def parse_region(text: str) -> tuple[str, int, int | None]:
    """chr, chr:beg or chr:beg-end (1-based, inclusive, commas allowed) as (chrom, start0, end0); an open end is None."""
    m = re.fullmatch(r"(.+?)(?::([\d,]+)(?:-([\d,]*))?)?", text)
    if not m or not text:
        raise ValueError(f"no region: {text!r}")
    beg = int(m[2].replace(",", "")) if m[2] else 1
    end = int(m[3].replace(",", "")) if m[3] else None
    if end is not None and end < beg:
        raise ValueError(f"the region ends before it begins: {text!r}")
    return m[1], max(0, beg - 1), end


def region_filter(regions: list[str], chrom: Column, start0: Column, end0: Column) -> Column:
    """Overlap with any of the regions. '*' is what has no place."""
    keep = F.lit(False)
    for r in regions:
        if r == "*":
            keep = keep | chrom.isNull()
            continue
        name, beg, end = parse_region(r)
        keep = keep | ((chrom == name) & (end0 > beg) & (F.lit(True) if end is None else start0 < end))
    return F.coalesce(keep, F.lit(False))


def region_bounds(regions: list[str], rname: Column, pos: Column, longest: int | None = None) -> Column:
    """What all records in the regions fulfil, on the stored columns alone (pos is 1-based), so that it prunes."""
    may = F.lit(False)
    for r in regions:
        if r == "*":
            may = may | rname.isNull()
            continue
        name, beg, end = parse_region(r)
        one = rname == name
        one = one if end is None else one & (pos <= end)
        may = may | (one if longest is None else one & (pos > beg - longest))
    return may


def _bins(start0: Column, end0: Column) -> Column:
    return F.sequence(F.floor(start0 / BIN), F.floor((F.greatest(end0, start0 + 1) - 1) / BIN))


def overlap_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """left (chrom, start0, end0, ...) with right (r_chrom, r_start0, r_end0, ...), on overlap.

    Both sides are dealt into fixed bins and joined on (chrom, bin); a pair that shares several bins counts in the
    first only. 'inner' gives all pairs; 'semi', with intervals on the right that don't overlap each other, the left rows with any overlap, each once.
    """
    if how == "semi":  # of intervals apart from each other, the first that a row meets is the one that the interval before ends ahead of
        before = F.lag("r_end0").over(Window.partitionBy("r_chrom").orderBy("r_start0"))
        right = right.withColumn("_before", F.coalesce(before, F.lit(0)))
    lb = left.withColumn("_bin", F.explode(_bins(F.col("start0"), F.col("end0"))))
    rb = right.withColumn("_rbin", F.explode(_bins(F.col("r_start0"), F.col("r_end0"))))
    meet = (F.col("chrom") == F.col("r_chrom")) & (F.col("_bin") == F.col("_rbin")) & (F.col("start0") < F.col("r_end0")) & (F.col("r_start0") < F.col("end0"))
    once = meet & (F.floor(F.greatest("start0", "r_start0") / BIN) == F.col("_bin"))
    if how == "semi":
        return lb.join(rb, once & (F.col("_before") <= F.col("start0"))).select(*left.columns)
    return lb.join(rb, once).drop("_bin", "_rbin")


def merge_intervals(bed: DataFrame) -> DataFrame:
    """Overlapping or adjoining intervals as one: chrom, start0, end0."""
    w = Window.partitionBy("chrom").orderBy("start0", "end0")
    reach = F.max("end0").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = bed.where("end0 > start0").select("chrom", "start0", "end0").withColumn("_new", (reach.isNull() | (F.col("start0") > reach)).cast("int"))
    return marked.withColumn("_island", F.sum("_new").over(w)).groupBy("chrom", "_island").agg(F.min("start0").alias("start0"), F.max("end0").alias("end0")).drop("_island")


def parse_bed(lines: DataFrame, column: str = "value") -> DataFrame:
    """BED lines as chrom, start0, end0, name, score, strand. Comments, track and browser lines, blank lines and lines
    that begin with a blank go; two columns are a 1-based point; what ends before it begins goes."""
    c = F.split(F.regexp_replace(F.col(column), r"\s+$", ""), r"\s+")
    kept = lines.where(~F.col(column).rlike(r"^(#|track\s|browser\s|\s|$)")).select(c.alias("c")).where(F.size("c") >= 2)
    point = F.size("c") == 2
    first = F.col("c")[1].cast("bigint")
    parsed = kept.select(
        F.col("c")[0].alias("chrom"), F.when(point, first - 1).otherwise(first).alias("start0"), F.when(point, first).otherwise(F.get("c", F.lit(2)).cast("bigint")).alias("end0"),
        F.get("c", F.lit(3)).alias("name"), F.get("c", F.lit(4)).alias("score"), F.get("c", F.lit(5)).alias("strand"),
    )
    return parsed.where("end0 > start0")
