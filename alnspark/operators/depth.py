"""Depth, coverage, interval sums: event sweeps within bins, so that no chromosome is a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import cigar as C, flags as FL
from ..functions.sequence import qualities
from .filters import span
from .intervals import BIN, overlap_join


def block_rows(df: DataFrame, kinds: str = "M=X") -> DataFrame:
    """reads exploded into the blocks of these operations: chrom, start0, end0, op, query0 beside the records' columns."""
    b = F.explode(F.filter(C.blocks(F.col("pos"), C.ops(F.col("cigar"))), lambda x: x["op"].isin(*kinds)))
    return df.where("rname is not null and pos is not null").withColumn("b", b).withColumns(
        {"chrom": F.col("rname"), "start0": F.col("b.ref0"), "end0": F.col("b.ref0") + F.col("b.len"), "op": F.col("b.op"), "query0": F.col("b.query0")}
    ).drop("b")


def _sweep(blocks: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """chrom, start0, end0 and running sums: runs of positions with equal sums, cut at bins. `sums` is what a block adds."""
    bins = F.explode(F.sequence(F.floor(F.col("start0") / BIN), F.floor((F.col("end0") - 1) / BIN)))
    cut = blocks.where("end0 > start0").withColumn("bin", bins).withColumns({"s": F.greatest("start0", F.col("bin") * BIN), "e": F.least("end0", (F.col("bin") + 1) * BIN)})
    ends = F.explode(F.array(F.struct(F.col("s").alias("p"), F.lit(1).alias("w")), F.struct(F.col("e").alias("p"), F.lit(-1).alias("w"))))
    events = cut.select("chrom", "bin", *[c.alias(k) for k, c in sums.items()], ends.alias("v"))
    at = events.groupBy("chrom", "bin", F.col("v.p").alias("p")).agg(*[F.sum(F.col(k) * F.col("v.w")).alias(k) for k in sums])
    w = Window.partitionBy("chrom", "bin").orderBy("p")
    run = at.select("chrom", F.col("p").alias("start0"), F.lead("p").over(w).alias("end0"), *[F.sum(k).over(w).alias(k) for k in sums])
    return run.where("end0 is not null")


def depth_filter(df: DataFrame, exclude: int = FL.DEPTH_MASK, include: int = 0, require: int = 0, min_mapq: int = 0, min_length: int = 0) -> DataFrame:
    kept = df.where(FL.flag_filter(F.col("flag"), require, exclude, include) & (F.coalesce("mapq", F.lit(0)) >= min_mapq))
    return kept.where(C.total(C.ops(F.col("cigar")), "MI=X") >= min_length) if min_length else kept


def depth_runs(df: DataFrame, deletions: bool = False) -> DataFrame:
    """chrom, start0, end0, depth, touched: what aligned blocks add; deletions only touch, unless they are counted."""
    counted = F.lit(True) if deletions else F.col("op") != "D"
    return _sweep(block_rows(df, "M=XD"), {"depth": counted.cast("int"), "touched": (~counted).cast("int")})


def depth(df: DataFrame, min_depth: int = 1, deletions: bool = False, **filters) -> DataFrame:
    """chrom, pos (1-based), depth of positions that reach min_depth or that only a deletion touches."""
    runs = depth_runs(depth_filter(df, **filters), deletions).where((F.col("depth") >= min_depth) | (F.col("touched") > 0))
    return runs.select("chrom", F.explode(F.sequence(F.col("start0") + 1, F.col("end0"))).alias("pos"), F.col("depth").cast("bigint").alias("depth"))


def depth_once_per_template(df: DataFrame, **filters) -> DataFrame:
    """Paired records count a position once a template."""
    b = block_rows(depth_filter(df, **filters))
    at = b.select("chrom", F.explode(F.sequence(F.col("start0") + 1, F.col("end0"))).alias("pos"), FL.bit(F.col("flag"), FL.PAIRED).alias("paired"), "qname", "ordinal")
    once = at.where("paired").select("chrom", "pos", "qname").distinct().select("chrom", "pos").union(at.where("not paired").select("chrom", "pos"))
    return once.groupBy("chrom", "pos").agg(F.count("*").alias("depth"))


def depth_all(df: DataFrame, header_sq: DataFrame, only_covered: bool = True, **filters) -> DataFrame:
    """Every position of the references with any coverage, or of all references."""
    found = depth(df, **filters)
    refs = header_sq.select(F.col("name").alias("chrom"), "length")
    if only_covered:
        refs = refs.join(found.select("chrom").distinct(), "chrom", "left_semi")
    every = refs.select("chrom", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("length"))).alias("pos"))
    return every.join(found, ["chrom", "pos"], "left").select("chrom", "pos", F.coalesce("depth", F.lit(0)).alias("depth"))


def depth_by_input(df: DataFrame, inputs: list[int], **filters) -> DataFrame:
    """chrom, pos and depth_<k> for each input."""
    b = block_rows(depth_filter(df, **filters))
    runs = _sweep(b, {f"depth_{k}": (F.col("src") == k).cast("int") for k in inputs})
    covered = F.greatest(*[F.col(f"depth_{k}") for k in inputs]) if len(inputs) > 1 else F.col(f"depth_{inputs[0]}")
    return runs.where(covered > 0).select("chrom", F.explode(F.sequence(F.col("start0") + 1, F.col("end0"))).alias("pos"), *[F.col(f"depth_{k}").cast("bigint").alias(f"depth_{k}") for k in inputs])


def depth_summary(df: DataFrame, header_sq: DataFrame, **filters) -> DataFrame:
    """Of each reference: mean, median, least, most depth and uncovered positions."""
    d = depth_all(df, header_sq, only_covered=False, **filters)
    return d.groupBy("chrom").agg(
        F.round(F.avg("depth"), 6).alias("mean"), F.percentile("depth", F.lit(0.5)).alias("median"), F.min("depth").alias("least"), F.max("depth").alias("most"), F.count_if(F.col("depth") == 0).alias("uncovered")
    )


def coverage(df: DataFrame, header_sq: DataFrame, min_base_quality: int = 0, min_depth: int = 1, max_depth: int = 1_000_000, **filters) -> DataFrame:
    """rname, startpos, endpos, numreads, covbases, coverage, meandepth, meanbaseq, meanmapq. A missing quality is 255."""
    kept = depth_filter(df, **filters).where("rname is not null and pos is not null")
    b = block_rows(kept.withColumn("_q", qualities(F.col("qual"))))
    size = (F.col("end0") - F.col("start0")).cast("int")
    of_block = F.coalesce(F.slice("_q", (F.col("query0") + 1).cast("int"), size), F.array().cast("array<int>"))
    padded = F.concat(of_block, F.array_repeat(F.lit(255), size - F.size(of_block)))  # bases beyond the qualities have none
    base = b.select("chrom", "start0", F.posexplode(padded).alias("k", "q")).select("chrom", (F.col("start0") + F.col("k")).alias("p"), "q")
    at = base.where(F.col("q") >= min_base_quality).groupBy("chrom", "p").agg(F.count("*").alias("d"), F.sum("q").alias("q")).where(F.col("d") >= min_depth)
    per_ref = at.groupBy("chrom").agg(F.count("*").alias("covbases"), F.sum(F.least("d", F.lit(max_depth))).alias("d"), F.sum("q").alias("q"), F.sum("d").alias("n"))
    per_read = kept.groupBy(F.col("rname").alias("chrom")).agg(F.count("*").alias("numreads"), F.avg(F.coalesce("mapq", F.lit(0))).alias("meanmapq"))
    joined = header_sq.select(F.col("name").alias("chrom"), "length").join(per_ref, "chrom", "left").join(per_read, "chrom", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return joined.select(
        F.col("chrom").alias("rname"), F.lit(1).cast("bigint").alias("startpos"), F.col("length").alias("endpos"), zero(F.col("numreads")).alias("numreads"), zero(F.col("covbases")).alias("covbases"),
        F.round(100 * zero(F.col("covbases")) / F.col("length"), 6).alias("coverage"), F.round(zero(F.col("d")) / F.col("length"), 6).alias("meandepth"),
        F.round(F.when(F.col("n") > 0, F.col("q") / F.col("n")).otherwise(0.0), 6).alias("meanbaseq"), F.round(F.coalesce("meanmapq", F.lit(0.0)), 6).alias("meanmapq"),
    )


def coverage_histogram(df: DataFrame, header_sq: DataFrame, bins: int, **filters) -> DataFrame:
    """rname, bin, covered: covered positions of each reference in equal bins."""
    runs = depth_runs(depth_filter(df, **filters)).where("depth > 0").join(F.broadcast(header_sq.select(F.col("name").alias("chrom"), "length")), "chrom")
    at = runs.select("chrom", "length", F.explode(F.sequence(F.col("start0"), F.col("end0") - 1)).alias("p"))
    return at.groupBy(F.col("chrom").alias("rname"), F.expr(f"p * {bins} div length").alias("bin")).agg(F.count("*").alias("covered"))


def bedcov(df: DataFrame, bed: DataFrame, skip_deletions: bool = False, min_depth: int | None = None, min_mapq: int = 0, exclude: int = FL.DEPTH_MASK) -> DataFrame:
    """Each interval with the sum of overlaps of aligned blocks (deletions and skips too, unless left out), the number of
    overlapping records and, with min_depth, the positions that reach it."""
    kept = depth_filter(df, exclude=exclude, min_mapq=min_mapq).where("rname is not null and pos is not null")
    iv = bed.withColumn("_iv", F.struct("chrom", "start0", "end0", *(["name"] if "name" in bed.columns else [])))
    right = iv.select(F.col("chrom").alias("r_chrom"), F.col("start0").alias("r_start0"), F.col("end0").alias("r_end0"), "_iv").distinct()
    b = block_rows(kept, "M=X" if skip_deletions else "M=XDN").select("chrom", "start0", "end0")
    meet = F.least("end0", "r_end0") - F.greatest("start0", "r_start0")
    sums = overlap_join(b, right).groupBy("_iv").agg(F.sum(meet).alias("bases"))
    n = overlap_join(span(kept).select("chrom", "start0", "end0"), right).groupBy("_iv").agg(F.count("*").alias("reads"))
    out = iv.join(sums, "_iv", "left").join(n, "_iv", "left")
    columns = [F.coalesce("bases", F.lit(0)).alias("bases"), F.coalesce("reads", F.lit(0)).alias("reads")]
    if min_depth is not None:
        runs = _sweep(b, {"depth": F.lit(1)}).where(F.col("depth") >= min_depth)
        out = out.join(overlap_join(runs.select("chrom", "start0", "end0"), right).groupBy("_iv").agg(F.sum(meet).alias("deep")), "_iv", "left")
        columns.append(F.coalesce("deep", F.lit(0)).alias("deep"))
    return out.select(*bed.columns, *columns)
