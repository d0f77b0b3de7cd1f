"""The statistics report, one DataFrame for each section; every section is one scan and one combined aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import cigar as C, flags as FL, sequence as Q, tags as T
from ..sources.scratch import written
from . import depth as D
from .reference import with_stretch

# Bins of the GC histograms, the longest indel counted, the bins of the GC-depth section.
GC_BINS, LONGEST_INDEL, GCD_BIN = 200, 300, 20_000


def order(flag: Column) -> Column:
    """1 first fragments (and unpaired), 2 last, 0 neither or both."""
    one, two = FL.bit(flag, FL.READ1), FL.bit(flag, FL.READ2)
    return F.when(~FL.bit(flag, FL.PAIRED) | (one & ~two), 1).when(two & ~one, 2).otherwise(0)


def primary(df: DataFrame) -> DataFrame:
    return df.where(~FL.bit(F.col("flag"), FL.SECONDARY | FL.SUPP))


def _orientation() -> Column:
    """0 inward, 1 outward, 2 other."""
    flag = F.col("flag")
    sign = lambda c: F.when(c, 1).otherwise(-1)
    first, fwd, mfwd = sign(FL.bit(flag, FL.READ1)), sign(~FL.bit(flag, FL.REVERSE)), sign(~FL.bit(flag, FL.MREVERSE))
    ahead = first * (F.coalesce("pnext", F.lit(0)) - F.coalesce("pos", F.lit(0)))
    return F.when(fwd == mfwd, 2).when(ahead == 0, 0).when((ahead > 0) == (first * fwd > 0), 0).otherwise(1)


def _pairs(df: DataFrame, cap: int) -> DataFrame:
    both = primary(df).where(FL.bit(F.col("flag"), FL.PAIRED) & ~FL.bit(F.col("flag"), FL.UNMAP | FL.MUNMAP))
    size = F.least(F.abs("tlen"), F.lit(cap))
    return both.where((size > 0) | (F.col("tid") == F.col("mtid"))).select(size.alias("size"), _orientation().alias("way"))


def insert_sizes(df: DataFrame, cap: int = 8000, main_bulk: float = 0.99) -> DataFrame:
    """size, pairs, inward, outward, other: pairs by insert size, up to the size at which the main bulk is reached."""
    half = lambda k: F.floor(F.count_if(F.col("way") == k) / 2)
    sizes = _pairs(df, cap).groupBy("size").agg(half(0).alias("inward"), half(1).alias("outward"), half(2).alias("other")).withColumn("pairs", F.expr("inward + outward + other"))
    w = Window.orderBy("size")  # at most `cap` + 1 rows
    x = sizes.where("pairs > 0").withColumns({"_sum": F.sum("pairs").over(w), "_all": F.sum("pairs").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    return x.where((F.col("_sum") - F.col("pairs")) / F.col("_all") <= main_bulk).select("size", "pairs", "inward", "outward", "other")


def insert_size_summary(df: DataFrame, cap: int = 8000, main_bulk: float = 0.99) -> DataFrame:
    """mean and sd of the main bulk."""
    n = F.sum("pairs")
    mean = F.sum(F.col("size") * F.col("pairs")) / n
    x = insert_sizes(df, cap, main_bulk).agg(mean.alias("mean"), (F.sum(F.col("size") * F.col("size") * F.col("pairs")) / n).alias("square"))
    return x.select(F.round("mean", 4).alias("mean"), F.round(F.sqrt(F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(0.0))), 4).alias("sd"))


def summary(df: DataFrame, required: int = 0, filtered: int = 0, remove_dups: bool = False, cap: int = 8000) -> DataFrame:
    """metric, value: the summary numbers, from one aggregate."""
    flag = F.col("flag")
    b = lambda m: FL.bit(flag, m)
    out = ~FL.flag_filter(flag, required, filtered | (FL.DUP if remove_dups else 0))
    prime = ~out & ~b(FL.SECONDARY | FL.SUPP)
    mapped, paired = prime & ~b(FL.UNMAP), prime & b(FL.PAIRED)
    length, one, two = F.length("seq"), prime & (order(flag) == 1), prime & (order(flag) == 2)
    ops = C.ops(F.col("cigar"))
    both = paired & ~b(FL.UNMAP | FL.MUNMAP)
    size = F.least(F.abs("tlen"), F.lit(cap))
    sized = both & ((size > 0) | F.coalesce(F.col("tid") == F.col("mtid"), F.lit(False)))
    way = _orientation()
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    total = lambda c, x: F.coalesce(F.sum(F.when(c, x)), F.lit(0))
    far = both & F.col("tid").isNotNull() & F.col("mtid").isNotNull() & (F.col("tid") != F.col("mtid"))
    sums = {
        "raw total sequences": n(out | prime), "filtered sequences": n(out), "sequences": n(prime), "1st fragments": n(one), "last fragments": n(two), "reads mapped": n(mapped), "reads mapped and paired": n(both),
        "reads unmapped": n(prime & b(FL.UNMAP)), "reads properly paired": n(paired & b(FL.PROPER)), "reads paired": n(paired), "reads duplicated": n(prime & b(FL.DUP)), "reads MQ0": n(mapped & (F.col("mapq") == 0)),
        "reads QC failed": n(prime & b(FL.QCFAIL)), "non-primary alignments": n(~out & b(FL.SECONDARY)), "supplementary alignments": n(~out & ~b(FL.SECONDARY) & b(FL.SUPP)), "total length": total(prime, length),
        "total first fragment length": total(one, length), "total last fragment length": total(two, length), "bases mapped": total(mapped, length), "bases mapped (cigar)": total(mapped, C.total(ops, "MI=X")), "bases duplicated": total(prime & b(FL.DUP), length),
        "mismatches": total(mapped, F.coalesce(T.value("NM").try_cast("bigint"), F.lit(0))), "maximum length": F.coalesce(F.max(F.when(prime, length)), F.lit(0)),
        "inward oriented pairs": F.floor(n(sized & (way == 0)) / 2), "outward oriented pairs": F.floor(n(sized & (way == 1)) / 2), "pairs with other orientation": F.floor(n(sized & (way == 2)) / 2), "pairs on different chromosomes": F.floor(n(far) / 2),
        "_quality": total(prime, F.coalesce(F.aggregate(Q.qualities(F.col("qual")), F.lit(0), lambda a, q: a + q), F.lit(0))),
    }
    x = df.agg(*[c.cast("double").alias(k) for k, c in sums.items()])
    c = lambda k: F.col(f"`{k}`")
    ratio = lambda a, d: F.round(F.coalesce(F.try_divide(c(a), c(d)), F.lit(0.0)), 6)
    x = x.withColumns({"error rate": ratio("mismatches", "bases mapped (cigar)"), "average length": F.round(F.coalesce(F.try_divide(c("total length"), c("sequences")), F.lit(0.0))), "average quality": ratio("_quality", "total length")})
    names = [k for k in x.columns if k[0] != "_"]
    return x.selectExpr(f"stack({len(names)}, " + ", ".join(f"'{k}', `{k}`" for k in names) + ") as (metric, value)")


def _cycles(df: DataFrame, of: Column) -> DataFrame:
    """fragment, cycle (from 1, in the order of sequencing), v: the elements of an array of each primary record."""
    x = primary(df).select(order(F.col("flag")).alias("fragment"), F.when(FL.bit(F.col("flag"), FL.REVERSE), F.reverse(of)).otherwise(of).alias("a")).where("fragment > 0")
    return x.select("fragment", F.posexplode("a").alias("cycle", "v")).withColumn("cycle", F.col("cycle") + 1)


def quality_by_cycle(df: DataFrame) -> DataFrame:
    """fragment, cycle, quality, n."""
    return _cycles(df, Q.qualities(F.col("qual"))).groupBy("fragment", "cycle", F.col("v").alias("quality")).agg(F.count("*").alias("n"))


def bases_by_cycle(df: DataFrame, read_strand: bool = False) -> DataFrame:
    """fragment, cycle and counts of a, c, g, t, n, other. read_strand: reverse records are complemented."""
    bases = F.split(F.upper("seq"), "")
    if read_strand:
        bases = F.split(F.when(FL.bit(F.col("flag"), FL.REVERSE), F.translate(F.upper("seq"), "ACGT", "TGCA")).otherwise(F.upper("seq")), "")
    x = _cycles(df, bases)
    counts = [F.count_if(F.col("v") == b.upper()).alias(b) for b in "acgtn"]
    return x.groupBy("fragment", "cycle").agg(*counts, F.count_if(~F.col("v").isin(*"ACGTN")).alias("other"))


def gc_content(df: DataFrame) -> DataFrame:
    """fragment, bin, n: each record counts in all bins that its GC share spans."""
    x = primary(df).where(F.length("seq") > 0).select(order(F.col("flag")).alias("fragment"), Q.gc_count(F.col("seq")).alias("gc"), F.length("seq").alias("l")).where("fragment > 0")
    x = x.withColumns({"lo": F.expr(f"gc * {GC_BINS - 1} div l"), "hi": F.expr(f"least((gc + 1) * {GC_BINS - 1} div l, {GC_BINS - 1})")})
    return x.groupBy("fragment", "lo", "hi").count().where("hi > lo").select("fragment", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("bin"), "count").groupBy("fragment", "bin").agg(F.sum("count").alias("n"))


def read_lengths(df: DataFrame) -> DataFrame:
    """fragment, length (hard clips included), n."""
    length = F.length("seq") + C.total(C.ops(F.col("cigar")), "H")
    return primary(df).groupBy(order(F.col("flag")).alias("fragment"), length.alias("length")).agg(F.count("*").alias("n"))


def mapping_qualities(df: DataFrame) -> DataFrame:
    usable = ~FL.bit(F.col("flag"), FL.UNMAP | FL.SECONDARY | FL.SUPP | FL.QCFAIL | FL.DUP)
    return df.where(usable).groupBy(F.coalesce("mapq", F.lit(255)).alias("mapq")).agg(F.count("*").alias("n"))


def _indels(df: DataFrame) -> DataFrame:
    x = primary(df).where(~FL.bit(F.col("flag"), FL.UNMAP)).select(order(F.col("flag")).alias("fragment"), FL.bit(F.col("flag"), FL.REVERSE).alias("r"), F.length("seq").alias("l"), F.explode(C.blocks(F.col("pos"), C.ops(F.col("cigar")))).alias("b"))
    x = x.where(F.col("b.op").isin("I", "D")).select("fragment", "b.op", F.col("b.len").alias("len"), F.when(~F.col("r"), F.col("b.query0") - F.when(F.col("b.op") == "D", 1).otherwise(0)).otherwise(F.col("l") - F.col("b.query0") - F.when(F.col("b.op") == "I", F.col("b.len")).otherwise(1)).alias("at"))
    return x.where((F.col("op") == "I") | (F.col("at") >= 0))


def indel_lengths(df: DataFrame) -> DataFrame:
    """length, insertions, deletions."""
    return _indels(df).where(F.col("len") <= LONGEST_INDEL).groupBy(F.col("len").alias("length")).agg(F.count_if(F.col("op") == "I").alias("insertions"), F.count_if(F.col("op") == "D").alias("deletions"))


def indels_by_cycle(df: DataFrame) -> DataFrame:
    """fragment, cycle (from 1), insertions, deletions."""
    return _indels(df).where("fragment > 0 and at >= 0").groupBy("fragment", (F.col("at") + 1).cast("int").alias("cycle")).agg(F.count_if(F.col("op") == "I").alias("insertions"), F.count_if(F.col("op") == "D").alias("deletions"))


def coverage_histogram(df: DataFrame, least: int = 1, most: int = 1000, step: int = 1) -> DataFrame:
    """lo, hi, positions: positions by depth, of primary mapped records."""
    runs = D.depth_runs(primary(df).where(~FL.bit(F.col("flag"), FL.UNMAP))).where(F.col("depth") >= least)
    lo = F.lit(least) + F.floor((F.least("depth", F.lit(most)) - least) / step) * step
    return runs.groupBy(lo.cast("int").alias("lo")).agg(F.sum(F.col("end0") - F.col("start0")).alias("positions")).select("lo", F.least(F.col("lo") + step - 1, F.lit(most)).alias("hi"), "positions")


def checksums(df: DataFrame, filtered: int = 0) -> DataFrame:
    """names, sequences, qualities: sums of CRC32, modulo 2**32, in any order. Sequences are packed, two bases a byte."""
    hexed = F.translate(F.upper("seq"), "=ACMGRSVTWYHKDBN", "0123456789ABCDEF")
    packed = F.unhex(F.when(F.length("seq") % 2 == 1, F.concat(hexed, F.lit("0"))).otherwise(hexed))
    quals = F.unhex(F.array_join(F.transform(Q.qualities(F.col("qual")), lambda q: F.lpad(F.hex(q.cast("bigint")), 2, "0")), ""))
    plain = F.coalesce(quals, F.unhex(F.repeat(F.lit("FF"), F.length("seq"))))
    s = lambda c: (F.coalesce(F.sum(F.crc32(c)), F.lit(0)) % (1 << 32))
    return df.where(FL.flag_filter(F.col("flag"), exclude=filtered)).agg(s(F.col("qname").cast("binary")).alias("names"), s(packed).alias("sequences"), s(plain).alias("qualities"))


def mismatches_by_cycle(df: DataFrame, reference: DataFrame) -> DataFrame:
    """cycle, quality, n: aligned bases that differ from the reference ('N' counts as quality 0)."""
    x = D.block_rows(primary(df).where(~FL.bit(F.col("flag"), FL.UNMAP)).withColumn("_q", Q.qualities(F.col("qual"))))
    x = with_stretch(x, reference, "_ref")  # once for each block
    x = x.withColumn("k", F.explode(F.sequence(F.lit(0), (F.col("end0") - F.col("start0") - 1).cast("int"))))
    base, ref = F.upper(F.substr("seq", (F.col("query0") + F.col("k") + 1).cast("int"), F.lit(1))), F.upper(F.substr("_ref", F.col("k") + 1, F.lit(1)))
    cycle = F.when(FL.bit(F.col("flag"), FL.REVERSE), F.length("seq") - F.col("query0") - F.col("k")).otherwise(F.col("query0") + F.col("k") + 1)
    q = F.when(base == "N", 0).otherwise(F.coalesce(F.get("_q", (F.col("query0") + F.col("k")).cast("int")), F.lit(255)) + 1)
    return x.select(cycle.cast("int").alias("cycle"), q.alias("quality"), base.alias("b"), ref.alias("r")).where("b = 'N' or b <> r").groupBy("cycle", "quality").agg(F.count("*").alias("n"))


def gc_depth(df: DataFrame) -> DataFrame:
    """tid, bin, depth, gc: records in runs of 20 kb, each begun by the first record beyond the last run. A run's start
    depends on the run before, so a reference is read in order, in batches, with two numbers kept."""
    rows = df.where("tid is not null and pos is not null").where(~FL.bit(F.col("flag"), FL.UNMAP | FL.SECONDARY | FL.SUPP)).select("tid", "pos", (Q.gc_count(F.col("seq")) / F.length("seq")).alias("gc"))

    def run(batches):
        import pandas as pd

        tid = start = None
        n, depth, gc = 0, 0, 0.0
        for b in batches:
            out = []
            for t, p, g in zip(b["tid"], b["pos"], b["gc"], strict=True):
                if t != tid or p - start > GCD_BIN:
                    if depth:
                        out.append((tid, n, depth, gc / depth))
                    n, tid, start, depth, gc = (n + 1 if t == tid else 0), t, p, 0, 0.0
                depth, gc = depth + 1, gc + g
            yield pd.DataFrame(out, columns=["tid", "bin", "depth", "gc"])
        if depth:
            yield pd.DataFrame([(tid, n, depth, gc / depth)], columns=["tid", "bin", "depth", "gc"])

    return rows.repartition("tid").sortWithinPartitions("tid", "pos").mapInPandas(run, "tid int, bin int, depth bigint, gc double")


#: Fixed value: reads aren't trimmed below this length.
LEAST_TRIMMED = 35


def trimmed(qual: Column, reverse: Column, threshold: int) -> Column:
    """Bases that quality trimming takes off the end of the sequenced strand: the longest end whose sum of (threshold -
    quality) is largest, as long as the running sum stays positive."""
    q = Q.qualities(qual)
    ordered = F.when(reverse, q).otherwise(F.reverse(q))
    seen = F.slice(ordered, 1, F.greatest(F.size(ordered) - LEAST_TRIMMED + 1, F.lit(0)))
    start = F.struct(F.lit(0).alias("l"), F.lit(0).alias("s"), F.lit(0).alias("most"), F.lit(0).alias("at"), F.lit(True).alias("on"))

    def step(a: Column, v: Column) -> Column:
        s = a["s"] + threshold - v
        on = a["on"] & (s >= 0)
        better = on & (s > a["most"])
        return F.struct((a["l"] + 1).alias("l"), s.alias("s"), F.when(better, s).otherwise(a["most"]).alias("most"), F.when(better, a["l"]).otherwise(a["at"]).alias("at"), on.alias("on"))

    return F.coalesce(F.aggregate(seen, start, step, lambda a: a["at"]), F.lit(0))


def trimmed_bases(df: DataFrame, threshold: int) -> DataFrame:
    """One row, bases: what trimming takes off all primary records."""
    return primary(df).agg(F.coalesce(F.sum(trimmed(F.col("qual"), FL.bit(F.col("flag"), FL.REVERSE), threshold)), F.lit(0)).cast("bigint").alias("bases"))


def _barcodes(df: DataFrame, tag: str, quality_tag: str) -> DataFrame:
    """b, q, stop of the barcodes of first fragments: those no longer than the first one. A character that is no base
    parts two barcodes; it has to stand where the first such one stood, and a barcode is read up to another (stop)."""
    at = F.struct("src", "ordinal")
    x = primary(df).where(order(F.col("flag")) == 1).select("src", "ordinal", T.value(tag).alias("b"), T.value(quality_tag).alias("q")).where("b <> ''")
    odd = F.filter(F.transform(F.split("b", ""), lambda c, i: F.when(~c.isin("A", "C", "G", "T", "N"), i)), lambda i: i.isNotNull())
    # barcodes are fewer than records: each with its qualities, how often it comes and where first
    x = written(x.groupBy("b", "q").agg(F.count("*").alias("n"), F.min(at).alias("at")).withColumn("_odd", odd), "barcodes")
    most = x.agg(F.min_by(F.length("b"), "at").alias("most")).first()["most"]
    told = x.where(F.length("b") <= F.lit(most))
    sep = told.where("size(_odd) > 0").agg(F.min_by(F.col("_odd")[0], "at").alias("sep")).first()["sep"]
    return told.select("b", "q", "n", F.get(F.filter("_odd", lambda i: i != F.lit(sep)), F.lit(0)).alias("stop"))


def barcode_bases(df: DataFrame, tag: str = "BC", quality_tag: str = "QT") -> DataFrame:
    """cycle, a, c, g, t, n: the bases of barcodes by their place, of first fragments."""
    per = _barcodes(df, tag, quality_tag).groupBy("b", "stop").agg(F.sum("n").alias("n"))
    x = per.select(F.posexplode(F.split("b", "")).alias("k", "base"), "stop", "n").where("base <> '' and (stop is null or k < stop)")
    return x.groupBy((F.col("k") + 1).alias("cycle")).agg(*[F.sum(F.when(F.col("base") == b, F.col("n")).otherwise(0)).alias(b.lower()) for b in "ACGTN"])


def barcode_qualities(df: DataFrame, tag: str = "BC", quality_tag: str = "QT") -> DataFrame:
    """cycle, quality, n: the qualities of the same barcodes, where there are as many as bases."""
    per = _barcodes(df, tag, quality_tag).where("stop is null and length(q) = length(b)").groupBy("q").agg(F.sum("n").alias("n"))
    x = per.select(F.posexplode(Q.qualities(F.col("q"))).alias("k", "quality"), "n")
    return x.groupBy((F.col("k") + 1).alias("cycle"), "quality").agg(F.sum("n").alias("n"))
