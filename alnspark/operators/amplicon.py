"""Amplicons: primers to amplicons, reads to amplicons, primer clipping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import cigar as C, flags as FL, tags as T
from . import depth as D
from .filters import span

#: Default margins.
TOLERANCE, MARGIN = 5, 30


def amplicons(primers: DataFrame) -> DataFrame:
    """chrom, amplicon, lefts, rights, max_left, min_left, min_right, max_right (1-based inside bounds): consecutive
    forward primers, then consecutive reverse ones, are one amplicon. A reference that begins with a reverse primer or
    ends with a forward one is an error."""
    w = Window.partitionBy("chrom").orderBy("start0", "end0")
    rev = F.col("strand") == "-"
    x = primers.withColumns({"_rev": rev, "_last": F.lag(rev).over(w), "_next": F.lead(rev).over(w)})
    bad = (F.col("_last").isNull() & F.col("_rev")) | (F.col("_next").isNull() & ~F.col("_rev"))
    x = x.withColumn("_new", F.when(bad, F.raise_error(F.lit("primers of an amplicon are out of order")).cast("int")).otherwise((~F.col("_rev") & F.coalesce("_last", F.lit(True))).cast("int")))
    x = x.withColumn("amplicon", F.sum("_new").over(w).cast("int"))
    left, right = F.when(~F.col("_rev"), F.col("end0")), F.when(F.col("_rev"), F.col("start0"))
    return x.groupBy("chrom", "amplicon").agg(
        F.sort_array(F.collect_list(left)).alias("lefts"), F.sort_array(F.collect_list(right)).alias("rights"), (F.max(left) + 1).alias("max_left"), (F.min(left) + 1).alias("min_left"),
        (F.min(right) - 1).alias("min_right"), (F.max(right) - 1).alias("max_right"),
    )


def read_amplicons(df: DataFrame, amps: DataFrame, margin: int = MARGIN, exclude: int = FL.UNMAP | FL.SECONDARY | FL.QCFAIL | FL.DUP | FL.SUPP) -> DataFrame:
    """src, ordinal, chrom, start0, end0 and the amplicons (the last that fits) at whose left primer the record starts
    and at whose right primer it ends."""
    x = span(df.where(FL.flag_filter(F.col("flag"), exclude=exclude)).where("rname is not null and pos is not null")).select("src", "ordinal", "chrom", "start0", "end0")
    lefts = F.broadcast(amps.select(F.col("chrom").alias("c1"), F.col("amplicon").alias("a1"), F.explode("lefts").alias("l")))
    rights = F.broadcast(amps.select(F.col("chrom").alias("c2"), F.col("amplicon").alias("a2"), F.explode("rights").alias("r")))
    at = x.join(lefts, (F.col("chrom") == F.col("c1")) & F.abs(F.col("start0") + 1 - F.col("l")).__le__(margin), "left").groupBy(*x.columns).agg(F.max("a1").alias("start_amplicon"))
    return at.join(rights, (F.col("chrom") == F.col("c2")) & F.abs(F.col("end0") - F.col("r")).__le__(margin), "left").groupBy(*at.columns).agg(F.max("a2").alias("end_amplicon"))


def amplicon_reads(df: DataFrame, amps: DataFrame, **options) -> DataFrame:
    """chrom, amplicon, reads: a record counts for the amplicon that it starts in, else for the one that it ends in."""
    n = read_amplicons(df, amps, **options).withColumn("amplicon", F.coalesce("start_amplicon", "end_amplicon")).where("amplicon is not null").groupBy("chrom", "amplicon").agg(F.count("*").alias("reads"))
    return amps.select("chrom", "amplicon").join(n, ["chrom", "amplicon"], "left").select("chrom", "amplicon", F.coalesce("reads", F.lit(0)).alias("reads"))


def amplicon_coverage(df: DataFrame, amps: DataFrame, min_depth: int = 1) -> DataFrame:
    """chrom, amplicon, mean depth and percent of positions that reach min_depth, inside the primers."""
    runs = D.depth_runs(D.depth_filter(df)).where("depth > 0")
    lo, hi = F.col("max_left") - 1, F.col("min_right")
    inside = F.greatest(F.least("end0", "hi") - F.greatest("start0", "lo"), F.lit(0))
    a = F.broadcast(amps.select(F.col("chrom").alias("c"), "amplicon", lo.alias("lo"), hi.alias("hi")))
    met = runs.join(a, (F.col("chrom") == F.col("c")) & (F.col("start0") < F.col("hi")) & (F.col("lo") < F.col("end0")))
    sums = met.groupBy("c", "amplicon").agg(F.sum(inside * F.col("depth")).alias("bases"), F.sum(F.when(F.col("depth") >= min_depth, inside)).alias("deep"))
    x = amps.select("chrom", "amplicon", (hi - lo).alias("size")).join(sums.withColumnRenamed("c", "chrom"), ["chrom", "amplicon"], "left")
    return x.select("chrom", "amplicon", F.round(F.coalesce("bases", F.lit(0)) / F.col("size"), 6).alias("depth"), F.round(100 * F.coalesce("deep", F.lit(0)) / F.col("size"), 6).alias("covered"))


def template_coordinates(df: DataFrame, amps: DataFrame, bin_: int = 1) -> DataFrame:
    """chrom, start0, end0, n: ends of templates, like ones in bins together."""
    x = read_amplicons(df, amps)
    return x.groupBy("chrom", (F.floor(F.col("start0") / bin_) * bin_).alias("start0"), (F.floor(F.col("end0") / bin_) * bin_).alias("end0")).agg(F.count("*").alias("n"))


def primer_clips(df: DataFrame, primers: DataFrame, strand: bool = True, tolerance: int = TOLERANCE) -> DataFrame:
    """src, ordinal, left and right: reference bases to clip at both ends by the primer that reaches farthest into the
    read, of those that begin within the tolerance."""
    x = span(df.where(~FL.bit(F.col("flag"), FL.UNMAP)).where("rname is not null and pos is not null")).select("src", "ordinal", "chrom", "start0", "end0")
    p = F.broadcast(primers.select(F.col("chrom").alias("c"), F.col("start0").alias("s"), F.col("end0").alias("e"), (F.col("strand") == "-").alias("rev")))
    at_left = (F.col("start0") >= F.greatest(F.col("s") - tolerance, F.lit(0))) & (F.col("start0") < F.col("e"))
    at_right = (F.col("end0") > F.col("s")) & (F.col("end0") <= F.col("e") + tolerance)
    one = (F.col("chrom") == F.col("c")) & (at_left | at_right)
    left = F.when(at_left & (~F.col("rev") if strand else F.lit(True)), F.col("e") - F.col("start0"))
    right = F.when(at_right & (F.col("rev") if strand else F.lit(True)), F.col("end0") - F.col("s"))
    return x.join(p, one, "left").groupBy("src", "ordinal").agg(F.coalesce(F.max(left), F.lit(0)).alias("left"), F.coalesce(F.max(right), F.lit(0)).alias("right"))


def _wanted(df: DataFrame, primers: DataFrame, both_ends: bool, strand: bool, tolerance: int) -> DataFrame:
    """df with _out (unmapped, failed, or on a reference without primers: left as it is), _l and _r, what to clip."""
    named = F.broadcast(primers.select(F.col("chrom").alias("_chrom")).distinct())
    x = df.join(primer_clips(df, primers, strand, tolerance), ["src", "ordinal"], "left").join(named, F.col("rname") == F.col("_chrom"), "left")
    x = x.withColumn("_out", FL.bit(F.col("flag"), FL.UNMAP | FL.QCFAIL) | F.col("_chrom").isNull())
    rev = FL.bit(F.col("flag"), FL.REVERSE)
    want = lambda side, mine: F.when(F.col("_out"), 0).otherwise(F.coalesce(F.col(side) if both_ends else F.when(mine, F.col(side)), F.lit(0)))
    return x.withColumns({"_l": want("left", ~rev), "_r": want("right", rev)})


def clip_counts(df: DataFrame, primers: DataFrame, both_ends: bool = False, strand: bool = True, tolerance: int = TOLERANCE) -> DataFrame:
    """One row: total, excluded, forward and reverse clips, both, not_clipped."""
    x = _wanted(df, primers, both_ends, strand, tolerance)
    left, right = F.col("_l") > 0, F.col("_r") > 0
    return x.agg(F.count("*").alias("total"), F.count_if("_out").alias("excluded"), F.count_if(left).alias("forward"), F.count_if(right).alias("reverse"), F.count_if(left & right).alias("both"), F.count_if(~F.col("_out") & ~left & ~right).alias("not_clipped"))


def clip(
    df: DataFrame, primers: DataFrame, hard: bool = False, both_ends: bool = False, strand: bool = True, tolerance: int = TOLERANCE, original: bool = False, mark_fail: bool = False, fail_length: int | None = None,
    filter_length: int | None = None, unmap_length: int | None = None, only_clipped: bool = False, drop_excluded: bool = False, rejects: bool = False,
) -> DataFrame:
    """reads with primers clipped: at the 5' end, or at both. CIGAR and POS follow; NM and MD go where something was
    clipped; a read of which nothing is left is unmapped. Excluded are unmapped and failed records and references without
    primers.

    `original`: what the alignment was is kept in OA; `mark_fail`: records without a primer fail; records with at most so
    many bases left fail (`fail_length`), go (`filter_length`) or are unmapped (`unmap_length`); `only_clipped`: others that
    aren't excluded go; `drop_excluded`: excluded ones go; `rejects`: those that go, instead of those that stay.
    """
    x = _wanted(df, primers, both_ends, strand, tolerance)
    if original:
        kept = x.withColumns({"_tags": F.col("tags"), "_order": F.col("tag_order")})
        x = original_alignment(kept).withColumns({c: F.when((F.col("_l") > 0) | (F.col("_r") > 0), F.col(c)).otherwise(F.col(old)) for c, old in (("tags", "_tags"), ("tag_order", "_order"))})

    @F.pandas_udf("cigar string, pos bigint, head int, tail int")
    def cut(cigar, pos, left, right):
        import pandas as pd

        return pd.DataFrame([_clip_cigar(c, p, int(a), int(b), hard) if c else (None, None, 0, 0) for c, p, a, b in zip(cigar, pos, left, right, strict=True)], columns=["cigar", "pos", "head", "tail"]).astype({"pos": "Int64"})

    touched = (F.col("_l") > 0) | (F.col("_r") > 0)
    x = x.withColumn("_c", F.when(touched & F.col("cigar").isNotNull(), cut("cigar", "pos", "_l", "_r")))
    done = F.col("_c").isNotNull()
    gone = done & (F.col("_c.cigar") == "*")
    keep = lambda c: F.when(done & F.lit(hard) & ~gone, F.substr(c, F.col("_c.head") + 1, F.length(c) - F.col("_c.head") - F.col("_c.tail"))).otherwise(F.col(c))
    x = x.withColumns({
        "tags": F.when(done, F.map_filter("tags", lambda k, _: ~k.isin("NM", "MD"))).otherwise(F.col("tags")), "tag_order": F.when(done, F.filter("tag_order", lambda k: ~k.isin("NM", "MD"))).otherwise(F.col("tag_order")),
        "seq": keep("seq"), "qual": keep("qual"), "flag": F.when(gone, F.col("flag").bitwiseOR(FL.UNMAP)).otherwise(F.col("flag")), "cigar": F.when(gone, F.lit(None)).when(done, F.col("_c.cigar")).otherwise(F.col("cigar")), "pos": F.when(done & ~gone, F.col("_c.pos")).otherwise(F.col("pos")),
    })
    examined, length = ~F.col("_out"), C.total(C.ops(F.col("cigar")), "MI=X")
    short = lambda most: examined & F.lit(most is not None) & (length <= (most or 0))
    fails = short(fail_length) | (examined & F.lit(mark_fail) & ~touched)
    goes = short(filter_length) | (F.lit(only_clipped) & examined & ~touched) | (F.lit(drop_excluded) & F.col("_out"))
    x = x.withColumns({"_fails": fails, "_goes": goes, "_unmaps": short(unmap_length)})
    flag = F.col("flag").bitwiseOR(F.when(F.col("_fails"), FL.QCFAIL).otherwise(0)).bitwiseOR(F.when(F.col("_unmaps"), FL.UNMAP).otherwise(0))
    x = x.withColumns({"flag": flag, "mapq": F.when(F.col("_unmaps"), 0).otherwise(F.col("mapq")), "cigar": F.when(~F.col("_unmaps"), F.col("cigar"))})
    return x.where(F.col("_goes") == rejects).select(*df.columns)


def _clip_cigar(cigar: str, pos: int, left: int, right: int, hard: bool) -> tuple[str, int, int, int]:
    """CIGAR, POS and the clipped bases at both ends after `left` and `right` reference bases were taken off."""
    import re

    ops = [(int(n), k) for n, k in re.findall(r"(\d+)([MIDNSHP=XB])", cigar)]

    def trim(items: list[tuple[int, str]], want: int) -> tuple[list[tuple[int, str]], int, int]:
        """What is left, query bases clipped anew, reference bases gone."""
        hards = sum(n for n, k in items if k == "H" and items.index((n, k)) == 0)
        rest = [x for x in items if x[1] != "H"] if items and items[0][1] == "H" else list(items)
        tail_h = [x for x in items[1:] if x[1] == "H"]
        rest = [x for x in rest if x[1] != "H"]
        query = ref = 0
        soft = 0
        while rest:
            n, k = rest[0]
            if k == "S":
                soft += n
                rest.pop(0)
            elif ref >= want and k in "M=X":
                break
            elif k in "M=X":
                take = min(n, want - ref)
                query, ref = query + take, ref + take
                rest[0] = (n - take, k)
                if n == take:
                    rest.pop(0)
            else:
                query, ref = query + (n if k == "I" else 0), ref + (n if k in "DN" else 0)
                rest.pop(0)
        if not any(k in "M=X" for _, k in rest):
            return [], query + soft, ref
        front = ([(hards + query + soft, "H")] if hard else ([(hards, "H")] if hards else []) + [(query + soft, "S")]) if query + soft or hards else []
        return [x for x in front if x[0]] + rest + tail_h, query + soft, ref

    head = tail = 0
    if left:
        ops, head, moved = trim(ops, left)
        pos += moved
    if right and ops:
        ops, tail, _ = trim(ops[::-1], right)
        ops = ops[::-1]
    return ("".join(f"{n}{k}" for n, k in ops) or "*", pos, head, tail)


def original_alignment(df: DataFrame) -> DataFrame:
    """reads with OA: what each record says of its alignment, after what the tag said before. To be set before a record is
    changed. Without NM there is no comma between CIGAR and quality, as other tools write it."""
    strand = F.when(FL.bit(F.col("flag"), FL.REVERSE), "-").otherwise("+")
    place = F.concat_ws(",", "qname", F.coalesce("pos", F.lit(0)).cast("string"), strand, F.coalesce("cigar", F.lit("*")))
    quality, nm = F.coalesce("mapq", F.lit(255)).cast("string"), T.value("NM")
    told = F.when(nm.isNotNull(), F.concat(place, F.lit(","), quality, F.lit(","), nm, F.lit(";"))).otherwise(F.concat(place, quality, F.lit(",;")))
    return T.set_tag(df, "OA", "Z", F.concat(F.coalesce(T.value("OA"), F.lit("")), told))
