"""Pileup columns, consensus, and references from alignments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import cigar as C, flags as FL, sequence as Q, tags as T
from . import columns, intervals as I
from .filters import by_bed, by_regions, span
from .reference import with_stretch


def bases(
    df: DataFrame, min_base_quality: int = 13, min_mapq: int = 0, exclude: int = FL.DEPTH_MASK, reference: DataFrame | None = None, beside: Callable[[Column, Column], dict[str, Column]] | None = None
) -> DataFrame:
    """chrom, pos (1-based), base ('*' deleted, '>' skipped), q, mapq, reverse, first, last, ins, del_, ordinal, src, qname:
    one row for each record and position; an indel stands at the base before it. With a reference also ref, its base, and
    gap, the bases that a deletion behind the position takes. beside: more columns from the base's 0-based places in the read
    and from the record's start on the reference, and from df's own columns."""
    kept = df.where(FL.flag_filter(F.col("flag"), exclude=exclude) & (F.coalesce("mapq", F.lit(0)) >= min_mapq)).where("rname is not null and pos is not null and cigar is not null")
    if reference is not None:  # once for each record
        kept = with_stretch(span(kept), reference, "_stretch")
    blocks = C.blocks(F.col("pos"), C.ops(F.col("cigar")))
    # outer: the others are filtered by the size of what they explode, for which all of it would be made once more
    x = kept.withColumn("_b", blocks).select("*", F.posexplode_outer("_b").alias("_i", "b"))
    x = x.where(F.col("b.op").isin("M", "=", "X", "D", "N")).withColumns({"_next": F.get("_b", F.col("_i") + 1), "_end": _span_end(F.get("_b", F.size("_b") - 1))})
    x = x.withColumn("k", F.explode_outer(F.sequence(F.lit(0), F.col("b.len") - 1)))
    aligned = F.col("b.op").isin("M", "=", "X")
    query = (F.col("b.query0") + F.when(aligned, F.col("k")).otherwise(0)).cast("int")
    last_k = F.col("k") == F.col("b.len") - 1
    offset = (F.col("b.ref0") + F.col("k") + 2 - F.col("pos")).cast("int")  # in the record's stretch of the reference
    quality = F.when((F.col("qual") != "*") & (query < F.length("qual")), F.ascii(F.substr("qual", query + 1, F.lit(1))) - 33).otherwise(255)
    ins = F.when(last_k & (F.col("_next.op") == "I"), F.substr("seq", (F.col("_next.query0") + 1).cast("int"), F.col("_next.len")))
    x = x.select(
        F.col("rname").alias("chrom"), (F.col("b.ref0") + F.col("k") + 1).alias("pos"), F.when(aligned, F.substr("seq", query + 1, F.lit(1))).when(F.col("b.op") == "D", "*").otherwise(">").alias("base"),
        quality.alias("q"), F.coalesce("mapq", F.lit(0)).alias("mapq"), FL.bit(F.col("flag"), FL.REVERSE).alias("reverse"), (F.col("b.ref0") + F.col("k") + 1 == F.col("pos")).alias("first"),
        (F.col("b.ref0") + F.col("k") + 1 == F.col("_end")).alias("last"), ins.alias("ins"), F.when(last_k & aligned & (F.col("_next.op") == "D"), F.col("_next.len")).alias("del_"), "ordinal", "src", "qname",
        *([] if reference is None else [F.upper(F.substr("_stretch", offset, F.lit(1))).alias("ref"), F.when(last_k & aligned & (F.col("_next.op") == "D"), F.substr("_stretch", offset + 1, F.col("_next.len").cast("int"))).alias("gap")]),
        *([c.alias(name) for name, c in beside(query, offset - 1).items()] if beside else []),
    )
    return x.where(F.col("q") >= min_base_quality) if min_base_quality > 0 else x


def _span_end(last: Column) -> Column:
    """1-based last reference base from a record's last block."""
    return last["ref0"] + F.when(last["op"].isin(*C.REFERENCE), last["len"]).otherwise(0)


def _parts(df: DataFrame, reference: DataFrame, min_base_quality: int = 13, min_mapq: int = 0, exclude: int = FL.DEPTH_MASK) -> DataFrame:
    """Columns.PARTS: records are put in file order, so what a task tells of a position follows what tasks before it do."""
    kept = df.where(FL.flag_filter(F.col("flag"), exclude=exclude) & (F.coalesce("mapq", F.lit(0)) >= min_mapq)).where("rname is not null and pos is not null and cigar is not null")
    few = kept.select("src", "ordinal", "rname", "pos", "cigar", "seq", "qual", F.coalesce("mapq", F.lit(0)).alias("mapq"), FL.bit(F.col("flag"), FL.REVERSE).alias("reverse"))
    # ordered last: before a join Spark would leave the order out
    ordered = with_stretch(span(few), reference, "_stretch").drop("chrom", "start0", "end0").repartitionByRange("src", "ordinal").sortWithinPartitions("src", "ordinal")
    return ordered.mapInArrow(lambda batches: columns.pileup_parts(batches, min_base_quality), columns.PARTS)


def mpileup(df: DataFrame, reference: DataFrame, inputs: list[int] | None = None, regions: list[str] | None = None, bed: DataFrame | None = None, every: DataFrame | None = None, mates: bool = False, orphans: bool = True, **options) -> DataFrame:
    """chrom, pos, ref, depth, bases, quals: the text pileup; of each column the records in file order. A column without
    records has '*' for bases and quals.

    `inputs`: a column group depth_<src>, bases_<src>, quals_<src> for each of these, in place of one for all. `regions`,
    `bed`: positions in these only. `every`: the header's references, all of whose positions come. `mates`: where mates overlap,
    their qualities are merged first; without `orphans`, paired records of no proper pair are left out.
    """
    if mates or not orphans:
        from . import overlaps

        usable = FL.flag_filter(F.col("flag"), exclude=options.get("exclude", FL.DEPTH_MASK)) & (F.coalesce("mapq", F.lit(0)) >= options.get("min_mapq", 0))
        df = df.where(usable) if orphans else overlaps.without_orphans(df.where(usable))
        df = overlaps.merge_mates(df) if mates else df
    if regions:
        df = by_regions(df, regions)
    if bed is not None:
        df = by_bed(df, bed)
    x = _parts(df, reference, **options)
    if regions:
        x = x.where(I.region_filter(regions, F.col("chrom"), F.col("pos") - 1, F.col("pos")))
    if bed is not None:
        merged = I.merge_intervals(bed).select(F.col("chrom").alias("r_chrom"), F.col("start0").alias("r_start0"), F.col("end0").alias("r_end0"))
        x = I.overlap_join(x.withColumns({"start0": F.col("pos") - 1, "end0": F.col("pos")}), merged).drop("start0", "end0", "r_chrom", "r_start0", "r_end0")
    entry = F.struct("src", "ordinal", "t", "q")
    sides = {"": F.lit(True)} if inputs is None else {f"_{k}": F.col("src") == k for k in inputs}
    made = [c for k, mine in sides.items() for c in (F.sum(F.when(mine, F.col("n"))).alias(f"depth{k}"), F.sort_array(F.collect_list(F.when(mine, entry))).alias(f"c{k}"))]
    at = x.groupBy("chrom", "pos").agg(F.min("ref").alias("ref"), *made)
    if every is not None:
        all_ = every.select(F.col("name").alias("chrom"), F.lit(0).cast("bigint").alias("start0"), F.col("length").alias("end0"), F.lit(0).alias("src"), F.col("tid").alias("ordinal"))
        all_ = with_stretch(all_, reference, "_s").select("chrom", F.posexplode(F.split("_s", "")).alias("k", "r")).where("r <> ''")
        all_ = all_.select("chrom", (F.col("k") + 1).cast("bigint").alias("pos"), F.upper("r").alias("r"))
        at = all_.join(at, ["chrom", "pos"], "left").withColumn("ref", F.col("r")).drop("r")
    told = lambda c, part: F.coalesce(F.nullif(F.array_join(F.transform(c, lambda e: e[part]), ""), F.lit("")), F.lit("*"))
    return at.select("chrom", "pos", "ref", *[c for k in sides for c in (F.coalesce(f"depth{k}", F.lit(0)).cast("bigint").alias(f"depth{k}"), told(F.col(f"c{k}"), "t").alias(f"bases{k}"), told(F.col(f"c{k}"), "q").alias(f"quals{k}"))])


# IUPAC codes of the sets of A, C, G, T as bits 1, 2, 4, 8.
CODES = "NACMGRSVTWYHKDBN"


def consensus(df: DataFrame, call_fraction: float = 0.75, het_fraction: float = 0.5, min_depth: int = 1, ambiguous: bool = False, use_quality: bool = False, min_base_quality: int = 0, **options) -> DataFrame:
    """chrom, pos, call, quality: the best base (or '*') by summed weights, if its share is large enough; 'N' otherwise. Another letter
    than A, C, G, T counts for each of them, with an eighth of a base's weight."""
    x = bases(df, min_base_quality=min_base_quality, **options).where("base <> '>'")
    weight = F.col("q") if use_quality else F.lit(1)
    codes = {1: "A", 2: "C", 4: "G", 8: "T", 16: "*"}
    base = F.upper("base")
    share = lambda c, b: F.when(base == b, 8 * weight).when(~base.isin(*codes.values()) & F.lit(c < 16), weight)
    sums = x.groupBy("chrom", "pos").agg(F.count("*").alias("depth"), *[F.coalesce(F.sum(share(c, b)), F.lit(0)).alias(f"s{c}") for c, b in codes.items()])
    return call_sums(sums, call_fraction, het_fraction, min_depth, ambiguous)


def call_sums(sums: DataFrame, call_fraction: float, het_fraction: float, min_depth: int, ambiguous: bool) -> DataFrame:
    """call and quality for depth and the weights s1 (A), s2 (C), s4 (G), s8 (T), s16 (none) of each row, beside its other columns."""
    kept = [c for c in sums.columns if c not in ("s1", "s2", "s4", "s8", "s16")]
    codes = (1, 2, 4, 8, 16)
    # ties go to the earlier base, as the first to reach a score keeps it
    ranked = F.array_sort(F.array(*[F.struct((-F.col(f"s{c}")).alias("n"), F.lit(c).alias("c")) for c in codes]))
    x = sums.withColumns({"_r": ranked, "_all": F.expr("s1 + s2 + s4 + s8 + s16")})
    s1, s2, c1, c2 = -F.col("_r")[0]["n"], -F.col("_r")[1]["n"], F.col("_r")[0]["c"], F.col("_r")[1]["c"]
    both = F.lit(ambiguous) & (s1 > 0) & (s2 >= het_fraction * s1)
    used, code = s1 + F.when(both, s2).otherwise(0), F.when(s1 == 0, 15).when(both, c1.bitwiseOR(c2)).otherwise(c1)
    fails = (F.col("depth") < min_depth) | (used < call_fraction * F.col("_all"))
    code = F.when(fails, F.when(c1 == 16, 16).otherwise(0)).otherwise(code)
    letter = F.when(code >= 16, "*").otherwise(F.substr(F.lit(CODES), code + 1, F.lit(1)))
    return x.select(*kept, letter.alias("call"), F.when((code != 0) & (F.col("_all") > 0), F.floor(100 * used / F.col("_all"))).otherwise(0).cast("int").alias("quality"))


def consensus_text(calls: DataFrame, chunk: int = 10_000) -> DataFrame:
    """chrom, chunk, seq: calls as text in chunks of positions, gaps filled with N, deletions left out."""
    ends = calls.groupBy("chrom", F.floor((F.col("pos") - 1) / chunk).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("pos", "call"))).alias("c"))
    first = F.col("chunk") * chunk
    filled = F.aggregate("c", F.struct(first.alias("at"), F.lit("").alias("t")), lambda a, e: F.struct(e["pos"].alias("at"), F.concat(a["t"], F.repeat(F.lit("N"), (e["pos"] - a["at"] - 1).cast("int")), F.when(e["call"] == "*", "").otherwise(e["call"])).alias("t")))
    return ends.select("chrom", "chunk", filled["t"].alias("seq"))


def md_nm(df: DataFrame, reference: DataFrame) -> DataFrame:
    """src, ordinal, md, nm by comparison with the reference, in Arrow batches of records and the stretches they span."""
    x = with_stretch(span(df.where(_mapped())), reference)
    return x.withColumn("_m", _compare("cigar", "seq", "stretch")).select("src", "ordinal", "_m.md", "_m.nm")


def _mapped() -> Column:
    return ~FL.bit(F.col("flag"), FL.UNMAP) & F.expr("rname is not null and pos is not null and cigar is not null")


def _compare(*texts: str | Column) -> Column:
    return F.arrow_udf(lambda cigar, seq, ref: columns.mismatches(cigar, seq, ref), "md string, nm int")(*texts)


def calmd(df: DataFrame, reference: DataFrame, bin_qualities: bool = False, mask: bool = False) -> DataFrame:
    """reads with NM and MD set; `bin_qualities`: coarse qualities; `mask`: bases like the reference as '='."""
    x = with_stretch(span(df), reference, "_stretch", every=True)
    x = x.withColumn("_m", _compare("cigar", "seq", F.when(_mapped(), F.col("_stretch"))))
    x = T.set_tag(T.set_tag(x, "NM", "i", F.col("_m.nm")), "MD", "Z", F.col("_m.md"))
    if bin_qualities:
        x = x.withColumn("qual", Q.bin_qualities(F.col("qual")))
    if mask:
        x = _masked(x, reference)
    return x.select(*df.columns)


def _masked(df: DataFrame, reference: DataFrame) -> DataFrame:
    placed = F.col("rname").isNotNull() & F.col("pos").isNotNull() & F.col("cigar").isNotNull()
    x = df.join(with_stretch(span(df.where(placed)), reference, "_ref").select("src", "ordinal", "_ref"), ["src", "ordinal"], "left")
    blocks = F.filter(C.blocks(F.col("pos"), C.ops(F.col("cigar"))), lambda b: b["op"].isin("M", "=", "X"))
    x = x.withColumn("_bl", blocks)

    def base(c: Column, i: Column) -> Column:
        b = F.get(F.filter("_bl", lambda b: (b["query0"] <= i) & (i < b["query0"] + b["len"])), F.lit(0))
        ref = F.substr("_ref", (b["ref0"] + i - b["query0"] + 2 - F.col("pos")).cast("int"), F.lit(1))
        return F.when(F.upper(c) == F.upper(ref), "=").otherwise(c)

    return x.withColumn("seq", F.when(F.col("_ref").isNotNull(), F.array_join(F.transform(F.split("seq", ""), base), "")).otherwise(F.col("seq")))


def reference_from_md(df: DataFrame) -> DataFrame:
    """chrom, pos, base: the reference that records with MD tell; where they differ the last record wins."""
    x = df.where("rname is not null and pos is not null and cigar is not null").select("rname", "src", "ordinal", "pos", "cigar", "seq", T.value("MD").alias("md"))
    at = x.mapInArrow(columns.reference_told, columns.TOLD)
    return at.groupBy("chrom", "pos").agg(F.max_by("base", F.struct("src", "ordinal")).alias("base"))


def reference_text(bases_: DataFrame, header_sq: DataFrame, width: int = 60) -> DataFrame:
    """chrom, line, text: lines of the references, N where nothing is known."""
    every = header_sq.select(F.col("name").alias("chrom"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("length"))).alias("pos"))
    x = every.join(bases_, ["chrom", "pos"], "left").select("chrom", "pos", F.coalesce("base", F.lit("N")).alias("base"))
    line = F.floor((F.col("pos") - 1) / width).alias("line")
    return x.groupBy("chrom", line).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "base"))), lambda e: e["base"]), "").alias("text"))
