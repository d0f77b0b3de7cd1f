"""Record filters and projections: each takes reads and gives reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import cigar as C, flags as FL, tags as T
from ..functions.hashes import fnv1a
from . import intervals as I


def span(df: DataFrame) -> DataFrame:
    """reads with chrom, start0, end0: at least one base for what is placed."""
    length = F.greatest(C.reference_length(C.ops(F.col("cigar"))), F.lit(1))
    return df.withColumns({"chrom": F.col("rname"), "start0": F.col("pos") - 1, "end0": F.col("pos") - 1 + length})


def by_flags(df: DataFrame, require: int = 0, exclude: int = 0, include: int = 0, exclude_all: int = 0) -> DataFrame:
    return df.where(FL.flag_filter(F.col("flag"), require, exclude, include, exclude_all))


def by_mapq(df: DataFrame, least: int) -> DataFrame:
    """A missing quality counts as 0."""
    return df.where(F.coalesce("mapq", F.lit(0)) >= least)


def by_query_length(df: DataFrame, least: int) -> DataFrame:
    return df.where(C.query_length(C.ops(F.col("cigar"))) >= least)


def by_read_length(df: DataFrame, least: int) -> DataFrame:
    """M, I, = and X only: soft clips don't count here."""
    return df.where(C.total(C.ops(F.col("cigar")), "MI=X") >= least)


def by_names(df: DataFrame, names: DataFrame, deny: bool = False) -> DataFrame:
    """Records whose qname is (or isn't) among names.qname."""
    return df.join(names.select("qname").distinct(), "qname", "left_anti" if deny else "left_semi").select(*df.columns)


def by_read_group(df: DataFrame, groups: list[str], need_group: bool = False) -> DataFrame:
    """Records without a group pass, unless need_group."""
    rg = T.value("RG")
    return df.where(F.coalesce(rg.isin(*groups), F.lit(not need_group)))


def by_library(df: DataFrame, header_rg: DataFrame, library: str) -> DataFrame:
    """Records of groups with this LB; those without a group don't pass."""
    groups = F.broadcast(header_rg.where(F.col("lb") == library).select(F.col("id").alias("_rg")).distinct())
    return df.join(groups, T.value("RG") == F.col("_rg"), "left_semi")


def by_tag(df: DataFrame, name: str, values: list[str] | None = None) -> DataFrame:
    """Records that have the tag, with one of the values if any are given."""
    v = T.value(name)
    return df.where(F.coalesce(v.isin(*values) if values else v.isNotNull(), F.lit(False)))


def by_regions(df: DataFrame, regions: list[str], longest: int | None = None) -> DataFrame:
    """Records that overlap any region. The names and the upper ends are plain conditions on rname and pos, which reach
    the scan, so a file sorted by place is read no further; with `longest`, the most bases of the reference that a record
    of this table spans, the lower ends are, too."""
    s = span(df.where(I.region_bounds(regions, F.col("rname"), F.col("pos"), longest)))
    return s.where(I.region_filter(regions, F.col("chrom"), F.col("start0"), F.col("end0"))).select(*df.columns)


def by_bed(df: DataFrame, bed: DataFrame) -> DataFrame:
    """Records that overlap any interval: a semi-join over bins with the merged intervals."""
    merged = I.merge_intervals(bed).select(F.col("chrom").alias("r_chrom"), F.col("start0").alias("r_start0"), F.col("end0").alias("r_end0"))
    return I.overlap_join(span(df.where("rname is not null")), merged, "semi").select(*df.columns)


def fetch_pairs(df: DataFrame, regions: list[str]) -> DataFrame:
    """All records of the templates of which one overlaps."""
    names = by_regions(df, regions).select("qname").distinct()
    return df.join(names, "qname", "left_semi").select(*df.columns)


def unmap(df: DataFrame, keep: Column) -> DataFrame:
    """Records that aren't kept stay, but unmapped: UNMAP set, MAPQ 0, no CIGAR, TLEN 0."""
    keep = F.coalesce(keep, F.lit(False))
    return df.withColumns({
        "flag": F.when(keep, F.col("flag")).otherwise(F.col("flag").bitwiseOR(FL.UNMAP)),
        "mapq": F.when(keep, F.col("mapq")).otherwise(0),
        "cigar": F.when(keep, F.col("cigar")),
        "tlen": F.when(keep, F.col("tlen")).otherwise(0),
    })


def remove_flags(df: DataFrame, mask: int) -> DataFrame:
    return df.withColumn("flag", F.col("flag").bitwiseAND(~mask))


def save_counts(df: DataFrame, keep: Column) -> DataFrame:
    """One row: processed, accepted, rejected."""
    n = F.count_if(F.coalesce(keep, F.lit(False)))
    return df.agg(F.count("*").alias("processed"), n.alias("accepted"), (F.count("*") - n).alias("rejected"))


def subsample(df: DataFrame, seed: int, fraction: float) -> DataFrame:
    """Whole templates: those whose names' hash with the seed, as a share of 2^64, is below the fraction."""
    if fraction >= 1:
        return df
    share = F.transform(F.array(fnv1a(F.col("qname"), seed)), lambda h: (h["hi"].cast("double") * 2.0**32 + h["lo"].cast("double")) / 2.0**64)[0]
    return df.where(share < fraction)


def cigar_metrics(df: DataFrame) -> DataFrame:
    """ordinal, src, ncigar, qlen, rlen, sclen, hclen, endpos."""
    o = df.withColumn("_ops", C.ops(F.col("cigar")))
    ops = F.col("_ops")
    return o.select(
        "ordinal", "src", F.size(ops).alias("ncigar"), C.query_length(ops).alias("qlen"), C.reference_length(ops).alias("rlen"),
        C.soft_clipped(ops).alias("sclen"), C.hard_clipped(ops).alias("hclen"), F.when(F.col("pos") > 0, F.col("pos") + C.reference_length(ops) - 1).alias("endpos"),
    )


# The keywords of the sanitizer and the groups they stand for.
SANITIZE = {"on": {"pos", "mqual", "unmap", "cigar", "aux"}, "all": {"pos", "mqual", "unmap", "cigar", "cigdup", "cigarx", "aux"}, "off": set()}


def sanitize(df: DataFrame, rules: str = "on", header_sq: DataFrame | None = None) -> DataFrame:
    """Repairs by keyword: pos (beyond the reference: unmapped), mqual (unmapped: MAPQ 0), unmap (unmapped: no
    alignment), cigar (unmapped: none), cigdup (adjoining operations joined), cigarx (= and X become M), aux (unmapped: no
    NM or MD)."""
    wanted: set[str] = set()
    for k in rules.split(","):
        wanted |= SANITIZE.get(k, {k})
    out = df
    if "pos" in wanted and header_sq is not None:
        sizes = F.broadcast(header_sq.select(F.col("name").alias("_name"), F.col("length").alias("_length")))
        beyond = F.coalesce(F.col("pos") > F.col("_length"), F.lit(False))
        out = out.join(sizes, F.col("rname") == F.col("_name"), "left").withColumn("flag", F.when(beyond, F.col("flag").bitwiseOR(FL.UNMAP)).otherwise(F.col("flag"))).select(*df.columns)
    unmapped = FL.bit(F.col("flag"), FL.UNMAP)
    if "mqual" in wanted:
        out = out.withColumn("mapq", F.when(unmapped, 0).otherwise(F.col("mapq")))
    if wanted & {"unmap", "cigar"}:
        out = out.withColumn("cigar", F.when(~unmapped, F.col("cigar")))
    if "unmap" in wanted:
        out = out.withColumn("flag", F.when(unmapped, F.col("flag").bitwiseAND(~(FL.PROPER | FL.SECONDARY | FL.SUPP))).otherwise(F.col("flag")))
    if "cigarx" in wanted:
        out = out.withColumn("cigar", F.translate("cigar", "=X", "MM"))
    if wanted & {"cigdup", "cigarx"}:
        out = out.withColumn("cigar", F.when(F.col("cigar").isNotNull(), C.format_ops(C.merge_adjacent(C.ops(F.col("cigar"))))))
    if "aux" in wanted:
        out = out.withColumn("tags", F.when(unmapped, F.map_filter("tags", lambda k, _: ~k.isin("NM", "MD"))).otherwise(F.col("tags")))
        out = out.withColumn("tag_order", F.when(unmapped, F.filter("tag_order", lambda k: ~k.isin("NM", "MD"))).otherwise(F.col("tag_order")))
    return out


def by_tags(df: DataFrame, wanted: dict[str, list[str] | None]) -> DataFrame:
    """Records that have every tag of `wanted`, each with one of its values if any are given."""
    for name, values in wanted.items():
        df = by_tag(df, name, values)
    return df


def validated(df: DataFrame, header_sq: DataFrame) -> DataFrame:
    """The same records; a malformed CIGAR, or a mapped record under a header without references, fails the job when it
    is read. The header is a small table and is asked once."""
    bad = ~F.col("cigar").rlike("^([0-9]+[MIDNSHP=X])+$")
    checks = [F.when(bad, F.raise_error(F.concat(F.lit("invalid CIGAR "), "cigar")).cast("boolean"))]
    if header_sq.isEmpty():
        mapped = F.col("rname").isNotNull() & ~FL.bit(F.col("flag"), FL.UNMAP)
        checks.append(F.when(mapped, F.raise_error(F.lit("no SQ lines present in the header")).cast("boolean")))
    return df.where(F.coalesce(*checks, F.lit(True)))
