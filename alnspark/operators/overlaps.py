"""Mates that overlap: qualities merged for pileups, bases and depths counted once a template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import cigar as C, flags as FL
from ..functions.hashes import x31
from . import depth as D, stats as S
from .filters import span

#: The highest merged quality, and what is left of a quality that the mate speaks against.
HIGHEST, AGAINST = 200, 0.8


def _end(pos: Column, cigar: Column) -> Column:
    return C.end_position(pos, C.ops(cigar))


def _pairable() -> Column:
    """Both ends placed on one reference, near enough to overlap."""
    placed = FL.bit(F.col("flag"), FL.PAIRED) & ~FL.bit(F.col("flag"), FL.UNMAP | FL.MUNMAP) & F.col("rname").isNotNull() & F.col("pos").isNotNull()
    apart = (F.abs("tlen") >= 2 * F.length("seq")) & (F.coalesce("pnext", F.lit(0)) > _end(F.col("pos"), F.col("cigar")))
    return F.coalesce(placed & (F.col("rname") == F.col("rnext")) & ~apart & F.col("seq").isNotNull() & F.col("qual").isNotNull() & F.col("cigar").isNotNull(), F.lit(False))


def _numbered(df: DataFrame) -> DataFrame:
    """Records with _pair: the first and second record of a name on a reference are pair 0, and so on, by place."""
    along = Window.partitionBy("rname", "qname").orderBy("pos", "src", "ordinal")
    return df.withColumn("_pair", F.floor((F.row_number().over(along) - 1) / 2))


def _aligned(pos: int, cigar: str) -> tuple:
    """Places on the reference and in the read of the aligned bases."""
    import re

    import numpy as np

    ref, query, at, q = [], [], int(pos), 0
    for n, op in ((int(n), op) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar)):
        if op in "M=X":
            ref.append(np.arange(at, at + n))
            query.append(np.arange(q, q + n))
        at += n if op in "MDN=X" else 0
        q += n if op in "MIS=X" else 0
    return (np.concatenate(ref), np.concatenate(query)) if ref else (np.zeros(0, int), np.zeros(0, int))


def merged(one: tuple, two: tuple, keeps_first: bool) -> tuple[str, str]:
    """The qualities of two records (pos, cigar, seq, qual) after they are merged: where both have a base, one of them gets the sum
    if they agree, the better one most of its own if not, the other one 0. keeps_first: who gets it among equals."""
    import numpy as np

    (r1, q1), (r2, q2) = _aligned(*one[:2]), _aligned(*two[:2])
    _, i, j = np.intersect1d(r1, r2, assume_unique=True, return_indices=True)
    i, j = q1[i], q2[j]
    s1, s2 = (np.frombuffer(x[2].upper().encode(), np.uint8) for x in (one, two))
    a, b = (np.frombuffer(x[3].encode(), np.uint8).astype(int) - 33 for x in (one, two))
    x, y = a[i], b[j]
    same, first = s1[i] == s2[j], (x > y) | ((x == y) & keeps_first)
    total, most = np.minimum(x + y, HIGHEST), (AGAINST * np.maximum(x, y)).astype(int)
    take_first = np.where(same, keeps_first, first)
    value = np.where(same, total, most)
    a[i], b[j] = np.where(take_first, value, 0), np.where(take_first, 0, value)
    text = lambda v: "".join(map(chr, np.minimum(v, HIGHEST) + 33))
    return text(a), text(b)


def merge_mates(df: DataFrame) -> DataFrame:
    """reads whose mates overlap with merged qualities, all others as they are. Only records that may overlap are shuffled."""
    x = df.withColumn("_may", _pairable())
    rest, near = x.where(~F.col("_may")).drop("_may"), _numbered(x.where("_may").drop("_may"))
    key, record = F.struct("pos", "src", "ordinal"), F.struct(*df.columns)
    both = near.groupBy("rname", "qname", "_pair").agg(F.min_by(record, key).alias("_1"), F.max_by(record, key).alias("_2"), F.count("*").alias("_n"))

    @F.pandas_udf("a string, b string")
    def merge(p1, c1, s1, q1, p2, c2, s2, q2, first):
        import pandas as pd

        return pd.DataFrame([merged((a, b, c, d), (e, f, g, h), k) for a, b, c, d, e, f, g, h, k in zip(p1, c1, s1, q1, p2, c2, s2, q2, first)], columns=["a", "b"])

    parts = [F.col(f"_{k}.{c}") for k in (1, 2) for c in ("pos", "cigar", "seq", "qual")]
    told = both.where("_n = 2").withColumn("_q", merge(*parts, x31(F.col("qname")).bitwiseAND(1) == 1))
    changed = told.select(F.explode(F.array(F.col("_1").withField("qual", F.col("_q.a")), F.col("_2").withField("qual", F.col("_q.b")))).alias("r")).select("r.*")
    return rest.unionByName(changed).unionByName(both.where("_n = 1").select("_1.*"))


def without_orphans(df: DataFrame) -> DataFrame:
    """reads but for paired ones whose pair isn't a proper one."""
    return df.where(~FL.bit(F.col("flag"), FL.PAIRED) | FL.bit(F.col("flag"), FL.PROPER))


def _overlaps(df: DataFrame) -> DataFrame:
    """chrom, start0, end0: what aligned blocks of a template's first and second reads have in common on a reference."""
    flag = F.col("flag")
    near = ~FL.bit(flag, FL.UNMAP | FL.MUNMAP) & FL.bit(flag, FL.PAIRED) & (F.abs("tlen") < 2 * F.length("seq")) & (S.order(flag) > 0)
    kept = S.primary(df).where(near & F.col("rname").isNotNull() & F.col("pos").isNotNull())
    blocks = F.filter(C.blocks(F.col("pos"), C.ops(F.col("cigar"))), lambda b: b["op"].isin("M", "=", "X"))
    ends = F.transform(blocks, lambda b: F.struct(b["ref0"].alias("s"), (b["ref0"] + b["len"]).alias("e")))
    x = kept.select("rname", "qname", S.order(flag).alias("_o"), ends.alias("_b"))
    side = lambda k: F.flatten(F.collect_list(F.when(F.col("_o") == k, F.col("_b")))).alias(f"_{k}")
    both = x.groupBy("rname", "qname").agg(side(1), side(2)).where((F.size("_1") > 0) & (F.size("_2") > 0))
    each = both.select(F.col("rname").alias("chrom"), F.explode("_1").alias("a"), "_2").select("chrom", "a", F.explode("_2").alias("b"))
    return each.select("chrom", F.greatest("a.s", "b.s").alias("start0"), F.least("a.e", "b.e").alias("end0")).where("end0 > start0")


def bases_once(df: DataFrame) -> DataFrame:
    """bases, overlap, once: the mapped bases by CIGAR of primary records, those that mates have in common, and the difference."""
    mapped = S.primary(df).where(~FL.bit(F.col("flag"), FL.UNMAP))
    n = mapped.agg(F.coalesce(F.sum(C.total(C.ops(F.col("cigar")), "MI=X")), F.lit(0)).alias("bases"))
    o = _overlaps(df).agg(F.coalesce(F.sum(F.col("end0") - F.col("start0")), F.lit(0)).alias("overlap"))
    return n.join(o).select("bases", "overlap", (F.col("bases") - F.col("overlap")).alias("once"))  # one row each


def coverage_once(df: DataFrame) -> DataFrame:
    """depth, positions: how many positions have each depth above 0, where mates that overlap count once."""
    mapped = S.primary(df).where(~FL.bit(F.col("flag"), FL.UNMAP))
    add = D.block_rows(mapped).select("chrom", "start0", "end0", F.lit(1).alias("w"))
    runs = D._sweep(add.unionByName(_overlaps(df).withColumn("w", F.lit(-1))), {"depth": F.col("w")})
    return runs.where("depth > 0").groupBy("depth").agg(F.sum(F.col("end0") - F.col("start0")).alias("positions"))


def template_depth(df: DataFrame, exclude: int = FL.UNMAP | FL.SECONDARY | FL.QCFAIL | FL.DUP | FL.SUPP) -> DataFrame:
    """chrom, start0, end0, depth: runs of depth over whole spans (deletions and skips too), as amplicon statistics have it. The second
    record of a paired template, in the order of the input, counts from the first one's end on only."""
    x = span(df.where(FL.flag_filter(F.col("flag"), exclude=exclude)).where("rname is not null and pos is not null")).select("chrom", "start0", "end0", "flag", "qname", "src", "ordinal")
    paired = FL.bit(F.col("flag"), FL.PAIRED) & ~FL.bit(F.col("flag"), FL.SECONDARY | FL.SUPP)
    along = Window.partitionBy("chrom", "qname").orderBy("src", "ordinal")
    both = x.where(paired).withColumn("_k", F.row_number().over(along)).withColumn("_end", F.lag("end0").over(along))
    first = F.when(F.col("_k") % 2 == 0, F.greatest("start0", "_end")).otherwise(F.col("start0"))
    blocks = both.select("chrom", first.alias("start0"), "end0").unionByName(x.where(~paired).select("chrom", "start0", "end0"))
    return D._sweep(blocks, {"depth": F.lit(1)}).where("depth > 0")
