"""Queries that write files of reads and read them again."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sources
from ..operators import regions as R, sorts
from ..sources.scratch import folder
from .derive import header_rg, reads, spread_reads, wide_header_sq
from .registry import register

_PLACES = ["chr1:3,000,001-3,400,000", "chr3:149,000,000", "chr5:16,380-700,000", "chr6"]
_WHERE = """(rname = 'chr1' AND end0 > 3000000 AND start0 < 3400000) OR (rname = 'chr3' AND end0 > 148999999) OR (rname = 'chr5' AND end0 > 16379 AND start0 < 700000) OR rname = 'chr6'"""
_SPREAD = f"""WITH x AS (SELECT * REPLACE ((ordinal % 1000000007 * 7919) % 150000000 + 1 AS pos, CASE WHEN ordinal % 50 = 0 THEN '4M20000N6M' ELSE '10M' END AS cigar) FROM reads WHERE rname IS NOT NULL),
  y AS (SELECT *, pos - 1 AS start0, pos - 1 + CASE WHEN cigar = '10M' THEN 10 ELSE 20010 END AS end0 FROM x)
  SELECT qname, flag, rname, pos, mapq, cigar, rnext, pnext, tlen, seq, qual, rg, bc, ms, nm FROM y"""


def _sorted_file(s, d):
    path = folder(s, "sorted")
    sources.register(s)
    R.write_sorted(spread_reads(s, d), path, wide_header_sq(s, d), header_rg(s, d))
    return path


def _flat(df):
    tag = lambda t: F.try_element_at("tags", F.lit(t))["v"]
    return df.select("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual", tag("RG").alias("rg"), tag("BC").alias("bc"), tag("ms").cast("bigint").alias("ms"), tag("NM").cast("bigint").alias("nm"))


def _in_order(df):
    """The place of each record of its reference in the file, and by its offset."""
    x = df.select("qname", "flag", "rname", "pos", "src", "ordinal", F.monotonically_increasing_id().alias("file_order"))
    x = sorts.rank_within(x, ["rname"], [F.col("file_order")], "place")
    return sorts.rank_within(x, ["rname"], [F.col("src"), F.col("ordinal")], "offset_place", keep=["qname", "flag", "rname", "pos", "place"])


register("write_bam", lambda s, d: _flat(s.read.format("bam").load(_sorted_file(s, d))), _SPREAD, "reads")
register("view_regions_indexed", lambda s, d: _flat(R.read_regions(s, _sorted_file(s, d), _PLACES)), f"{_SPREAD} WHERE {_WHERE}", "reads")
register(
    "sort_written_order",
    lambda s, d: _in_order(s.read.format("bam").load(_sorted_file(s, d))),
    """WITH x AS (SELECT *, (ordinal % 1000000007 * 7919) % 150000000 + 1 AS place0 FROM reads WHERE rname IS NOT NULL),
      y AS (SELECT qname, flag, rname, place0 AS pos, (row_number() OVER (PARTITION BY rname ORDER BY place0, flag & 16, src, ordinal))::INT AS place FROM x) SELECT *, place AS offset_place FROM y""", "reads",
)
