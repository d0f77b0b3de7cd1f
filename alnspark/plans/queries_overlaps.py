"""Queries over templates whose mates overlap."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import overlaps as O, pileup as P
from .derive import close_reads, reference
from .registry import register

_CLOSE = """WITH close AS (SELECT * REPLACE (concat('chr', o % 5 + 1) AS rname, concat('chr', o % 5 + 1) AS rnext, '10M' AS cigar, (o * 37) % 1900 + (ordinal % 7) + 1 AS pos, (o * 37) % 1900 + 4 AS pnext, ordinal % 15 AS tlen)
  FROM (SELECT *, CAST(substr(qname, 2) AS BIGINT) AS o FROM reads) WHERE o % 3 < 2 AND flag & 2304 = 0)"""
#: First and second records of a name by place; the merged quality of each base that both have.
_MERGED = f"""{_CLOSE}, usable AS (SELECT * FROM close WHERE flag & 1796 = 0 AND (flag & 1 = 0 OR flag & 2 <> 0)),
  pairs AS (SELECT src, ordinal, row_number() OVER w AS k FROM usable WHERE flag & 1 <> 0 AND flag & 8 = 0 AND qual IS NOT NULL WINDOW w AS (PARTITION BY rname, qname ORDER BY pos, src, ordinal)),
  based AS (SELECT u.*, k, pos + j AS p, substr(seq, j::INT + 1, 1) AS base, CASE WHEN qual IS NULL THEN 255 ELSE ascii(substr(qual, j::INT + 1, 1)) - 33 END AS q FROM (SELECT *, unnest(range(0, 10)) AS j FROM usable) u LEFT JOIN pairs USING (src, ordinal)),
  told AS (SELECT a.*, b.base AS mate_base, b.q AS mate_q, a.k % 2 = 1 AS is_first,
      list_reduce(list_prepend(0::BIGINT, list_transform(string_split(a.qname, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) & 4294967295) & 1 = 1 AS keeps_first
    FROM based a LEFT JOIN based b ON a.rname = b.rname AND a.qname = b.qname AND a.p = b.p AND (a.k - 1) // 2 = (b.k - 1) // 2 AND a.k <> b.k),
  final AS (SELECT *, CASE WHEN mate_q IS NULL THEN q WHEN base = mate_base THEN CASE WHEN is_first = keeps_first THEN least(q + mate_q, 200) ELSE 0 END
      WHEN q > mate_q OR (q = mate_q AND is_first = keeps_first) THEN trunc(0.8 * q)::BIGINT ELSE 0 END AS nq FROM told)"""
register("mpileup_merged_mates", lambda s, d: P.mpileup(close_reads(s, d), reference(s), mates=True, orphans=False).select("chrom", "pos", "depth", "quals"),
    f"""{_MERGED} SELECT rname AS chrom, p AS pos, count(*) AS depth, string_agg(chr(least(nq, 93)::INT + 33), '' ORDER BY src, ordinal) AS quals FROM final WHERE nq >= 13 GROUP BY 1, 2""", "reads")
_BOTH = f"""{_CLOSE}, sides AS (SELECT rname, qname, pos - 1 AS s, pos + 9 AS e, CASE WHEN flag & 192 = 64 THEN 1 WHEN flag & 192 = 128 THEN 2 END AS o FROM close WHERE flag & 13 = 1 AND tlen < 20),
  common AS (SELECT a.rname, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e FROM sides a JOIN sides b ON a.rname = b.rname AND a.qname = b.qname AND a.o = 1 AND b.o = 2 WHERE greatest(a.s, b.s) < least(a.e, b.e))"""
register("stats_bases_once", lambda s, d: O.bases_once(close_reads(s, d)),
    f"""{_BOTH} SELECT bases, overlap, bases - overlap AS once FROM (SELECT coalesce(sum(10), 0)::BIGINT AS bases FROM close WHERE flag & 4 = 0), (SELECT coalesce(sum(e - s), 0)::BIGINT AS overlap FROM common)""", "reads")
register("stats_coverage_once", lambda s, d: O.coverage_once(close_reads(s, d)),
    f"""{_BOTH}, per AS (SELECT rname, p, sum(w) AS depth FROM (SELECT rname, unnest(range(pos - 1, pos + 9)) AS p, 1 AS w FROM close WHERE flag & 4 = 0 UNION ALL SELECT rname, unnest(range(s, e)), -1 FROM common) GROUP BY 1, 2)
    SELECT depth::BIGINT AS depth, count(*) AS positions FROM per WHERE depth > 0 GROUP BY 1""", "reads")  # fmt: skip
register("amplicon_template_depth", lambda s, d: O.template_depth(close_reads(s, d)).select("chrom", F.explode(F.sequence(F.col("start0") + 1, F.col("end0"))).alias("pos"), F.col("depth").cast("bigint").alias("depth")),
    f"""{_CLOSE}, x AS (SELECT *, pos - 1 AS s, pos + 9 AS e, flag & 1 <> 0 AS paired, row_number() OVER w AS k, lag(pos + 9) OVER w AS before FROM close WHERE flag & 3844 = 0 WINDOW w AS (PARTITION BY rname, qname, flag & 1 ORDER BY src, ordinal))
    SELECT rname AS chrom, p + 1 AS pos, count(*) AS depth FROM (SELECT rname, unnest(range(CASE WHEN paired AND k % 2 = 0 THEN greatest(s, before) ELSE s END, e)) AS p FROM x) GROUP BY 1, 2""", "reads")  # fmt: skip
