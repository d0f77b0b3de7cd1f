"""Queries for the statistics report, checksums, amplicons and pileups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tags as T
from ..operators import amplicon as A, checksum as K, pileup as P, stats as S
from .derive import PRIMERS_SQL, bed, header_sq, primers, reads, reference
from .registry import CTES, register

CTES["primers"] = PRIMERS_SQL
CTES["frag"] = "SELECT *, CASE WHEN flag & 1 = 0 OR flag & 192 = 64 THEN 1 WHEN flag & 192 = 128 THEN 2 ELSE 0 END AS fragment FROM reads WHERE flag & 2304 = 0"
CTES["pairs"] = """SELECT *, least(abs(tlen), 8000) AS size, CASE WHEN (flag & 16 = 0) = (flag & 32 = 0) THEN 2 WHEN ahead = 0 THEN 0 WHEN (ahead > 0) = ((flag & 64 <> 0) = (flag & 16 = 0)) THEN 0 ELSE 1 END AS way
  FROM (SELECT *, CASE WHEN flag & 64 <> 0 THEN 1 ELSE -1 END * (coalesce(pnext, 0) - coalesce(pos, 0)) AS ahead FROM reads WHERE flag & 2304 = 0 AND flag & 1 <> 0 AND flag & 12 = 0 AND (abs(tlen) > 0 OR tid = mtid))"""
CTES["isz"] = "SELECT size, count(*) FILTER (way = 0) // 2 AS inward, count(*) FILTER (way = 1) // 2 AS outward, count(*) FILTER (way = 2) // 2 AS other FROM pairs GROUP BY 1"
CTES["bulk"] = """SELECT size, pairs, inward, outward, other FROM (SELECT *, inward + outward + other AS pairs, sum(inward + outward + other) OVER (ORDER BY size) AS s, sum(inward + outward + other) OVER () AS n FROM isz)
  WHERE pairs > 0 AND (s - pairs) / n <= 0.99"""
CTES["cycle"] = """SELECT fragment, c + 1 AS cycle, substr(CASE WHEN flag & 16 <> 0 THEN reverse(seq) ELSE seq END, CAST(c + 1 AS INT), 1) AS base, ascii(substr(CASE WHEN flag & 16 <> 0 THEN reverse(qual) ELSE qual END, CAST(c + 1 AS INT), 1)) - 33 AS q
  FROM (SELECT *, unnest(range(0, length(seq))) AS c FROM frag WHERE fragment > 0)"""
CTES["indel"] = """SELECT fragment, op, len, CASE WHEN flag & 16 = 0 THEN query0 - CASE WHEN op = 'D' THEN 1 ELSE 0 END ELSE length(seq) - query0 - CASE WHEN op = 'I' THEN len ELSE 1 END END AS ix
  FROM (SELECT *, CASE WHEN flag & 1 = 0 OR flag & 192 = 64 THEN 1 WHEN flag & 192 = 128 THEN 2 ELSE 0 END AS fragment FROM blocks) WHERE op IN ('I', 'D') AND flag & 2308 = 0"""
CTES["amps"] = """SELECT chrom, amplicon, list_sort(list(end0) FILTER (strand = '+')) AS lefts, list_sort(list(start0) FILTER (strand = '-')) AS rights, max(end0) FILTER (strand = '+') + 1 AS max_left, min(end0) FILTER (strand = '+') + 1 AS min_left,
  min(start0) FILTER (strand = '-') - 1 AS min_right, max(start0) FILTER (strand = '-') - 1 AS max_right
  FROM (SELECT *, count(*) FILTER (strand = '+' AND coalesce(l, '-') = '-') OVER (PARTITION BY chrom ORDER BY start0, end0)::INT AS amplicon FROM (SELECT *, lag(strand) OVER (PARTITION BY chrom ORDER BY start0, end0) AS l FROM primers)) GROUP BY 1, 2"""
CTES["amp_reads"] = """SELECT s.ordinal, s.src, s.rname AS chrom, s.start0, s.end0, max(a.amplicon) FILTER (abs(s.start0 + 1 - a.l) <= 30) AS a1, max(b.amplicon) FILTER (abs(s.end0 - b.r) <= 30) AS a2
  FROM (SELECT * FROM span WHERE flag & 3844 = 0 AND rname IS NOT NULL) s LEFT JOIN (SELECT chrom, amplicon, unnest(lefts) AS l FROM amps) a ON a.chrom = s.rname AND abs(s.start0 + 1 - a.l) <= 30
  LEFT JOIN (SELECT chrom, amplicon, unnest(rights) AS r FROM amps) b ON b.chrom = s.rname AND abs(s.end0 - b.r) <= 30 GROUP BY ALL"""
from .registry import _NEEDS  # noqa: E402

_NEEDS |= {"frag": ["reads"], "pairs": ["reads"], "isz": ["pairs"], "bulk": ["isz"], "cycle": ["frag"], "indel": ["blocks"], "amps": ["primers"], "amp_reads": ["span", "amps"]}

_SUMS = {
    "raw total sequences": "count(*) FILTER (prime)", "filtered sequences": "0", "sequences": "count(*) FILTER (prime)", "1st fragments": "count(*) FILTER (prime AND fr = 1)", "last fragments": "count(*) FILTER (prime AND fr = 2)",
    "reads mapped": "count(*) FILTER (prime AND flag & 4 = 0)", "reads mapped and paired": "count(*) FILTER (both_)", "reads unmapped": "count(*) FILTER (prime AND flag & 4 <> 0)", "reads properly paired": "count(*) FILTER (prime AND flag & 3 = 3)",
    "reads paired": "count(*) FILTER (prime AND flag & 1 <> 0)", "reads duplicated": "count(*) FILTER (prime AND flag & 1024 <> 0)", "reads MQ0": "count(*) FILTER (prime AND flag & 4 = 0 AND mapq = 0)", "reads QC failed": "count(*) FILTER (prime AND flag & 512 <> 0)",
    "non-primary alignments": "count(*) FILTER (flag & 256 <> 0)", "supplementary alignments": "count(*) FILTER (flag & 256 = 0 AND flag & 2048 <> 0)", "total length": "sum(length(seq)) FILTER (prime)", "total first fragment length": "sum(length(seq)) FILTER (prime AND fr = 1)",
    "total last fragment length": "sum(length(seq)) FILTER (prime AND fr = 2)", "bases mapped": "sum(length(seq)) FILTER (prime AND flag & 4 = 0)", "bases mapped (cigar)": "sum(mlen) FILTER (prime AND flag & 4 = 0)", "bases duplicated": "sum(length(seq)) FILTER (prime AND flag & 1024 <> 0)",
    "mismatches": "sum(nm) FILTER (prime AND flag & 4 = 0)", "maximum length": "max(length(seq)) FILTER (prime)", "inward oriented pairs": "(SELECT count(*) // 2 FROM pairs WHERE way = 0)", "outward oriented pairs": "(SELECT count(*) // 2 FROM pairs WHERE way = 1)",
    "pairs with other orientation": "(SELECT count(*) // 2 FROM pairs WHERE way = 2)", "pairs on different chromosomes": "count(*) FILTER (both_ AND tid <> mtid) // 2",
    "error rate": "round(sum(nm) FILTER (prime AND flag & 4 = 0) / sum(mlen) FILTER (prime AND flag & 4 = 0), 6)", "average length": "round(sum(length(seq)) FILTER (prime) / count(*) FILTER (prime))",
    "average quality": "round((SELECT sum(q) FROM (SELECT unnest(list_transform(string_split(qual, ''), lambda c: ascii(c) - 33)) AS q FROM frag WHERE qual IS NOT NULL)) / sum(length(seq)) FILTER (prime), 6)",
}
register("stats_summary", lambda s, d: S.summary(reads(s, d)),
    "WITH z AS (SELECT *, flag & 2304 = 0 AS prime, flag & 2304 = 0 AND flag & 1 <> 0 AND flag & 12 = 0 AS both_, CASE WHEN flag & 1 = 0 OR flag & 192 = 64 THEN 1 WHEN flag & 192 = 128 THEN 2 ELSE 0 END AS fr FROM span), a AS (SELECT "
    + ", ".join(f"CAST({v} AS DOUBLE) AS m{k}" for k, v in enumerate(_SUMS.values())) + " FROM z) SELECT x.k AS metric, x.v AS value FROM (SELECT unnest([" + ", ".join(f"{{'k': '{name}', 'v': m{k}}}" for k, name in enumerate(_SUMS)) + "]) AS x FROM a)", "span", "pairs", "frag")
register("stats_insert_sizes", lambda s, d: S.insert_sizes(reads(s, d)), "SELECT size, pairs, inward, outward, other FROM bulk", "bulk")
register("stats_insert_size_summary", lambda s, d: S.insert_size_summary(reads(s, d)),
    "SELECT round(m, 4) AS mean, round(sqrt(greatest(q - m * m, 0)), 4) AS sd FROM (SELECT sum(size * pairs) / sum(pairs) AS m, sum(size * size * pairs) / sum(pairs) AS q FROM bulk)", "bulk")
register("stats_quality_by_cycle", lambda s, d: S.quality_by_cycle(reads(s, d)), "SELECT fragment, cycle::INT AS cycle, q::INT AS quality, count(*) AS n FROM cycle WHERE q IS NOT NULL GROUP BY 1, 2, 3", "cycle")
register("stats_bases_by_cycle", lambda s, d: S.bases_by_cycle(reads(s, d)),
    "SELECT fragment, cycle::INT AS cycle, " + ", ".join(f"count(*) FILTER (base = '{b.upper()}') AS {b}" for b in "acgtn") + ", count(*) FILTER (base NOT IN ('A','C','G','T','N')) AS other FROM cycle GROUP BY 1, 2", "cycle")
register("stats_read_bases_by_cycle", lambda s, d: S.bases_by_cycle(reads(s, d), read_strand=True).drop("other"),
    "SELECT fragment, cycle::INT AS cycle, " + ", ".join(f"count(*) FILTER (base = '{b.upper()}') AS {b}" for b in "acgtn") + " FROM (SELECT fragment, cycle, CASE WHEN rev THEN translate(base, 'ACGT', 'TGCA') ELSE base END AS base FROM (SELECT fragment, c + 1 AS cycle, flag & 16 <> 0 AS rev, substr(CASE WHEN flag & 16 <> 0 THEN reverse(seq) ELSE seq END, CAST(c + 1 AS INT), 1) AS base FROM (SELECT *, unnest(range(0, length(seq))) AS c FROM frag WHERE fragment > 0))) GROUP BY 1, 2", "frag")
register("stats_gc_content", lambda s, d: S.gc_content(reads(s, d)),
    """WITH g AS (SELECT fragment, length(seq) - length(translate(seq, 'GC', '')) AS gc, length(seq) AS l FROM frag WHERE fragment > 0)
    SELECT fragment, bin::INT AS bin, count(*) AS n FROM (SELECT fragment, unnest(range(gc * 199 // l, least((gc + 1) * 199 // l, 199))) AS bin FROM g) GROUP BY 1, 2""", "frag")  # fmt: skip
register("stats_read_lengths", lambda s, d: S.read_lengths(reads(s, d)),
    "SELECT fragment, length(seq) + coalesce(h, 0)::BIGINT AS length, count(*) AS n FROM frag LEFT JOIN (SELECT ordinal, src, sum(len) AS h FROM ops WHERE op = 'H' GROUP BY 1, 2) USING (ordinal, src) GROUP BY 1, 2", "frag", "ops")
register("stats_mapping_qualities", lambda s, d: S.mapping_qualities(reads(s, d)), "SELECT coalesce(mapq, 255) AS mapq, count(*) AS n FROM reads WHERE flag & 3844 = 0 GROUP BY 1", "reads")
register("stats_indel_lengths", lambda s, d: S.indel_lengths(reads(s, d)), "SELECT len::INT AS length, count(*) FILTER (op = 'I') AS insertions, count(*) FILTER (op = 'D') AS deletions FROM indel WHERE op = 'I' OR ix >= 0 GROUP BY 1", "indel")
register("stats_indels_by_cycle", lambda s, d: S.indels_by_cycle(reads(s, d)), "SELECT fragment, (ix + 1)::INT AS cycle, count(*) FILTER (op = 'I') AS insertions, count(*) FILTER (op = 'D') AS deletions FROM indel WHERE fragment > 0 AND ix >= 0 GROUP BY 1, 2", "indel")
register("stats_coverage_histogram", lambda s, d: S.coverage_histogram(reads(s, d)),
    """SELECT least(n, 1000)::INT AS lo, least(n, 1000)::INT AS hi, count(*) AS positions FROM (SELECT rname, p, count(*) AS n FROM (SELECT rname, unnest(range(ref0, ref0 + len)) AS p FROM blocks WHERE op = 'M' AND rname IS NOT NULL AND flag & 2308 = 0) GROUP BY 1, 2) GROUP BY 1, 2""", "blocks")  # fmt: skip
register("stats_mismatches_by_cycle", lambda s, d: S.mismatches_by_cycle(reads(s, d), reference(s)),
    """WITH m AS (SELECT b.*, query0 + k AS qp, substr(b.seq, CAST(query0 + k + 1 AS INT), 1) AS x, substr(ref.seq, CAST(ref0 + k + 1 AS INT), 1) AS y FROM (SELECT *, unnest(range(0, len)) AS k FROM blocks WHERE op = 'M' AND rname IS NOT NULL AND flag & 2308 = 0) b JOIN ref ON ref.name = b.rname)
    SELECT (CASE WHEN flag & 16 <> 0 THEN length(seq) - qp ELSE qp + 1 END)::INT AS cycle, (CASE WHEN x = 'N' THEN 0 WHEN qual IS NULL THEN 256 ELSE ascii(substr(qual, CAST(qp + 1 AS INT), 1)) - 32 END)::INT AS quality, count(*) AS n FROM m WHERE x = 'N' OR x <> y GROUP BY 1, 2""", "blocks", "ref")  # fmt: skip
register("stats_checksums", lambda s, d: S.checksums(reads(s, d)))
register("stats_gc_depth", lambda s, d: S.gc_depth(reads(s, d)))
register("stats_by_group", lambda s, d: reads(s, d).groupBy(T.value("RG").alias("rg")).agg(F.count("*").alias("records"), F.count_if(F.col("flag").bitwiseAND(4) == 0).alias("mapped")), "SELECT rg, count(*) AS records, count(*) FILTER (flag & 4 = 0) AS mapped FROM reads GROUP BY 1", "reads")
register("checksum", lambda s, d: K.checksum(reads(s, d)))
register("checksum_counts", lambda s, d: K.checksum(reads(s, d)).select("scope", "group", "n"), "WITH k AS (SELECT * FROM reads WHERE flag & 2304 = 0) SELECT 'group' AS scope, rg AS \"group\", count(*) AS n FROM k GROUP BY 2 UNION ALL SELECT 'all', NULL, count(*) FROM k UNION ALL SELECT CASE WHEN flag & 512 <> 0 THEN 'fail' ELSE 'pass' END, NULL, count(*) FROM k GROUP BY 1", "reads")
register("checksum_combined", lambda s, d: K.combined(K.checksum(reads(s, d))))
register("checksum_merge", lambda s, d: K.merge_checksums(K.checksum(reads(s, d).where("src = 0")).union(K.checksum(reads(s, d).where("src = 1")))))

register("amplicons", lambda s, d: A.amplicons(primers(s, d)).drop("lefts", "rights"), "SELECT chrom, amplicon, max_left, min_left, min_right, max_right FROM amps", "amps")
register("amplicon_reads", lambda s, d: A.amplicon_reads(reads(s, d), A.amplicons(primers(s, d))),
    "SELECT a.chrom, a.amplicon, count(r.ordinal) AS reads FROM amps a LEFT JOIN amp_reads r ON r.chrom = a.chrom AND coalesce(r.a1, r.a2) = a.amplicon GROUP BY 1, 2", "amp_reads")
register("amplicon_coverage", lambda s, d: A.amplicon_coverage(reads(s, d), A.amplicons(primers(s, d)), min_depth=5),
    """SELECT a.chrom, a.amplicon, round(coalesce(sum(x.depth), 0) / any_value(min_right - max_left + 1), 6) AS depth, round(100 * count(*) FILTER (x.depth >= 5) / any_value(min_right - max_left + 1), 6) AS covered
    FROM amps a LEFT JOIN depth x ON x.chrom = a.chrom AND x.pos >= a.max_left AND x.pos <= a.min_right GROUP BY 1, 2""", "amps", "depth")  # fmt: skip
register("amplicon_template_coordinates", lambda s, d: A.template_coordinates(reads(s, d), A.amplicons(primers(s, d)), 10), "SELECT chrom, start0 // 10 * 10 AS start0, end0 // 10 * 10 AS end0, count(*) AS n FROM amp_reads GROUP BY 1, 2, 3", "amp_reads")
register("primer_clips", lambda s, d: A.primer_clips(reads(s, d), primers(s, d)).drop("src"),
    """SELECT s.ordinal, coalesce(max(end0_p - s.start0) FILTER (strand = '+' AND s.start0 >= greatest(start0_p - 5, 0) AND s.start0 < end0_p), 0) AS "left", coalesce(max(s.end0 - start0_p) FILTER (strand = '-' AND s.end0 > start0_p AND s.end0 <= end0_p + 5), 0) AS "right"
    FROM (SELECT * FROM span WHERE flag & 4 = 0 AND rname IS NOT NULL) s LEFT JOIN (SELECT chrom, start0 AS start0_p, end0 AS end0_p, strand FROM primers) p ON p.chrom = s.rname GROUP BY s.ordinal, s.src""", "span", "primers")  # fmt: skip
register("primer_clip_counts", lambda s, d: A.clip_counts(reads(s, d), primers(s, d)),
    """WITH w AS (SELECT s.ordinal, s.src, s.flag, coalesce(max(CASE WHEN strand = '+' AND s.start0 >= greatest(p.s - 5, 0) AND s.start0 < p.e THEN p.e - s.start0 END), 0) AS l, coalesce(max(CASE WHEN strand = '-' AND s.end0 > p.s AND s.end0 <= p.e + 5 THEN s.end0 - p.s END), 0) AS r
      FROM span s JOIN (SELECT chrom, start0 AS s, end0 AS e, strand FROM primers) p ON p.chrom = s.rname WHERE flag & 516 = 0 GROUP BY 1, 2, 3)
    SELECT (SELECT count(*) FROM reads) AS total, (SELECT count(*) FROM reads) - count(*) AS excluded, count(*) FILTER (flag & 16 = 0 AND l > 0) AS forward, count(*) FILTER (flag & 16 <> 0 AND r > 0) AS reverse, 0::BIGINT AS both,
      count(*) FILTER (NOT (flag & 16 = 0 AND l > 0) AND NOT (flag & 16 <> 0 AND r > 0)) AS not_clipped FROM w""", "span", "primers")  # fmt: skip
register("checksum_in_order", lambda s, d: K.checksum(reads(s, d), in_order=2))
register("checksum_all_fields", lambda s, d: K.checksum(reads(s, d), position=True, cigar=True, mate=True))
register("primer_clip", lambda s, d: A.clip(reads(s, d), primers(s, d)).select("ordinal", "flag", "pos", "cigar"))

register("pileup_bases", lambda s, d: P.bases(reads(s, d)).where("base not in ('*', '>')").groupBy("chrom", "pos", "base").agg(F.count("*").alias("n"), F.sum("q").cast("bigint").alias("quality")),
    "SELECT rname AS chrom, p + 1 AS pos, base, count(*) AS n, CAST(sum(q) AS BIGINT) AS quality FROM base WHERE q >= 13 GROUP BY 1, 2, 3", "base")
CTES["placed"] = """SELECT b.*, ref0 + k AS p, upper(substr(ref.seq, CAST(ref0 + k + 1 AS INT), 1)) AS r, CASE op WHEN 'M' THEN substr(b.seq, CAST(query0 + k + 1 AS INT), 1) WHEN 'D' THEN '*' ELSE '>' END AS base,
    CASE WHEN qual IS NULL THEN 255 ELSE ascii(substr(qual, CAST(query0 + CASE WHEN op = 'M' THEN k ELSE 0 END + 1 AS INT), 1)) - 33 END AS q, CASE WHEN k = len - 1 THEN following END AS nop, ref.seq AS refseq
  FROM (SELECT *, unnest(range(0, len)) AS k FROM (SELECT *, lead(op) OVER v AS following, lead(len) OVER v AS nlen, lead(query0) OVER v AS nquery FROM blocks WINDOW v AS (PARTITION BY ordinal, src ORDER BY i))
    WHERE op IN ('M', 'D', 'N') AND rname IS NOT NULL AND flag & 1796 = 0) b JOIN ref ON ref.name = b.rname"""
CTES["entry"] = """SELECT rname AS chrom, p + 1 AS pos, r AS ref, src, ordinal, chr(least(q, 93) + 33) AS qc,
    CASE WHEN p + 1 = pos THEN concat('^', chr(least(coalesce(mapq, 0), 93) + 33)) ELSE '' END
    || CASE WHEN base = '*' THEN '*' WHEN base = '>' THEN CASE WHEN flag & 16 <> 0 THEN '<' ELSE '>' END WHEN base = r THEN CASE WHEN flag & 16 <> 0 THEN ',' ELSE '.' END WHEN flag & 16 <> 0 THEN lower(base) ELSE base END
    || CASE WHEN nop = 'I' THEN concat('+', nlen, CASE WHEN flag & 16 <> 0 THEN lower(substr(seq, CAST(nquery + 1 AS INT), nlen)) ELSE substr(seq, CAST(nquery + 1 AS INT), nlen) END) ELSE '' END
    || CASE WHEN nop = 'D' AND op = 'M' THEN concat('-', nlen, CASE WHEN flag & 16 <> 0 THEN lower(substr(refseq, CAST(p + 2 AS INT), nlen)) ELSE substr(refseq, CAST(p + 2 AS INT), nlen) END) ELSE '' END
    || CASE WHEN p + 1 = pos - 1 + (SELECT rlen FROM lens l WHERE l.ordinal = c.ordinal AND l.src = c.src) THEN '$' ELSE '' END AS t FROM placed c WHERE q >= 13"""
_NEEDS |= {"placed": ["blocks", "ref"], "entry": ["lens", "placed"]}
register("mpileup", lambda s, d: P.mpileup(reads(s, d), reference(s)),
    "SELECT chrom, pos, any_value(ref) AS ref, count(*) AS depth, string_agg(t, '' ORDER BY src, ordinal) AS bases, string_agg(qc, '' ORDER BY src, ordinal) AS quals FROM entry GROUP BY 1, 2", "entry")
register("mpileup_inputs", lambda s, d: P.mpileup(reads(s, d), reference(s), inputs=[0, 1], regions=["chr1:101-400", "chr3:50-90"]),
    """SELECT chrom, pos, any_value(ref) AS ref, count(*) FILTER (src = 0) AS depth_0, coalesce(string_agg(t, '' ORDER BY ordinal) FILTER (src = 0), '*') AS bases_0, coalesce(string_agg(qc, '' ORDER BY ordinal) FILTER (src = 0), '*') AS quals_0,
      count(*) FILTER (src = 1) AS depth_1, coalesce(string_agg(t, '' ORDER BY ordinal) FILTER (src = 1), '*') AS bases_1, coalesce(string_agg(qc, '' ORDER BY ordinal) FILTER (src = 1), '*') AS quals_1
    FROM entry WHERE (chrom = 'chr1' AND pos BETWEEN 101 AND 400) OR (chrom = 'chr3' AND pos BETWEEN 50 AND 90) GROUP BY 1, 2""", "entry")  # fmt: skip
register("mpileup_all_positions", lambda s, d: P.mpileup(reads(s, d), reference(s), bed=bed(s, d), every=header_sq(s, d), min_mapq=30).drop("quals"),
    """SELECT a.chrom, a.pos, a.ref, coalesce(depth, 0) AS depth, coalesce(bases, '*') AS bases FROM (SELECT name AS chrom, unnest(range(1, 2101)) AS pos, unnest(string_split(seq, '')) AS ref FROM ref) a
    LEFT JOIN (SELECT chrom, pos, count(*) AS depth, string_agg(t, '' ORDER BY src, ordinal) AS bases FROM entry JOIN (SELECT ordinal AS o, coalesce(mapq, 0) AS mq FROM reads) ON o = ordinal WHERE mq >= 30
      AND EXISTS (SELECT 1 FROM bed b WHERE b.chrom = entry.chrom AND b.start0 < pos AND pos <= b.end0) GROUP BY 1, 2) x USING (chrom, pos)""", "entry", "bed")  # fmt: skip
register("mpileup_depth", lambda s, d: P.mpileup(reads(s, d), reference(s), min_base_quality=0).select("chrom", "pos", "ref", "depth"),
    """SELECT rname AS chrom, p + 1 AS pos, substr(ref.seq, CAST(p + 1 AS INT), 1) AS ref, count(*) AS depth FROM (SELECT rname, unnest(range(ref0, ref0 + len)) AS p FROM blocks WHERE op IN ('M', 'D', 'N') AND rname IS NOT NULL AND flag & 1796 = 0) JOIN ref ON ref.name = rname GROUP BY ALL""", "blocks", "ref")  # fmt: skip
_CONS = """WITH e AS (SELECT rname AS chrom, p + 1 AS pos, base FROM base UNION ALL SELECT rname, unnest(range(ref0, ref0 + len)) + 1, '*' FROM blocks WHERE op = 'D' AND rname IS NOT NULL AND flag & 1796 = 0),
  t AS (SELECT chrom, pos, count(*) AS depth, [8 * count(*) FILTER (base = 'A') + count(*) FILTER (base NOT IN ('A', 'C', 'G', 'T', '*')), 8 * count(*) FILTER (base = 'C') + count(*) FILTER (base NOT IN ('A', 'C', 'G', 'T', '*')), 8 * count(*) FILTER (base = 'G') + count(*) FILTER (base NOT IN ('A', 'C', 'G', 'T', '*')), 8 * count(*) FILTER (base = 'T') + count(*) FILTER (base NOT IN ('A', 'C', 'G', 'T', '*')), 8 * count(*) FILTER (base = '*')] AS s FROM e GROUP BY 1, 2),
  b AS (SELECT *, list_max(s) AS s1, list_position(s, list_max(s)) AS k, list_sum(s) AS total FROM t)"""
_CALLS = """SELECT chrom, pos, depth, CASE WHEN s1 = 0 THEN 'N' WHEN k = 5 THEN '*' WHEN s1 < 0.75 * total THEN 'N' ELSE substr('ACGT', k, 1) END AS call,
    CASE WHEN s1 = 0 OR total = 0 OR (k < 5 AND s1 < 0.75 * total) THEN 0 ELSE floor(100 * s1 / total) END::INT AS quality FROM b"""
register("consensus", lambda s, d: P.consensus(reads(s, d)), f"{_CONS} {_CALLS}", "base", "blocks")
register("consensus_ambiguous", lambda s, d: P.consensus(reads(s, d), ambiguous=True, use_quality=True, min_base_quality=10),
    """WITH e AS (SELECT rname AS chrom, p + 1 AS pos, base, q FROM base
      UNION ALL SELECT rname, unnest(range(ref0, ref0 + len)) + 1, '*', CASE WHEN qual IS NULL THEN 255 ELSE ascii(substr(qual, CAST(query0 + 1 AS INT), 1)) - 33 END FROM blocks WHERE op = 'D' AND rname IS NOT NULL AND flag & 1796 = 0),
    w AS (SELECT chrom, pos, CASE WHEN base IN ('A', 'C', 'G', 'T', '*') THEN 8 * q ELSE q END::BIGINT AS w, unnest(CASE base WHEN 'A' THEN [1] WHEN 'C' THEN [2] WHEN 'G' THEN [4] WHEN 'T' THEN [8] WHEN '*' THEN [16] ELSE [1, 2, 4, 8] END) AS c FROM e WHERE q >= 10),
    n AS (SELECT chrom, pos, depth, sum(w)::BIGINT AS total FROM w JOIN (SELECT chrom, pos, count(*) AS depth FROM e WHERE q >= 10 GROUP BY 1, 2) USING (chrom, pos) GROUP BY 1, 2, 3),
    s AS (SELECT chrom, pos, c, sum(w)::BIGINT AS s, row_number() OVER (PARTITION BY chrom, pos ORDER BY sum(w) DESC, c) AS k FROM w WHERE c IS NOT NULL GROUP BY 1, 2, 3),
    b AS (SELECT n.*, coalesce(x.s, 0) AS s1, x.c AS c1, coalesce(y.s, 0) AS s2, y.c AS c2, coalesce(x.s, 0) > 0 AND coalesce(y.s, 0) >= 0.5 * coalesce(x.s, 0) AS two
      FROM n LEFT JOIN (SELECT * FROM s WHERE k = 1) x USING (chrom, pos) LEFT JOIN (SELECT * FROM s WHERE k = 2) y USING (chrom, pos)),
    u AS (SELECT *, s1 + CASE WHEN two THEN s2 ELSE 0 END AS used FROM b),
    v AS (SELECT *, CASE WHEN used < 0.75 * total THEN CASE WHEN c1 = 16 THEN 16 ELSE 0 END WHEN s1 = 0 THEN 15 WHEN two THEN c1 | c2 ELSE c1 END AS code FROM u)
    SELECT chrom, pos, depth, CASE WHEN code >= 16 THEN '*' ELSE substr('NACMGRSVTWYHKDBN', code + 1, 1) END AS call,
      CASE WHEN code <> 0 AND total > 0 THEN floor(100 * used / total) ELSE 0 END::INT AS quality FROM v""", "base", "blocks")  # fmt: skip
register("consensus_text", lambda s, d: P.consensus_text(P.consensus(reads(s, d)), 500),
    f"""{_CONS}, c AS ({_CALLS}), k AS (SELECT chrom, (pos - 1) // 500 AS chunk, max(pos) AS most FROM c GROUP BY 1, 2),
    every AS (SELECT chrom, chunk, unnest(range(chunk * 500 + 1, most + 1)) AS pos FROM k)
    SELECT chrom, chunk, string_agg(CASE WHEN call = '*' THEN '' ELSE coalesce(call, 'N') END, '' ORDER BY pos) AS seq FROM every LEFT JOIN c USING (chrom, pos) GROUP BY 1, 2""", "base", "blocks")  # fmt: skip

#: Each aligned base beside the reference's, and each deletion, by the place in the reference.
_AGAINST = """WITH a AS (SELECT b.ordinal, b.src, query0 + k AS i, ref0 + k AS p, substr(b.seq, CAST(query0 + k + 1 AS INT), 1) AS x, substr(ref.seq, CAST(ref0 + k + 1 AS INT), 1) AS y
  FROM (SELECT *, unnest(range(0, len)) AS k FROM blocks WHERE op = 'M') b JOIN ref ON ref.name = b.rname)"""
register("calmd", lambda s, d: P.md_nm(reads(s, d), reference(s)).select("ordinal", "md", "nm"),
    f"""{_AGAINST}, e AS (SELECT ordinal, src, p, CASE WHEN x <> 'N' AND x = y THEN 1 ELSE 0 END AS m, CASE WHEN x = 'N' OR x <> y THEN y END AS t, CASE WHEN x = 'N' OR x <> y THEN 1 ELSE 0 END AS n FROM a
      UNION ALL SELECT b.ordinal, b.src, ref0, 0, concat('^', substr(ref.seq, CAST(ref0 + 1 AS INT), CAST(len AS INT))), len FROM blocks b JOIN ref ON ref.name = b.rname WHERE op = 'D'),
    c AS (SELECT *, sum(m) OVER (PARTITION BY ordinal, src ORDER BY p) AS c FROM e),
    z AS (SELECT ordinal, src, max(c) AS c, sum(n) AS n FROM c GROUP BY 1, 2),
    g AS (SELECT ordinal, src, string_agg(concat(run, t), '' ORDER BY p) AS told, max(c) AS c FROM (SELECT *, (c - lag(c, 1, 0) OVER (PARTITION BY ordinal, src ORDER BY p))::BIGINT AS run FROM c WHERE t IS NOT NULL) GROUP BY 1, 2)
    SELECT ordinal, concat(coalesce(told, ''), (z.c - coalesce(g.c, 0))::BIGINT) AS md, (z.n + coalesce(i.i, 0))::INT AS nm FROM z LEFT JOIN g USING (ordinal, src)
      LEFT JOIN (SELECT ordinal, src, sum(len) AS i FROM ops WHERE op = 'I' GROUP BY 1, 2) i USING (ordinal, src) JOIN reads USING (ordinal, src) WHERE flag & 4 = 0""", "blocks", "ref")  # fmt: skip
register("calmd_nm", lambda s, d: P.md_nm(reads(s, d), reference(s)).select("ordinal", F.col("nm").cast("bigint").alias("nm")),
    """WITH m AS (SELECT ordinal, src, count(*) FILTER (x = 'N' OR x <> y) AS n FROM (SELECT b.ordinal, b.src, substr(b.seq, CAST(query0 + k + 1 AS INT), 1) AS x, substr(ref.seq, CAST(ref0 + k + 1 AS INT), 1) AS y
      FROM (SELECT *, unnest(range(0, len)) AS k FROM blocks WHERE op = 'M') b JOIN ref ON ref.name = b.rname) GROUP BY 1, 2)
    SELECT ordinal, n + coalesce(i, 0)::BIGINT AS nm FROM m LEFT JOIN (SELECT ordinal, src, sum(len) AS i FROM ops WHERE op IN ('I', 'D') GROUP BY 1, 2) USING (ordinal, src) JOIN reads USING (ordinal, src) WHERE flag & 4 = 0""", "blocks", "ref")  # fmt: skip
register("calmd_masked", lambda s, d: P.calmd(reads(s, d), reference(s), bin_qualities=True, mask=True).select("ordinal", "seq", "qual"),
    f"""{_AGAINST}, s AS (SELECT r.ordinal, r.src, string_agg(CASE WHEN x = y THEN '=' ELSE substr(r.seq, CAST(j + 1 AS INT), 1) END, '' ORDER BY j) AS seq
      FROM (SELECT *, unnest(range(0, length(seq))) AS j FROM reads) r LEFT JOIN a ON a.ordinal = r.ordinal AND a.src = r.src AND a.i = r.j GROUP BY 1, 2)
    SELECT ordinal, s.seq, list_aggregate(list_transform(list_transform(string_split(qual, ''), lambda c: ascii(c) - 33), lambda x: chr(CASE WHEN x >= 3 THEN x // 10 * 10 + 7 ELSE x END + 33)), 'string_agg', '') AS qual
      FROM reads JOIN s USING (ordinal, src)""", "blocks", "ref")  # fmt: skip
register("reference_from_md", lambda s, d: P.reference_from_md(P.calmd(reads(s, d), reference(s))),
    """SELECT rname AS chrom, p + 1 AS pos, substr(ref.seq, CAST(p + 1 AS INT), 1) AS base FROM (SELECT DISTINCT rname, unnest(range(ref0, ref0 + len)) AS p FROM blocks WHERE op IN ('M', 'D') AND rname IS NOT NULL AND flag & 4 = 0) JOIN ref ON ref.name = rname""", "blocks", "ref")  # fmt: skip
register("reference_text", lambda s, d: P.reference_text(P.reference_from_md(P.calmd(reads(s, d), reference(s))), header_sq(s, d)),
    """WITH b AS (SELECT rname AS chrom, p + 1 AS pos, substr(ref.seq, CAST(p + 1 AS INT), 1) AS base FROM (SELECT DISTINCT rname, unnest(range(ref0, ref0 + len)) AS p FROM blocks WHERE op IN ('M', 'D') AND rname IS NOT NULL AND flag & 4 = 0) JOIN ref ON ref.name = rname)
    SELECT chrom, ((pos - 1) // 60)::BIGINT AS line, string_agg(coalesce(base, 'N'), '' ORDER BY pos) AS text FROM (SELECT name AS chrom, unnest(range(1, length + 1)) AS pos FROM sq) LEFT JOIN b USING (chrom, pos) GROUP BY 1, 2""", "blocks", "ref", "sq")  # fmt: skip
register("stats_trimmed_bases", lambda s, d: S.trimmed_bases(reads(s, d).withColumn("qual", F.repeat("qual", 6)), 20),
    """WITH v AS (SELECT ordinal, src, l, 20 - ascii(substr(CASE WHEN flag & 16 <> 0 THEN q ELSE reverse(q) END, CAST(l + 1 AS INT), 1)) + 33 AS v
      FROM (SELECT ordinal, src, flag, repeat(qual, 6) AS q, unnest(range(0, 60 - 35 + 1)) AS l FROM reads WHERE flag & 2304 = 0 AND qual IS NOT NULL)),
    s AS (SELECT *, sum(v) OVER (PARTITION BY ordinal, src ORDER BY l) AS s FROM v), o AS (SELECT *, min(s) OVER (PARTITION BY ordinal, src ORDER BY l) >= 0 AS ok FROM s)
    SELECT coalesce(sum(l), 0)::BIGINT AS bases FROM (SELECT l FROM o WHERE ok AND s > 0 QUALIFY row_number() OVER (PARTITION BY ordinal, src ORDER BY s DESC, l) = 1)""", "reads")  # fmt: skip
