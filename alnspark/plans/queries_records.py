"""Queries over records: filters, counts, depth."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import flags as FL
from ..functions.expr import compile_filter
from ..operators import counts, depth as D, filters as V, intervals as I
from .derive import bed, header_rg, header_sq, reads
from .registry import register

ID = ["ordinal", "qname", "flag", "rname", "pos"]


def ids(df):
    return df.select(*ID)


PICK = "SELECT ordinal, qname, flag, rname, pos FROM "

register("view_require_flags", lambda s, d: ids(V.by_flags(reads(s, d), require=FL.PAIRED | FL.READ1)), PICK + "reads WHERE flag & 65 = 65", "reads")
register("view_exclude_flags", lambda s, d: ids(V.by_flags(reads(s, d), exclude=FL.UNMAP | FL.DUP)), PICK + "reads WHERE flag & 1028 = 0", "reads")
register("view_exclude_all_flags", lambda s, d: ids(V.by_flags(reads(s, d), exclude_all=FL.REVERSE | FL.MREVERSE)), PICK + "reads WHERE flag & 48 <> 48", "reads")
register("view_include_any_flags", lambda s, d: ids(V.by_flags(reads(s, d), include=FL.QCFAIL | FL.SECONDARY)), PICK + "reads WHERE flag & 768 <> 0", "reads")
register("view_min_mapq", lambda s, d: ids(V.by_mapq(reads(s, d), 20)), PICK + "reads WHERE coalesce(mapq, 0) >= 20", "reads")
register("view_min_query_length", lambda s, d: ids(V.by_query_length(reads(s, d), 10)), PICK + "span WHERE qlen >= 10", "span")
register("view_min_read_length", lambda s, d: ids(V.by_read_length(reads(s, d), 9)), PICK + "span WHERE mlen >= 9", "span")
register(
    "view_names",
    lambda s, d: ids(V.by_names(reads(s, d), s.read.parquet(f"{d}/orders.parquet").where("o_orderkey % 7 = 0").select(F.concat(F.lit("q"), F.col("o_orderkey").cast("string")).alias("qname")))),
    PICK + "reads WHERE qname IN (SELECT concat('q', o_orderkey) FROM orders WHERE o_orderkey % 7 = 0)", "reads",
)
register(
    "view_names_denied",
    lambda s, d: ids(V.by_names(reads(s, d), s.read.parquet(f"{d}/orders.parquet").where("o_orderkey % 3 = 0").select(F.concat(F.lit("q"), F.col("o_orderkey").cast("string")).alias("qname")), deny=True)),
    PICK + "reads WHERE qname NOT IN (SELECT concat('q', o_orderkey) FROM orders WHERE o_orderkey % 3 = 0)", "reads",
)
register("view_read_group", lambda s, d: ids(V.by_read_group(reads(s, d), ["rgA"])), PICK + "reads WHERE rg = 'rgA' OR rg IS NULL", "reads")
register("view_read_group_only", lambda s, d: ids(V.by_read_group(reads(s, d), ["rgA", "rgN"], need_group=True)), PICK + "reads WHERE rg IN ('rgA', 'rgN')", "reads")
register("view_library", lambda s, d: ids(V.by_library(reads(s, d), header_rg(s, d), "lib2")), PICK + "reads WHERE rg IN (SELECT id FROM rgs WHERE lb = 'lib2')", "reads", "rgs")
register("view_tag", lambda s, d: ids(V.by_tag(reads(s, d), "BC")), PICK + "reads WHERE bc IS NOT NULL", "reads")
register("view_tag_values", lambda s, d: ids(V.by_tag(reads(s, d), "NM", ["1", "2", "30"])), PICK + "reads WHERE nm IN (1, 2, 30)", "reads")
register("view_regions", lambda s, d: ids(V.by_regions(reads(s, d), ["chr1:100-200", "chr3:1,500", "chr5"])), PICK + "span WHERE (rname = 'chr1' AND end0 > 99 AND start0 < 200) OR (rname = 'chr3' AND end0 > 1499) OR rname = 'chr5'", "span")
register("view_unplaced", lambda s, d: ids(V.by_regions(reads(s, d), ["*"])), PICK + "reads WHERE rname IS NULL", "reads")
register("view_bed", lambda s, d: ids(V.by_bed(reads(s, d), bed(s, d))), PICK + "span r WHERE EXISTS (SELECT 1 FROM bed b WHERE b.chrom = r.rname AND b.start0 < r.end0 AND r.start0 < b.end0)", "span", "bed")
register("view_fetch_pairs", lambda s, d: ids(V.fetch_pairs(reads(s, d), ["chr2:1-150"])), PICK + "reads WHERE qname IN (SELECT qname FROM span WHERE rname = 'chr2' AND start0 < 150)", "span")
register("view_count", lambda s, d: V.by_mapq(V.by_flags(reads(s, d), exclude=4), 10).agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM reads WHERE flag & 4 = 0 AND coalesce(mapq, 0) >= 10", "reads")
register("view_unselected", lambda s, d: ids(reads(s, d).where(~F.coalesce(F.col("mapq") >= 30, F.lit(False)))), PICK + "reads WHERE NOT coalesce(mapq >= 30, false)", "reads")
register(
    "view_unmap", lambda s, d: V.unmap(reads(s, d), F.col("mapq") >= 25).select("ordinal", "flag", "mapq", "cigar", "tlen"),
    "SELECT ordinal, CASE WHEN mapq >= 25 THEN flag ELSE flag | 4 END AS flag, CASE WHEN mapq >= 25 THEN mapq ELSE 0 END AS mapq, CASE WHEN mapq >= 25 THEN cigar END AS cigar, CASE WHEN mapq >= 25 THEN tlen ELSE 0 END AS tlen FROM reads", "reads",
)
register("view_remove_flags", lambda s, d: V.remove_flags(reads(s, d), 1040).select("ordinal", "flag"), "SELECT ordinal, flag & ~1040 AS flag FROM reads", "reads")
register("view_save_counts", lambda s, d: V.save_counts(reads(s, d), F.col("mapq") >= 20), "SELECT count(*) AS processed, count(*) FILTER (mapq >= 20) AS accepted, count(*) - count(*) FILTER (mapq >= 20) AS rejected FROM reads", "reads")
register(
    "view_keep_tags", lambda s, d: V.T.keep_tags(reads(s, d), keep=["RG", "NM"]).select("ordinal", F.array_join("tag_order", ",").alias("tags"), V.T.value("RG").alias("rg"), V.T.value("BC").alias("bc")),
    "SELECT ordinal, CASE WHEN rg IS NULL THEN 'NM' ELSE 'RG,NM' END AS tags, rg, CAST(NULL AS VARCHAR) AS bc FROM reads", "reads",
)
register(
    "view_remove_tags", lambda s, d: V.T.keep_tags(reads(s, d), remove=["RG", "BC", "ms"]).select("ordinal", F.array_join("tag_order", ",").alias("tags")),
    "SELECT ordinal, 'NM' AS tags FROM reads", "reads",
)
_WRAP, _DOWN = "({0}) % 18446744073709551616::UHUGEINT", "xor({0}, {0} >> {1}::UHUGEINT)"
register("view_subsample", lambda s, d: ids(V.subsample(reads(s, d), 42, 0.25)),
    f"""WITH n AS (SELECT DISTINCT qname, list_reduce(list_prepend(xor(14695981039346656037::UHUGEINT, 42::UHUGEINT), list_transform(string_split(qname, ''), lambda c: ascii(c)::UHUGEINT)),
        lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) AS a FROM reads),
      m AS (SELECT qname, {_WRAP.format(_DOWN.format("a", 30) + " * 13787848793156543929::UHUGEINT")} AS b FROM n), k AS (SELECT qname, {_WRAP.format(_DOWN.format("b", 27) + " * 10723151780598845931::UHUGEINT")} AS c FROM m)
    {PICK}reads JOIN k USING (qname) WHERE {_DOWN.format("c", 31)}::DOUBLE / 18446744073709551616.0 < 0.25""", "reads")  # fmt: skip
register(
    "cigar_metrics", lambda s, d: V.cigar_metrics(reads(s, d)).drop("src"),
    """SELECT r.ordinal, coalesce(n, 0)::INT AS ncigar, r.qlen, r.rlen, coalesce(sc, 0)::BIGINT AS sclen, coalesce(hc, 0)::BIGINT AS hclen, CASE WHEN pos > 0 THEN pos + r.rlen - 1 END AS endpos
    FROM span r LEFT JOIN (SELECT ordinal, src, count(*) AS n, sum(CASE WHEN op = 'S' THEN len ELSE 0 END) AS sc, sum(CASE WHEN op = 'H' THEN len ELSE 0 END) AS hc FROM ops GROUP BY 1, 2) USING (ordinal, src)""", "span",
)
for name, expression, sql in (
    ("view_expr_flags", "mapq >= 20 && flag.paired && !(flag & 1024)", "coalesce(mapq, 0) >= 20 AND flag & 1 <> 0 AND flag & 1024 = 0"),
    ("view_expr_tag", "[NM] < 5 || [RG] == \"rgA\"", "nm < 5 OR coalesce(rg = 'rgA', false)"),
    ("view_expr_lengths", "rlen > qlen || (sclen >= 2 && endpos < 500)", "rlen > qlen OR (cigar LIKE '%S%' AND coalesce(pos + rlen - 1 < 500, false))"),
    ("view_expr_regex", "seq =~ \"AC+G\" && rname != \"chr1\"", "regexp_matches(seq, 'AC+G') AND coalesce(rname, '*') <> 'chr1'"),
    ("view_expr_precedence", "flag & 4 == 4 || flag & 64 | 2 == 66 && mapq + 1 > 20", "flag & 4 = 4 OR ((flag & 64) | 2 = 66 AND coalesce(mapq, 0) + 1 > 20)"),
    ("view_expr_mate", "rnext == rname && abs(tlen) < 100 && pos % 2 == 1", "rnext = rname AND abs(tlen) < 100 AND pos % 2 = 1"),
):
    register(name, lambda s, d, e=expression: ids(reads(s, d).where(compile_filter(e))), PICK + f"span WHERE {sql}", "span")
register("view_expr_library", lambda s, d: ids(reads(s, d).where(compile_filter("library == \"lib2\" && flag & 16 != 16", {r.id: r.lb for r in header_rg(s, d).collect()}))),
    PICK + "reads LEFT JOIN (SELECT id, any_value(lb) AS lb FROM rgs GROUP BY 1) g ON g.id = rg WHERE lb = 'lib2' AND flag & 16 = 0", "reads", "rgs")
register(
    "sanitize", lambda s, d: V.sanitize(reads(s, d), "on,cigdup", header_sq(s, d)).select("ordinal", "flag", "mapq", "cigar", V.T.value("NM").alias("nm")),
    """SELECT ordinal, CASE WHEN flag & 4 <> 0 THEN flag & ~2306 ELSE flag END AS flag, CASE WHEN flag & 4 <> 0 THEN 0 ELSE mapq END AS mapq,
       CASE WHEN flag & 4 = 0 THEN cigar END AS cigar, CASE WHEN flag & 4 = 0 THEN CAST(nm AS VARCHAR) END AS nm FROM reads""", "reads",
)
register("flag_names", lambda s, d: reads(s, d).select("flag").distinct().select("flag", FL.flag_names(F.col("flag")).alias("names"), FL.flags_report(F.col("flag")).alias("report")),
    "SELECT DISTINCT flag, " + (names := "concat_ws(',', " + ", ".join(f"CASE WHEN flag & {m} <> 0 THEN '{n}' END" for n, m in FL.FLAGS.items()) + ")") + f" AS names, concat('0x', lower(to_hex(flag)), chr(9), flag, chr(9), {names}) AS report FROM reads", "reads")

_CATS = """
c AS (SELECT flag & 512 <> 0 AS fail, flag & 256 <> 0 AS sec, flag & 256 = 0 AND flag & 2048 <> 0 AS sup, flag & 2304 = 0 AS pri, flag & 2304 = 0 AND flag & 1 <> 0 AS prd, flag & 4 = 0 AS map, flag & 8 <> 0 AS mun,
  flag & 1024 <> 0 AS dup, flag, coalesce(tid <> mtid, false) AS far, coalesce(mapq, 0) AS mq FROM reads),
f AS (SELECT unnest([
  {'category': 'total', 'v': true}, {'category': 'primary', 'v': pri}, {'category': 'secondary', 'v': sec}, {'category': 'supplementary', 'v': sup}, {'category': 'duplicates', 'v': dup}, {'category': 'primary duplicates', 'v': pri AND dup},
  {'category': 'mapped', 'v': map}, {'category': 'primary mapped', 'v': pri AND map}, {'category': 'paired in sequencing', 'v': prd}, {'category': 'read1', 'v': prd AND flag & 64 <> 0}, {'category': 'read2', 'v': prd AND flag & 128 <> 0},
  {'category': 'properly paired', 'v': prd AND flag & 2 <> 0 AND map}, {'category': 'with itself and mate mapped', 'v': prd AND map AND NOT mun}, {'category': 'singletons', 'v': prd AND map AND mun},
  {'category': 'with mate mapped to a different chr', 'v': prd AND map AND NOT mun AND far}, {'category': 'with mate mapped to a different chr (mapQ>=5)', 'v': prd AND map AND NOT mun AND far AND mq >= 5}]) AS x, fail FROM c)
"""
register("flagstat", lambda s, d: counts.flagstat(reads(s, d)), f"WITH {_CATS} SELECT x.category AS category, count(*) FILTER (x.v AND NOT fail) AS passed, count(*) FILTER (x.v AND fail) AS failed FROM f GROUP BY 1", "reads")
register("flagstat_percent", lambda s, d: counts.flagstat_percent(reads(s, d)),
    f"""WITH {_CATS}, t AS (SELECT x.category AS category, count(*) FILTER (x.v AND NOT fail) AS n FROM f GROUP BY 1)
    SELECT a.category, printf('%.2f%%', (CAST(a.n AS FLOAT) / CAST(b.n AS FLOAT) * 100)::DOUBLE) AS percent FROM t a JOIN t b
    ON b.category = CASE WHEN a.category = 'primary mapped' THEN 'primary' WHEN a.category IN ('properly paired', 'singletons') THEN 'paired in sequencing' WHEN a.category = 'mapped' THEN 'total' END""", "reads")  # fmt: skip
register("idxstats", lambda s, d: counts.idxstats(reads(s, d), header_sq(s, d)),
    """WITH n AS (SELECT coalesce(rname, '*') AS name, count(*) FILTER (flag & 4 = 0) AS m, count(*) FILTER (flag & 4 <> 0) AS u FROM reads GROUP BY 1), a AS (SELECT name, length FROM sq UNION ALL SELECT '*', 0)
    SELECT a.name, a.length::BIGINT AS length, CASE WHEN a.name = '*' THEN 0 ELSE coalesce(m, 0) END::BIGINT AS mapped, coalesce(u, 0) AS unmapped FROM a LEFT JOIN n ON a.name = n.name""", "reads", "sq")  # fmt: skip
register("samples", lambda s, d: counts.samples(header_rg(s, d)), "SELECT DISTINCT coalesce(sm, '.') AS sample FROM rgs", "rgs")
register("head_records", lambda s, d: ids(reads(s, d).orderBy("ordinal").limit(10)), PICK + "reads ORDER BY ordinal LIMIT 10", "reads")

register("depth", lambda s, d: D.depth(reads(s, d)),
    """SELECT rname AS chrom, p + 1 AS pos, count(*) FILTER (op = 'M') AS depth FROM (SELECT rname, op, unnest(range(ref0, ref0 + len)) AS p FROM blocks WHERE op IN ('M', 'D') AND rname IS NOT NULL AND flag & 1796 = 0) GROUP BY 1, 2""", "blocks")  # fmt: skip
register("depth_deletions", lambda s, d: D.depth(reads(s, d), deletions=True),
    "SELECT rname AS chrom, p + 1 AS pos, count(*) AS depth FROM (SELECT rname, unnest(range(ref0, ref0 + len)) AS p FROM blocks WHERE op IN ('M', 'D') AND rname IS NOT NULL AND flag & 1796 = 0) GROUP BY 1, 2", "blocks")
register("depth_all_positions", lambda s, d: D.depth_all(reads(s, d), header_sq(s, d), only_covered=False, min_mapq=20),
    """SELECT a.chrom, a.pos, coalesce(x.depth, 0) AS depth FROM (SELECT name AS chrom, unnest(range(1, length + 1)) AS pos FROM sq) a
    LEFT JOIN (SELECT rname AS chrom, p + 1 AS pos, count(*) AS depth FROM base WHERE mapq >= 20 GROUP BY 1, 2) x ON a.chrom = x.chrom AND a.pos = x.pos""", "base", "sq")  # fmt: skip
register("depth_once_per_template", lambda s, d: D.depth_once_per_template(reads(s, d)),
    "SELECT rname AS chrom, p + 1 AS pos, count(DISTINCT CASE WHEN flag & 1 <> 0 THEN qname END) + count(*) FILTER (flag & 1 = 0) AS depth FROM base GROUP BY 1, 2", "base")
register("depth_by_input", lambda s, d: D.depth_by_input(reads(s, d), [0, 1]),
    "SELECT rname AS chrom, p + 1 AS pos, count(*) FILTER (src = 0) AS depth_0, count(*) FILTER (src = 1) AS depth_1 FROM base GROUP BY 1, 2", "base")
register("depth_summary", lambda s, d: D.depth_summary(reads(s, d), header_sq(s, d)),
    """SELECT a.chrom, round(avg(coalesce(x.depth, 0)), 6) AS mean, CAST(median(coalesce(x.depth, 0)) AS DOUBLE) AS median, min(coalesce(x.depth, 0)) AS least, max(coalesce(x.depth, 0)) AS most, count(*) FILTER (coalesce(x.depth, 0) = 0) AS uncovered
    FROM (SELECT name AS chrom, unnest(range(1, length + 1)) AS pos FROM sq) a LEFT JOIN depth x ON a.chrom = x.chrom AND a.pos = x.pos GROUP BY 1""", "depth", "sq")  # fmt: skip
register("coverage", lambda s, d: D.coverage(reads(s, d), header_sq(s, d), min_base_quality=5),
    """WITH a AS (SELECT rname, p, count(*) AS d, sum(q) AS q FROM base WHERE q >= 5 GROUP BY 1, 2), b AS (SELECT rname, count(*) AS cov, sum(d) AS d, sum(q) AS q FROM a GROUP BY 1),
    n AS (SELECT rname, count(*) AS n, avg(coalesce(mapq, 0)) AS mq FROM kept WHERE rname IS NOT NULL GROUP BY 1)
    SELECT name AS rname, CAST(1 AS BIGINT) AS startpos, length AS endpos, coalesce(n, 0) AS numreads, coalesce(cov, 0) AS covbases, round(100 * coalesce(cov, 0) / length, 6) AS coverage, round(coalesce(d, 0) / length, 6) AS meandepth,
      round(coalesce(q / d, 0), 6) AS meanbaseq, round(coalesce(mq, 0), 6) AS meanmapq FROM sq LEFT JOIN b ON name = b.rname LEFT JOIN n ON name = n.rname""", "base", "kept", "sq")  # fmt: skip
register("coverage_histogram", lambda s, d: D.coverage_histogram(reads(s, d), header_sq(s, d), 20),
    "SELECT chrom AS rname, ((pos - 1) * 20) // length AS bin, count(*) AS covered FROM depth JOIN sq ON chrom = name GROUP BY 1, 2", "depth", "sq")
register("bedcov", lambda s, d: D.bedcov(reads(s, d), bed(s, d), min_depth=8),
    """WITH b AS (SELECT chrom, start0, end0, name, coalesce(sum(CASE WHEN ref0 IS NOT NULL THEN least(end0, ref0 + len) - greatest(start0, ref0) END), 0)::BIGINT AS bases FROM bed LEFT JOIN
      (SELECT * FROM blocks WHERE op IN ('M', 'D', 'N') AND flag & 1796 = 0) x ON chrom = rname AND start0 < ref0 + len AND ref0 < end0 GROUP BY ALL),
    n AS (SELECT v.name, count(s.ordinal) AS reads FROM bed v LEFT JOIN (SELECT * FROM span WHERE flag & 1796 = 0) s ON v.chrom = s.rname AND v.start0 < s.end0 AND s.start0 < v.end0 GROUP BY 1),
    dp AS (SELECT rname, p, count(*) AS d FROM (SELECT rname, unnest(range(ref0, ref0 + len)) AS p FROM blocks WHERE op IN ('M', 'D', 'N') AND flag & 1796 = 0) GROUP BY 1, 2),
    t AS (SELECT v.name, count(dp.p) AS deep FROM bed v LEFT JOIN dp ON v.chrom = dp.rname AND dp.p >= v.start0 AND dp.p < v.end0 AND d >= 8 GROUP BY 1)
    SELECT chrom, start0, end0, name, bases, reads, deep FROM b JOIN n USING (name) JOIN t USING (name)""", "blocks", "span", "bed")  # fmt: skip
register("bedcov_no_deletions", lambda s, d: D.bedcov(reads(s, d), bed(s, d), skip_deletions=True, min_mapq=10).drop("reads"),
    """SELECT chrom, start0, end0, name, coalesce(sum(CASE WHEN ref0 IS NOT NULL THEN least(end0, ref0 + len) - greatest(start0, ref0) END), 0)::BIGINT AS bases FROM bed LEFT JOIN
      (SELECT * FROM blocks WHERE op = 'M' AND flag & 1796 = 0 AND mapq >= 10) x ON chrom = rname AND start0 < ref0 + len AND ref0 < end0 GROUP BY ALL""", "blocks", "bed")  # fmt: skip
register("merge_intervals", lambda s, d: I.merge_intervals(bed(s, d)),
    """WITH m AS (SELECT chrom, start0, end0, max(end0) OVER (PARTITION BY chrom ORDER BY start0, end0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM bed),
    g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start0 > reach THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start0, end0) AS k FROM m) SELECT chrom, min(start0) AS start0, max(end0) AS end0 FROM g GROUP BY chrom, k""", "bed")  # fmt: skip
