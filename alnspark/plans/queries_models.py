"""Queries of the operators with a model. Those without SQL are too sequential for it; tests hold them against small cases."""

from __future__ import annotations

from ..operators import assembly as A, haplotypes as H, models as M
from .derive import header_sq, reads, reference
from .registry import CTES, _NEEDS, register

register("genotype_calls", lambda s, d: M.calls(reads(s, d)))
register("target_segments", lambda s, d: M.target_segments(reads(s, d), header_sq(s, d)))
register("phase", lambda s, d: M.phase(reads(s, d), least_lod=5))
register("phase_haplotypes", lambda s, d: H.Phased(reads(s, d), least_lod=5).sites())
register("phase_routed", lambda s, d: H.Phased(reads(s, d), least_lod=5).routed().select("ordinal", "qname", "flag", "part", "phased"))

#: Each record's base (or none) at each position, with what it inserts behind it, and columns of these.
CTES["letters"] = """SELECT rname AS chrom, ref0 + k + 1 AS pos, CASE op WHEN 'M' THEN substr(seq, CAST(query0 + k + 1 AS INT), 1) ELSE '*' END AS base, CAST(query0 + CASE op WHEN 'M' THEN k ELSE 0 END + 1 AS INT) AS i,
    CASE WHEN k = len - 1 AND following = 'I' THEN substr(seq, CAST(nquery + 1 AS INT), CAST(nlen AS INT)) END AS ins, seq, mapq, qual
  FROM (SELECT *, unnest(range(0, len)) AS k FROM (SELECT *, lead(op) OVER v AS following, lead(len) OVER v AS nlen, lead(query0) OVER v AS nquery FROM blocks WINDOW v AS (PARTITION BY ordinal, src ORDER BY i)))
  WHERE op IN ('M', 'D') AND rname IS NOT NULL AND flag & 1796 = 0"""
CTES["observed"] = """SELECT chrom, pos, nth, depth, CASE WHEN nth = 0 THEN base WHEN length(ins) >= nth THEN substr(ins, nth, 1) ELSE '*' END AS base, CASE WHEN qual IS NULL THEN 255 ELSE ascii(substr(qual, i, 1)) - 33 END AS q, coalesce(mapq, 255) AS mapq,
    coalesce(list_min(list_filter(range(i + 1, length(seq) + 1), lambda j: substr(seq, j, 1) <> substr(seq, i, 1))), length(seq) + 1) - coalesce(list_max(list_filter(range(1, i), lambda j: substr(seq, j, 1) <> substr(seq, i, 1))), 0) - 1 AS poly
  FROM letters JOIN (SELECT chrom, pos, depth, unnest(range(0, most + 1))::INT AS nth FROM (SELECT chrom, pos, count(*) AS depth, coalesce(max(length(ins)), 0) AS most FROM letters GROUP BY 1, 2)) USING (chrom, pos)"""
CTES["simple"] = """SELECT chrom, pos, nth, depth, CASE WHEN s1 = 0 THEN 'N' WHEN k = 5 THEN '*' WHEN s1 < 0.75 * total THEN 'N' ELSE substr('ACGT', k, 1) END AS call, CASE WHEN s1 = 0 OR (k < 5 AND s1 < 0.75 * total) THEN 0 ELSE floor(100 * s1 / total) END::INT AS quality
  FROM (SELECT *, list_max(s) AS s1, list_position(s, list_max(s)) AS k, list_sum(s) AS total FROM (
    SELECT chrom, pos, nth, depth, list_transform(['A', 'C', 'G', 'T', '*'], lambda b: 8 * list_count(list_filter(list(base), lambda x: x = b)) + CASE WHEN b = '*' THEN 0 ELSE list_count(list_filter(list(base), lambda x: x NOT IN ('A', 'C', 'G', 'T', '*'))) END) AS s
    FROM observed GROUP BY 1, 2, 3, 4))"""
_NEEDS |= {"letters": ["blocks"], "observed": ["letters"], "simple": ["observed"]}

register("consensus_columns", lambda s, d: A.simple(A.columns(reads(s, d), model=False, qualities=False)), "SELECT * FROM simple", "simple")
_LINES = """SELECT chrom, line, substr(s, CAST(line * 70 + 1 AS INT), 70) AS seq, substr(t, CAST(line * 70 + 1 AS INT), 70) AS qual FROM (
    SELECT *, unnest(range(0, (length(s) + 69) // 70)) AS line FROM (SELECT chrom, string_agg(call, '' ORDER BY pos, nth) AS s, string_agg(q, '' ORDER BY pos, nth) AS t FROM told GROUP BY 1))"""
register(
    "consensus_fastq", lambda s, d: A.assemble(A.simple(A.columns(reads(s, d), model=False, qualities=False)), chunk=300),
    f"""WITH gone AS (SELECT chrom, pos FROM simple WHERE nth = 0 AND call = '*'), every AS (SELECT chrom, unnest(range(lo, hi + 1)) AS pos FROM (SELECT chrom, min(pos) AS lo, max(pos) AS hi FROM simple GROUP BY 1)),
      told AS (SELECT chrom, pos, nth, call, chr(least(quality, 93) + 33) AS q FROM simple ANTI JOIN gone USING (chrom, pos) WHERE call <> '*'
        UNION ALL SELECT chrom, pos, 0, 'N', '!' FROM every ANTI JOIN simple USING (chrom, pos)) {_LINES}""", "simple",
)
register(
    "consensus_over_reference", lambda s, d: A.assemble(A.simple(A.columns(reads(s, d), model=False, qualities=False)), header_sq(s, d), every=True, reference=reference(s), reference_quality=20, show_deleted=True, chunk=512),
    f"""WITH told AS (SELECT chrom, pos, nth, call, chr(least(quality, 93) + 33) AS q FROM simple WHERE nth = 0 OR call <> '*'
        UNION ALL SELECT name, pos, 0, substr(seq, CAST(pos AS INT), 1), '5' FROM (SELECT name, seq, unnest(range(1, length(seq) + 1)) AS pos FROM ref) r ANTI JOIN simple c ON c.chrom = r.name AND c.pos = r.pos) {_LINES}""", "simple", "ref",
)

_LOG2 = "(floor(log2({0})) - 1 + (2 - {0} / 2 ** floor(log2({0})) / 3) * ({0} / 2 ** floor(log2({0}))) - 2.0 / 3)"
_EXP = "CASE WHEN abs({0}) <= 50 THEN exp(trunc({0} * 10) / 10) ELSE exp(trunc(greatest(least({0}, 500), -500))) END"
#: The genotype model by its formulas: the quality of each observation, its part in each of 15 genotypes, the best single and double one.
_BAYES = f"""WITH n AS (SELECT chrom, pos, nth, depth, position(base IN 'ACGT*') AS b, CASE WHEN q = 255 THEN 10 ELSE q END AS q, mapq, poly, count(*) AS n FROM observed GROUP BY ALL),
  e AS (SELECT *, 10 ** (-least(q, 100) / 10) AS err, 10 ** (-0.09 * trunc(greatest(1, least(60, mapq * (2 - least(depth, 30) / 30))))) AS wrong FROM n),
  x AS (SELECT *, err + 0.75 * wrong - err * wrong AS mix FROM e), f AS (SELECT *, greatest(-3.0103 * {_LOG2.format("mix")}, 1) AS quality FROM x),
  l AS (SELECT *, greatest(trunc(least(quality, 100)), 1) AS q1, greatest(trunc(greatest(1, quality - (poly - 2) * 0.01)), 1) AS q2 FROM f),
  t AS (SELECT *, ln(10 ** (-q1 / 10) / 3) AS miss1, ln(1 - 10 ** (-q1 / 10)) AS match1, ln(10 ** (-q2 / 10) / 3) AS miss2, ln(1 - 10 ** (-q2 / 10)) AS match2 FROM l),
  u AS (SELECT *, least(miss2, match2 - 0.5) AS extra, ln((exp(match1) + exp(miss1)) / 2) AS half1, ln((exp(match2) + exp(miss2)) / 2) AS half2 FROM t),
  g AS (SELECT row_number() OVER (ORDER BY x, y) AS g, x, y, CASE WHEN x = y THEN 0 WHEN y = 5 THEN ln(2e-4 / 6) ELSE ln(1e-3 / 6) END AS prior FROM (SELECT unnest(range(1, 6)) AS x) JOIN (SELECT unnest(range(1, 6)) AS y) ON x <= y),
  s AS (SELECT chrom, pos, nth, any_value(depth) AS depth, g, any_value(x) AS x, any_value(y) AS y, sum(n * (CASE
      WHEN b = 5 THEN CASE WHEN x = 5 THEN match2 WHEN y = 5 THEN ln((exp(extra) + exp(match2)) / 2) ELSE extra END
      WHEN y = 5 THEN CASE WHEN x = 5 THEN extra WHEN b IN (0, x) THEN least(ln((exp(extra) + exp(match2)) / 2), half2 + 0.5) ELSE ln((exp(extra) + exp(miss2)) / 2) END
      WHEN b = 0 OR (b = x AND b = y) THEN match1 WHEN b IN (x, y) THEN half1 ELSE miss1 END - miss1)) + any_value(prior) AS s0, round(s0, 9) AS s, sum(n) FILTER (b > 0) AS known FROM u, g GROUP BY chrom, pos, nth, g),
  m AS (SELECT *, s - max(s) OVER (PARTITION BY chrom, pos, nth) AS d FROM s), p AS (SELECT *, {_EXP.format("d")} AS p FROM m),
  c AS (SELECT chrom, pos, nth, any_value(depth) AS depth, any_value(known) AS known, list({{'x': x, 'y': y, 'g': g, 'p': p}}) AS all_, arg_max({{'x': x, 'y': y, 'g': g, 'p': p}}, {{'s': s, 'first': -g}}) FILTER (x = y) AS one, arg_max({{'x': x, 'y': y, 'g': g, 'p': p}}, {{'s': s, 'first': -g}}) FILTER (x <> y) AS two FROM p GROUP BY 1, 2, 3),
  r AS (SELECT *, list_sum(list_transform(list_filter(all_, lambda a: a.g <> one.g), lambda a: a.p)) AS rest1, list_sum(list_transform(list_filter(all_, lambda a: a.g <> two.g), lambda a: a.p)) AS rest2 FROM c),
  v AS (SELECT *, CASE WHEN one.p = 1 AND rest1 < 0.01 THEN rest1 ELSE 1 - one.p / (rest1 + one.p) END AS w FROM r),
  o AS (SELECT *, CASE WHEN known IS NULL THEN 0 ELSE greatest(trunc(-3.0103 * {_LOG2.format("w")} + 0.5), 0) END AS single, CASE WHEN known IS NULL THEN 0 ELSE trunc(3.0103 * ({_LOG2.format("two.p")} - {_LOG2.format("rest2")}) + 0.5) END AS odds FROM v),
  z AS (SELECT *, CASE WHEN known IS NULL THEN '*' WHEN odds > 0 THEN substr('AMRWaCSYcGKgTt*', two.g::INT, 1) ELSE substr('ACGT*', one.x::INT, 1) END AS call, CASE WHEN odds > 0 THEN odds ELSE single END AS quality FROM o)
  SELECT chrom, pos, nth, depth, CASE WHEN quality < 10 AND call <> '*' AND two.y < 5 THEN 'N' ELSE call END AS call, CASE WHEN quality < 10 AND call <> '*' AND two.y < 5 THEN 0 ELSE quality END::INT AS quality FROM z"""
register("consensus_bayesian", lambda s, d: A.bayesian(A.weighed(reads(s, d)), ambiguous=True), _BAYES, "observed")
