"""Queries over templates, orders and several inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as Q, tags as T
from ..operators import chains, dedup, mates, multi, sorts
from ..sources.scratch import written
from .derive import header_rg, header_sq, reads
from .registry import register

register("sort_coordinate", lambda s, d: sorts.rank_within(sorts.sort(reads(s, d)), ["tid"], sorts.coordinate_keys()[1:], keep=["ordinal", "tid", "pos"]),
    "SELECT ordinal, tid, pos, row_number() OVER (PARTITION BY tid ORDER BY coalesce(pos, 0), flag & 16, src, ordinal)::INT AS rank FROM reads", "reads")
register("sort_name_ascii", lambda s, d: sorts.rank_within(reads(s, d), ["rname"], sorts.name_keys(False), keep=["ordinal", "qname"]),
    "SELECT ordinal, qname, row_number() OVER (PARTITION BY rname ORDER BY qname, ((flag & 192) << 8) | ((flag & 256) << 3) | ((flag & 2048) >> 3), src, ordinal)::INT AS rank FROM reads", "reads")
register("sort_name_natural", lambda s, d: sorts.rank_within(reads(s, d), ["rname"], sorts.name_keys(), keep=["ordinal", "qname"]),
    "SELECT ordinal, qname, row_number() OVER (PARTITION BY rname ORDER BY CAST(substr(qname, 2) AS BIGINT), ((flag & 192) << 8) | ((flag & 256) << 3) | ((flag & 2048) >> 3), src, ordinal)::INT AS rank FROM reads", "reads")
register("sort_tag", lambda s, d: sorts.rank_within(reads(s, d), ["rname"], sorts.tag_keys("ms"), keep=["ordinal", T.value("ms").alias("ms")]),
    """SELECT ordinal, CAST(ms AS VARCHAR) AS ms, row_number() OVER (PARTITION BY rname ORDER BY ms NULLS FIRST, tid, coalesce(pos, 0), flag & 16, CAST(substr(qname, 2) AS BIGINT),
      ((flag & 192) << 8) | ((flag & 256) << 3) | ((flag & 2048) >> 3), src, ordinal)::INT AS rank FROM reads""", "reads")  # fmt: skip
register("sort_minimizer", lambda s, d: sorts.minimizer(reads(s, d)).orderBy(F.col("tid").asc_nulls_last(), "pos", "minhash").select("ordinal", "minhash"))
register("cat", lambda s, d: sorts.cat([reads(s, d).where("src = 0"), reads(s, d).where("src = 1")]).groupBy("src").agg(F.count("*").alias("n")), "SELECT src, count(*) AS n FROM reads GROUP BY 1", "reads")
register("merge", lambda s, d: sorts.rank_within(sorts.merge([reads(s, d).where("src = 1"), reads(s, d).where("src = 0")]), ["tid"], sorts.coordinate_keys()[1:], keep=["ordinal", "src"]),
    "SELECT ordinal, 1 - src AS src, row_number() OVER (PARTITION BY tid ORDER BY coalesce(pos, 0), flag & 16, 1 - src, ordinal)::INT AS rank FROM reads", "reads")
register("collate", lambda s, d: sorts.rank_within(sorts.collate(reads(s, d)), ["qname"], [F.shiftright("flag", 6).bitwiseAND(3), F.col("ordinal")], keep=["qname", "ordinal"], small=True),
    "SELECT qname, ordinal, row_number() OVER (PARTITION BY qname ORDER BY (flag >> 6) & 3, ordinal)::INT AS rank FROM reads", "reads")

#: The first two primary records of each name, each beside the other.
_MATES = """
e AS (SELECT r.*, pos - 1 + greatest(coalesce(rlen, 0), 1) AS endp, coalesce((SELECT sum(ascii(c) - 33) FILTER (ascii(c) - 33 >= 15) FROM (SELECT unnest(string_split(r.qual, '')) AS c)), 0)::BIGINT AS score
  FROM reads r LEFT JOIN lens USING (ordinal, src)),
k AS (SELECT *, CASE WHEN flag & 16 <> 0 THEN endp ELSE pos - 1 END AS five, CASE WHEN flag & 2304 = 0 THEN row_number() OVER (PARTITION BY qname, flag & 2304 = 0 ORDER BY src, ordinal) END AS k FROM e),
m AS (SELECT a.*, b.ordinal AS b_o, b.flag AS b_flag, b.tid AS b_tid, b.rname AS b_rname, b.pos AS b_pos, b.mapq AS b_mapq, coalesce(b.cigar, '*') AS b_cigar, b.five AS b_five, b.score AS b_score
  FROM k a LEFT JOIN k b ON a.qname = b.qname AND a.k <= 2 AND b.k = 3 - a.k),
fm AS (SELECT ordinal, src, qname, rg, seq, qual, pos, rname, tid, cigar, mapq, score,
  CASE WHEN b_o IS NULL THEN flag ELSE ((flag | 1) & ~40) | CASE WHEN b_flag & 4 <> 0 THEN 8 ELSE 0 END | CASE WHEN b_flag & 16 <> 0 THEN 32 ELSE 0 END END AS flag,
  CASE WHEN b_o IS NULL THEN mtid ELSE b_tid END AS mtid, CASE WHEN b_o IS NULL THEN rnext ELSE b_rname END AS rnext, CASE WHEN b_o IS NULL THEN pnext ELSE b_pos END AS pnext,
  CASE WHEN b_o IS NULL THEN tlen WHEN flag & 4 = 0 AND b_flag & 4 = 0 AND tid = b_tid THEN b_five - five ELSE 0 END AS tlen,
  CASE WHEN b_flag & 4 = 0 THEN CAST(b_mapq AS VARCHAR) END AS mq, CASE WHEN b_o IS NOT NULL AND NOT (b_flag & 4 <> 0 AND flag & 4 <> 0) THEN b_cigar END AS mc,
  CASE WHEN b_o IS NULL THEN ms ELSE b_score END AS ms FROM m)
"""
register("fixmate", lambda s, d: mates.fixmate(reads(s, d), scores=True).select("ordinal", "flag", "mtid", "rnext", "pnext", "tlen", T.value("MQ").alias("mq"), T.value("MC").alias("mc"), T.value("ms").cast("bigint").alias("ms")),
    f"WITH {_MATES} SELECT ordinal, flag, mtid, rnext, pnext, tlen, mq, mc, ms FROM fm", "lens")
register("fixmate_template_cigar", lambda s, d: mates.fixmate(reads(s, d), template_cigar=True, remove=True).select("ordinal", "flag", T.value("ct").alias("ct")),
    f"""WITH {_MATES}, f AS (SELECT *, CASE WHEN flag & 64 <> 0 THEN '1' WHEN flag & 128 <> 0 THEN '2' ELSE '0' END || CASE WHEN flag & 16 <> 0 THEN 'R' ELSE 'F' END || coalesce(cigar, '*') AS mine,
      CASE WHEN b_flag & 64 <> 0 THEN '1' WHEN b_flag & 128 <> 0 THEN '2' ELSE '0' END || CASE WHEN b_flag & 16 <> 0 THEN 'R' ELSE 'F' END || b_cigar AS other,
      b_o IS NOT NULL AND flag & 4 = 0 AND b_flag & 4 = 0 AND tid = b_tid AND (pos < b_pos OR (pos = b_pos AND k = 1)) AS lft FROM m)
    SELECT ordinal, fm.flag & CASE WHEN b_flag & 4 <> 0 THEN ~34 ELSE -1 END AS flag, CASE WHEN lft THEN concat(mine, (b_pos - endp - 1)::BIGINT, 'T', other) END AS ct
      FROM fm JOIN (SELECT ordinal, src, b_flag, b_pos, endp, mine, other, lft FROM f) f USING (ordinal, src) WHERE fm.flag & 260 = 0""", "lens")  # fmt: skip
register("to_fastq", lambda s, d: mates.to_fastq(reads(s, d)),
    """WITH p AS (SELECT *, CASE WHEN flag & 192 = 64 THEN 1 WHEN flag & 192 = 128 THEN 2 ELSE 0 END AS part FROM reads WHERE flag & 2304 = 0),
    b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY qname, part ORDER BY CASE WHEN qual IS NULL THEN 1 ELSE 0 END, src, ordinal) = 1)
    SELECT qname, part, CASE WHEN part = 0 THEN 'other' WHEN max((part = 1)::INT) OVER w = 1 AND max((part = 2)::INT) OVER w = 1 THEN 'pair' ELSE 'single' END AS route,
      CASE WHEN flag & 16 <> 0 THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END AS seq, coalesce(CASE WHEN flag & 16 <> 0 THEN reverse(qual) ELSE qual END, repeat('B', length(seq))) AS qual FROM b WINDOW w AS (PARTITION BY qname)""", "reads")  # fmt: skip

#: Keys over the repaired mates, for records with a mate and for all.
_DUPS = f"""{_MATES},
o2 AS (SELECT ordinal, src, i, CAST(lens2[i] AS BIGINT) AS len, kinds[i] AS op FROM (SELECT ordinal, src, regexp_extract_all(mc, '[0-9]+') AS lens2, regexp_extract_all(mc, '[MIDNSHP=X]') AS kinds, unnest(range(1, len(regexp_extract_all(mc, '[0-9]+')) + 1)) AS i FROM fm WHERE mc IS NOT NULL)),
clip AS (SELECT ordinal, src, sum(len) FILTER (op IN ('S','H') AND i <= 2 AND i < f) AS lead, sum(len) FILTER (op IN ('S','H') AND i > f) AS trail, sum(len) FILTER (op IN ('M','D','N')) AS rl FROM (SELECT *, min(CASE WHEN op NOT IN ('S','H') THEN i END) OVER (PARTITION BY ordinal, src) AS f FROM ops) GROUP BY 1, 2),
clip2 AS (SELECT ordinal, src, sum(len) FILTER (op IN ('S','H') AND i < f) AS lead2, sum(len) FILTER (op IN ('S','H') AND i > f) AS trail2, sum(len) FILTER (op IN ('M','D','N')) AS rl2 FROM (SELECT *, min(CASE WHEN op NOT IN ('S','H') THEN i END) OVER (PARTITION BY ordinal, src) AS f FROM o2) GROUP BY 1, 2),
x AS (SELECT fm.*, flag & 1 <> 0 AND flag & 8 = 0 AND NOT (mtid IS NULL AND pnext IS NULL) AS paired, pos - coalesce(lead, 0) AS us, pos - 1 + coalesce(rl, 0) + coalesce(trail, 0) AS ue, coalesce(pnext, 0) - coalesce(lead2, 0) AS os,
  coalesce(pnext, 0) - 1 + coalesce(rl2, 0) + coalesce(trail2, 0) AS oe, flag & 16 <> 0 AS r, flag & 32 <> 0 AS mr, flag & 64 <> 0 AS r1, coalesce(tid, -1) + 1 AS t, coalesce(mtid, -1) + 1 AS ot
  FROM fm LEFT JOIN clip USING (ordinal, src) LEFT JOIN clip2 USING (ordinal, src) WHERE flag & 2308 = 0 AND flag & 512 = 0),
lf AS (SELECT *, CASE WHEN t <> ot THEN t < ot WHEN r = mr AND NOT r THEN us <= os WHEN r = mr THEN ue <= oe WHEN r THEN ue <= os ELSE us <= oe END AS lft FROM x),
ky AS (SELECT *, CASE WHEN lft AND r = mr THEN concat('s', CASE WHEN r <> r1 THEN 1 ELSE 0 END) WHEN r = mr THEN concat('s', CASE WHEN r = r1 THEN 1 ELSE 0 END) WHEN lft <> r THEN 'FR' ELSE 'RF' END AS ori,
  CASE WHEN (lft AND r <> mr AND r) OR (NOT lft AND (r = mr OR r)) THEN ue ELSE us END AS ka, CASE WHEN (lft AND (r = mr OR NOT r)) OR (NOT lft AND r <> mr AND NOT r) THEN oe ELSE os END AS kb, CASE WHEN r THEN ue ELSE us END AS sa FROM lf),
dd AS (SELECT ordinal, src, qname, paired, CASE WHEN paired THEN row_number() OVER (PARTITION BY paired, t, ka, ot, kb, lft, ori ORDER BY score + coalesce(ms, 0) DESC, qname, ordinal) > 1
  ELSE bool_or(paired) OVER (PARTITION BY t, sa, r) OR row_number() OVER (PARTITION BY paired, t, sa, r ORDER BY score DESC, ordinal) > 1 END AS dup FROM ky)
"""

#: The same with names that tell places; failed records have places too, but are no duplicates.
_OPTICAL = _DUPS.replace("FROM fm LEFT JOIN clip", "FROM (SELECT * REPLACE (concat('m:1:f:1:', ordinal % 3, ':', ordinal % 997, ':', ordinal % 499) AS qname) FROM fm) fm LEFT JOIN clip")
_OPTICAL = _OPTICAL.replace("AND flag & 512 = 0", "").replace("AS dup FROM ky)", "AS dup FROM ky WHERE flag & 512 = 0)")


def _by_group(df):
    """n and sum of ordinals of each read group. The sums are exact; they are numbers of 64 bits unless one of them isn't."""
    x = written(multi.split_key(df, "RG").groupBy("split_key").agg(F.count("*").alias("n"), F.sum(F.col("ordinal").cast("decimal(20,0)")).alias("sum")), "groups")
    wide = not x.where(F.col("sum").try_cast("bigint").isNull() & F.col("sum").isNotNull()).isEmpty()
    return x if wide else x.withColumn("sum", F.col("sum").cast("bigint"))


def _fixed(s, d, primary=False):
    """Reads with their mates repaired. primary: without secondary and supplementary ones, which neither have mates nor are examined."""
    x = reads(s, d).where("flag & 2304 = 0") if primary else reads(s, d)
    return mates.fixmate(T.beside(x, "RG", "BC", "MC", "ms", "SA", "XA").withColumn("good", Q.quality_sum(F.col("qual"))), scores=True)


register("sort_template_coordinate", lambda s, d: sorts.rank_within(sorts.template_keys(mates.fixmate(reads(s, d)).where(T.value("MC").isNotNull()), header_rg(s, d)), ["t1"], [*sorts.template_order(), F.col("ordinal")], keep=["ordinal", "t1", "p1", "upper"]),
    f"""WITH {_DUPS}, places AS (SELECT fm.*, flag & 4 = 0 AS here, flag & 1 <> 0 AND flag & 8 = 0 AS there, pos - coalesce(lead, 0) AS us, pos - 1 + coalesce(rl, 0) + coalesce(trail, 0) AS ue,
      pnext - coalesce(lead2, 0) AS os, pnext - 1 + coalesce(rl2, 0) + coalesce(trail2, 0) AS oe FROM fm LEFT JOIN clip USING (ordinal, src) LEFT JOIN clip2 USING (ordinal, src) WHERE mc IS NOT NULL),
    h AS (SELECT *, CASE WHEN here THEN coalesce(tid, -1) ELSE 2147483647 END AS ta, CASE WHEN NOT here THEN 4611686018427387904 WHEN flag & 16 <> 0 THEN ue ELSE us END AS pa, here AND flag & 16 <> 0 AS na,
      CASE WHEN there THEN coalesce(mtid, -1) ELSE 2147483647 END AS tb, CASE WHEN NOT there THEN 4611686018427387904 WHEN flag & 32 <> 0 THEN oe ELSE os END AS pb, there AND flag & 32 <> 0 AS nb FROM places),
    turned AS (SELECT *, NOT (ta < tb OR (ta = tb AND (pa < pb OR (pa = pb AND NOT na)))) AS upper FROM h),
    q AS (SELECT ordinal, qname, upper, coalesce(lb, '') AS lib, CASE WHEN upper THEN tb ELSE ta END AS t1, CASE WHEN upper THEN ta ELSE tb END AS t2, CASE WHEN upper THEN pb ELSE pa END AS p1,
      CASE WHEN upper THEN pa ELSE pb END AS p2, CASE WHEN upper THEN nb ELSE na END AS n1, CASE WHEN upper THEN na ELSE nb END AS n2 FROM turned LEFT JOIN rgs ON rgs.id = turned.rg)
    SELECT ordinal, t1::INT AS t1, p1::BIGINT AS p1, upper, row_number() OVER (PARTITION BY t1 ORDER BY t2, p1, p2, n1 DESC, n2 DESC, lib, qname, upper, ordinal)::INT AS rank FROM q""", "lens", "rgs")  # fmt: skip
register("markdup", lambda s, d: dedup.duplicates(_fixed(s, d)).select("ordinal", "qname", "kind", "dup"), f"WITH {_DUPS} SELECT ordinal, qname, CASE WHEN paired THEN 'pair' ELSE 'single' END AS kind, dup FROM dd", "lens")
register("markdup_flags", lambda s, d: dedup.markdup(_fixed(s, d), clear=True).select("ordinal", "flag"),
    f"WITH {_DUPS} SELECT fm.ordinal, (flag & ~1024) | CASE WHEN coalesce(dup, false) THEN 1024 ELSE 0 END AS flag FROM fm LEFT JOIN dd USING (ordinal, src)", "lens")
register("markdup_sequence_mode", lambda s, d: dedup.duplicates(_fixed(s, d), mode="sequence").select("ordinal", "qname", "kind", "dup"),
    f"""WITH {_DUPS}, d AS (SELECT *, CASE WHEN t <> ot THEN t - ot WHEN r = mr AND NOT r THEN us - os WHEN r = mr THEN ue - oe WHEN r THEN ue - os ELSE us - oe END AS diff FROM x),
    l AS (SELECT * EXCLUDE (diff), CASE WHEN diff <> 0 THEN diff < 0 WHEN pos = pnext THEN r1 ELSE coalesce(pos < pnext, false) END AS lft FROM d),
    y AS (SELECT *, CASE WHEN r = mr THEN CASE WHEN lft = (NOT r) THEN 'FF' ELSE 'RR' END WHEN lft = (NOT r) THEN 'FR' ELSE 'RF' END AS ori, CASE WHEN r THEN ue ELSE us END AS ka, CASE WHEN mr THEN oe ELSE os END AS kb FROM l)
    SELECT ordinal, qname, CASE WHEN paired THEN 'pair' ELSE 'single' END AS kind, CASE WHEN paired THEN row_number() OVER (PARTITION BY paired, t, ka, ot, kb, lft, ori ORDER BY score + coalesce(ms, 0) DESC, qname, ordinal) > 1
      ELSE bool_or(paired) OVER (PARTITION BY t, ka, r) OR row_number() OVER (PARTITION BY paired, t, ka, r ORDER BY score DESC, ordinal) > 1 END AS dup FROM y""", "lens")  # fmt: skip
register("markdup_remove_barcode", lambda s, d: dedup.markdup(_fixed(s, d), barcode="BC", groups=True, clear=True, remove=True, supplementary=True).select("ordinal", "flag"),
    f"""WITH {_DUPS}, y AS (SELECT ky.*, bc FROM ky JOIN reads USING (ordinal, src)),
    g AS (SELECT ordinal, src, CASE WHEN paired THEN row_number() OVER (PARTITION BY paired, t, ka, ot, kb, lft, ori, rg, bc ORDER BY score + coalesce(ms, 0) DESC, qname, ordinal) > 1
      ELSE bool_or(paired) OVER (PARTITION BY t, sa, r, rg, bc) OR row_number() OVER (PARTITION BY paired, t, sa, r, rg, bc ORDER BY score DESC, ordinal) > 1 END AS twin FROM y),
    z AS (SELECT fm.ordinal, qname, flag & ~1024 AS flag, coalesce(twin, false) AS twin FROM fm LEFT JOIN g USING (ordinal, src)), seed AS (SELECT DISTINCT qname FROM z WHERE twin AND flag & 8 <> 0)
    SELECT ordinal, flag FROM z WHERE NOT twin AND NOT (flag & 2308 <> 0 AND qname IN (SELECT qname FROM seed))""", "lens")  # fmt: skip
register("markdup_barcode_pattern", lambda s, d: dedup.duplicates(_fixed(s, d), barcode_pattern="([0-9])$").select("ordinal", "kind", "dup"),
    f"""WITH {_DUPS} SELECT ordinal, CASE WHEN paired THEN 'pair' ELSE 'single' END AS kind, CASE WHEN paired THEN row_number() OVER (PARTITION BY paired, t, ka, ot, kb, lft, ori, right(qname, 1) ORDER BY score + coalesce(ms, 0) DESC, qname, ordinal) > 1
      ELSE bool_or(paired) OVER (PARTITION BY t, sa, r, right(qname, 1)) OR row_number() OVER (PARTITION BY paired, t, sa, r, right(qname, 1) ORDER BY score DESC, ordinal) > 1 END AS dup FROM ky""", "lens")  # fmt: skip
register("markdup_metrics", lambda s, d: dedup.markdup_metrics(_fixed(s, d)).drop("library_size"),
    f"""WITH {_DUPS} SELECT count(*) AS examined, count(*) FILTER (paired) AS paired, count(*) FILTER (NOT paired) AS single, count(*) FILTER (paired AND dup) AS duplicate_pair, count(*) FILTER (NOT paired AND dup) AS duplicate_single,
    (SELECT count(*) FROM fm WHERE flag & 2308 = 0 AND flag & 512 <> 0) AS excluded FROM dd""", "lens")  # fmt: skip
register("rmdup_single", lambda s, d: dedup.rmdup(reads(s, d), single_end=True).select("ordinal"),
    "SELECT ordinal FROM (SELECT ordinal, flag, row_number() OVER (PARTITION BY flag & 4 <> 0, tid, pos, flag & 16 ORDER BY coalesce(mapq, 0) DESC, ordinal) AS k FROM reads) WHERE flag & 4 <> 0 OR k = 1", "reads")
register("rmdup_paired", lambda s, d: dedup.rmdup(reads(s, d)).select("ordinal"),
    """WITH x AS (SELECT ordinal, qname, coalesce(mapq, 0) AS q, {'t': coalesce(tid, -1), 'p': coalesce(pos, 0), 'r': flag & 16 <> 0} AS spot, flag & 4 <> 0 AS u, flag & 1 <> 0 AND flag & 8 = 0 AS two FROM reads),
    n AS (SELECT *, (row_number() OVER (PARTITION BY qname ORDER BY ordinal) - 1) // 2 AS unit FROM x WHERE NOT u AND two),
    b AS (SELECT qname, unit, count(*) AS k, min(spot) AS a, max(spot) AS b, sum(q) AS s, max(ordinal) AS late FROM n GROUP BY 1, 2),
    w AS (SELECT *, row_number() OVER (PARTITION BY k, a, b ORDER BY s DESC, late) AS place FROM b)
    SELECT ordinal FROM x WHERE u UNION ALL SELECT ordinal FROM (SELECT ordinal FROM x WHERE NOT u AND NOT two QUALIFY row_number() OVER (PARTITION BY spot ORDER BY q DESC, ordinal) = 1)
    UNION ALL SELECT ordinal FROM n JOIN w USING (qname, unit) WHERE k = 1 OR place = 1""", "reads")  # fmt: skip
register("add_read_group", lambda s, d: multi.add_read_group(reads(s, d), "new", overwrite=False).select("ordinal", T.value("RG").alias("rg"), F.element_at("tag_order", -1).alias("last")),
    "SELECT ordinal, coalesce(rg, 'new') AS rg, CASE WHEN rg IS NULL THEN 'RG' ELSE 'NM' END AS last FROM reads", "reads")
register("split_by_group", lambda s, d: _by_group(reads(s, d)), "SELECT rg AS split_key, count(*) AS n, CAST(sum(ordinal) AS BIGINT) AS sum FROM reads GROUP BY 1", "reads")
register("reset", lambda s, d: multi.reset(reads(s, d)).select("ordinal", "flag", "seq", "qual", "pos", F.array_join("tag_order", ",").alias("tags")),
    """SELECT ordinal, (flag & 705) | 4 | CASE WHEN flag & 1 <> 0 THEN 8 ELSE 0 END AS flag, CASE WHEN flag & 16 <> 0 THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END AS seq,
    CASE WHEN flag & 16 <> 0 THEN reverse(qual) ELSE qual END AS qual, CAST(NULL AS BIGINT) AS pos, concat_ws(',', CASE WHEN rg IS NOT NULL THEN 'RG' END, CASE WHEN bc IS NOT NULL THEN 'BC' END) AS tags FROM reads WHERE flag & 2304 = 0""", "reads")  # fmt: skip
register("reheader", lambda s, d: multi.reheader(reads(s, d), header_sq(s, d).withColumn("name", F.concat(F.lit("ref"), F.col("tid").cast("string")))).select("ordinal", "rname", "rnext"), "SELECT ordinal, concat('ref', tid) AS rname, concat('ref', mtid) AS rnext FROM (SELECT ordinal, CAST(tid AS VARCHAR) AS tid, CAST(mtid AS VARCHAR) AS mtid FROM reads) WHERE tid IS NOT NULL AND mtid IS NOT NULL UNION ALL SELECT ordinal, CASE WHEN tid IS NOT NULL THEN concat('ref', tid) END, CASE WHEN mtid IS NOT NULL THEN concat('ref', mtid) END FROM reads WHERE tid IS NULL OR mtid IS NULL", "reads")
register("merge_headers", lambda s, d: multi.merge_headers([header_sq(s, d).where("tid < 3"), header_sq(s, d).where("tid > 0")]), "SELECT name, length, tid FROM sq", "sq")
register("quality_scalars", lambda s, d: reads(s, d).select("ordinal", Q.quality_sum(F.col("qual")).alias("good"), Q.bin_qualities(F.col("qual")).alias("binned"), Q.gc_count(F.col("seq")).alias("gc"), Q.reverse_complement(F.col("seq")).alias("rc")),
    """SELECT ordinal, coalesce(list_sum(list_filter(list_transform(string_split(qual, ''), lambda c: ascii(c) - 33), lambda x: x >= 15)), 0)::BIGINT AS good,
    list_aggregate(list_transform(list_transform(string_split(qual, ''), lambda c: ascii(c) - 33), lambda x: chr(CASE WHEN x >= 3 THEN x // 10 * 10 + 7 ELSE x END + 33)), 'string_agg', '') AS binned,
    CAST(length(seq) - length(translate(seq, 'GC', '')) AS INT) AS gc, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM reads""", "reads")  # fmt: skip
register("markdup_counts", lambda s, d: dedup.duplicate_counts(_fixed(s, d)).select("ordinal", "n"),
    f"WITH {_DUPS}, n AS (SELECT *, count(*) FILTER (dup) OVER v AS n FROM (SELECT dd.*, ky.t, ky.ka, ky.ot, ky.kb, ky.lft, ky.ori FROM dd JOIN ky USING (ordinal, src) WHERE dd.paired) WINDOW v AS (PARTITION BY t, ka, ot, kb, lft, ori)) SELECT ordinal, n FROM n WHERE NOT dup AND n > 0", "lens")
register("markdup_optical", lambda s, d: dedup.optical(_fixed(s, d, True).withColumn("qname", F.expr("concat('m:1:f:1:', ordinal % 3, ':', ordinal % 997, ':', ordinal % 499)")), 200).select("ordinal", "optical"),
    f"""WITH {_OPTICAL} SELECT a.ordinal, EXISTS (SELECT 1 FROM ky b WHERE b.t = a.t AND b.ka IS NOT DISTINCT FROM a.ka AND b.ot = a.ot AND b.kb IS NOT DISTINCT FROM a.kb AND b.lft = a.lft AND b.ori = a.ori AND b.ordinal <> a.ordinal
      AND b.ordinal % 3 = a.ordinal % 3 AND abs(b.ordinal % 997 - a.ordinal % 997) <= 200 AND abs(b.ordinal % 499 - a.ordinal % 499) <= 200) AS optical FROM dd JOIN ky a USING (ordinal, src) WHERE dd.paired AND dup""", "lens")  # fmt: skip
register("rename_groups", lambda s, d: multi.rename_groups(reads(s, d), {"rgA": "x", "rgN": "y"}).select("ordinal", T.value("RG").alias("rg")), "SELECT ordinal, CASE rg WHEN 'rgA' THEN 'x' WHEN 'rgN' THEN 'y' ELSE rg END AS rg FROM reads", "reads")
_PLACES = "concat('m:1:f:1:', ordinal % 3, ':', ordinal % 997, ':', ordinal % 499)"
_NAMED = _DUPS.replace("FROM fm LEFT JOIN clip", "FROM (SELECT * REPLACE (concat('m:1:f:1:', ordinal % 3, ':', ordinal % 997, ':', ordinal % 499) AS qname) FROM fm) fm LEFT JOIN clip")
register("markdup_chains", lambda s, d: chains.chains(_fixed(s, d, True).withColumn("qname", F.expr(_PLACES)), 200).select("ordinal", "root_ordinal", "origin", "type"),
    f"""WITH {_NAMED}, pk AS (SELECT *, first_value(ordinal) OVER (PARTITION BY t, ka, ot, kb, lft, ori ORDER BY score + coalesce(ms, 0) DESC, qname, ordinal) AS root FROM ky WHERE paired),
    h AS (SELECT t, sa, r, arg_min(root, ordinal) AS root FROM pk GROUP BY 1, 2, 3),
    sg AS (SELECT k.*, coalesce(h.root, first_value(k.ordinal) OVER (PARTITION BY k.t, k.sa, k.r ORDER BY score DESC, k.ordinal)) AS root FROM ky k LEFT JOIN h ON k.t = h.t AND k.sa IS NOT DISTINCT FROM h.sa AND k.r = h.r WHERE NOT paired),
    al AS (SELECT ordinal, qname, paired, score + CASE WHEN paired THEN coalesce(ms, 0) ELSE 0 END AS worth, root FROM pk UNION ALL SELECT ordinal, qname, paired, score, root FROM sg)
    SELECT a.ordinal, a.root AS root_ordinal, c.qname AS origin, CASE WHEN EXISTS (SELECT 1 FROM al b WHERE b.root = a.root AND b.ordinal % 3 = a.ordinal % 3 AND abs(b.ordinal % 997 - a.ordinal % 997) <= 200 AND abs(b.ordinal % 499 - a.ordinal % 499) <= 200
      AND (b.ordinal = a.root OR (b.paired AND NOT a.paired) OR (b.paired = a.paired AND (b.worth > a.worth OR (b.worth = a.worth AND b.qname < a.qname))))) THEN 'SQ' ELSE 'LB' END AS type
    FROM al a JOIN al c ON c.ordinal = a.root WHERE a.ordinal <> a.root""", "lens")  # fmt: skip
register("markdup_chain_counts", lambda s, d: chains.counts(_fixed(s, d, True)).select("ordinal", "n"),
    f"""WITH {_DUPS}, pk AS (SELECT *, score + coalesce(ms, 0) AS worth, first_value(ordinal) OVER (PARTITION BY t, ka, ot, kb, lft, ori ORDER BY score + coalesce(ms, 0) DESC, qname, ordinal) AS root FROM ky WHERE paired),
    h AS (SELECT t, sa, r, min(ordinal) AS holder FROM pk GROUP BY 1, 2, 3),
    sg AS (SELECT k.*, holder FROM ky k LEFT JOIN h ON k.t = h.t AND k.sa IS NOT DISTINCT FROM h.sa AND k.r = h.r WHERE NOT paired),
    credit AS (SELECT holder, holder AS time FROM sg WHERE holder IS NOT NULL GROUP BY holder HAVING min(ordinal) < holder UNION ALL SELECT holder, ordinal FROM sg WHERE ordinal > holder),
    good AS (SELECT p.root, count(*) AS more FROM credit c JOIN pk p ON p.ordinal = c.holder WHERE NOT EXISTS (SELECT 1 FROM pk b WHERE b.root = p.root AND b.ordinal <= c.time AND (b.worth > p.worth OR (b.worth = p.worth AND (b.qname < p.qname OR (b.qname = p.qname AND b.ordinal < p.ordinal))))) GROUP BY 1)
    SELECT root AS ordinal, (n + coalesce(more, 0))::BIGINT AS n FROM (SELECT root, count(*) AS n FROM pk GROUP BY 1) LEFT JOIN good USING (root)
    UNION ALL SELECT arg_min(ordinal, {{'s': -score, 'o': ordinal}}), count(*) FROM sg WHERE holder IS NULL GROUP BY t, sa, r""", "lens")  # fmt: skip
