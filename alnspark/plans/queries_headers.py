"""Queries over headers, names, barcodes and checks of the input."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import hashes, tags as T
from ..operators import amplicon, filters as V, mates, multi, regions, sorts, stats as S
from .derive import header_rg, header_sq, reads
from .registry import register

register("header_groups", lambda s, d: multi.kept_groups(header_rg(s, d), ["rgA", "rgR"], "lib2"), "SELECT id, lb, sm FROM rgs WHERE id IN ('rgA', 'rgR') AND lb = 'lib2'", "rgs")
register("header_references", lambda s, d: multi.with_references(header_sq(s, d).where("tid < 0"), header_sq(s, d).where("tid < 4")).select("tid", "name", "length"), "SELECT tid, name, length FROM sq WHERE tid < 4", "sq")


def _dictionaries(s, d):
    """The header's own references, the same in another order, and with one more and one less."""
    sq = header_sq(s, d)
    turned = sq.withColumn("tid", 5 - F.col("tid"))
    more = sq.unionByName(sq.where("tid = 0").withColumns({"tid": F.lit(6), "name": F.lit("more")}))
    return sq.withColumn("source", F.lit("same")).unionByName(turned.withColumn("source", F.lit("turned"))).unionByName(more.withColumn("source", F.lit("more"))).unionByName(sq.where("tid < 5").withColumn("source", F.lit("less")))


register("matching_references", lambda s, d: multi.matching_references(header_sq(s, d), _dictionaries(s, d)),
    """WITH d AS (SELECT 'same' AS source, tid, name, length FROM sq UNION ALL SELECT 'turned', 5 - tid, name, length FROM sq UNION ALL SELECT 'more', tid, name, length FROM sq UNION ALL SELECT 'more', 6, 'more', length FROM sq WHERE tid = 0
      UNION ALL SELECT 'less', tid, name, length FROM sq WHERE tid < 5)
    SELECT source, list((tid, name, length) ORDER BY tid) = (SELECT list((tid, name, length) ORDER BY tid) FROM sq) AS matches FROM d GROUP BY 1""", "sq")  # fmt: skip
register("name_hash", lambda s, d: reads(s, d).select("ordinal", hashes.x31(F.col("qname")).alias("x31"), hashes.name_hash(F.col("qname")).alias("mixed")),
    """WITH h AS (SELECT ordinal, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(qname, ''), lambda c: ascii(c)::BIGINT)), lambda h, b: (h * 31 + b) & 4294967295) AS x31 FROM reads),
    a AS (SELECT *, (x31 + ((~(x31 * 32768)) & 4294967295)) & 4294967295 AS k FROM h), b AS (SELECT ordinal, x31, xor(k, k >> 10) AS k FROM a), c AS (SELECT ordinal, x31, (k * 9) & 4294967295 AS k FROM b),
    e AS (SELECT ordinal, x31, xor(k, k >> 6) AS k FROM c), f AS (SELECT ordinal, x31, (k + ((~(k * 2048)) & 4294967295)) & 4294967295 AS k FROM e)
    SELECT ordinal, x31, xor(k, k >> 16) AS mixed FROM f""", "reads")  # fmt: skip
register("view_validated", lambda s, d: V.validated(reads(s, d), header_sq(s, d)).select("ordinal", "cigar"), "SELECT ordinal, cigar FROM reads", "reads")
register("original_alignment", lambda s, d: amplicon.original_alignment(T.set_tag(reads(s, d), "OA", "Z", F.when(F.col("ordinal") % 3 == 0, "before;"))).select("ordinal", T.value("OA").alias("oa")),
    """SELECT ordinal, concat(CASE WHEN ordinal % 3 = 0 THEN 'before;' END, qname, ',', coalesce(pos, 0), ',', CASE WHEN flag & 16 <> 0 THEN '-' ELSE '+' END, ',', coalesce(cigar, '*'),
      CASE WHEN nm IS NULL THEN concat(coalesce(mapq, 255), ',;') ELSE concat(',', coalesce(mapq, 255), ',', nm, ';') END) AS oa FROM reads""", "reads")  # fmt: skip

_ROUTES = """p AS (SELECT *, CASE WHEN flag & 192 = 64 THEN 1 WHEN flag & 192 = 128 THEN 2 ELSE 0 END AS part FROM picked WHERE flag & 2304 = 0),
  r AS (SELECT DISTINCT qname, part FROM p), t AS (SELECT part, CASE WHEN part = 0 THEN 'other' WHEN max((part = 1)::INT) OVER w = 1 AND max((part = 2)::INT) OVER w = 1 THEN 'pair' ELSE 'single' END AS route FROM r WINDOW w AS (PARTITION BY qname))
  SELECT route, part, count(*) AS reads FROM t GROUP BY 1, 2"""
register("fastq_counts", lambda s, d: mates.fastq_counts(mates.to_fastq(reads(s, d))), f"WITH picked AS (SELECT * FROM reads), {_ROUTES}", "reads")
register("fastq_tag_filters", lambda s, d: mates.fastq_counts(mates.to_fastq(V.by_tags(reads(s, d), {"RG": ["rgA", "rgN"], "BC": None}))),
    f"WITH picked AS (SELECT * FROM reads WHERE rg IN ('rgA', 'rgN') AND bc IS NOT NULL), {_ROUTES}", "reads")
_PAYLOAD = """u AS (SELECT *, CASE WHEN flag & 192 = 64 THEN 1 WHEN flag & 192 = 128 THEN 2 ELSE 0 END AS part, coalesce(nullif(regexp_extract(cigar, '^(?:[0-9]+H)?([0-9]+)S', 1), '')::INT, 0) AS a,
    coalesce(nullif(regexp_extract(cigar, '([0-9]+)S(?:[0-9]+H)?$', 1), '')::INT, 0) AS z, coalesce(qual, repeat('B', length(seq))) AS ql FROM reads WHERE flag & 2304 = 0),
  n AS (SELECT qname, first(bc ORDER BY src, ordinal) FILTER (bc IS NOT NULL) AS name_bc FROM u GROUP BY 1),
  b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY qname, part ORDER BY CASE WHEN qual IS NULL THEN 1 ELSE 0 END, src, ordinal) = 1),
  c AS (SELECT b.*, name_bc, substr(seq, a + 1, length(seq) - a - z) AS s, substr(ql, a + 1, length(seq) - a - z) AS q, CASE WHEN part = 0 THEN 'other' WHEN max((part = 1)::INT) OVER w = 1 AND max((part = 2)::INT) OVER w = 1 THEN 'pair' ELSE 'single' END AS route
    FROM b JOIN n USING (qname) WINDOW w AS (PARTITION BY qname)),
  t AS (SELECT *, CASE WHEN flag & 16 <> 0 THEN reverse(translate(s, 'ACGT', 'TGCA')) ELSE s END AS ts, CASE WHEN flag & 16 <> 0 THEN reverse(q) ELSE q END AS tq, substr(seq, 1, a) || substr(seq, length(seq) - z + 1, z) AS os,
    substr(ql, 1, a) || substr(ql, length(seq) - z + 1, z) AS oq FROM c)"""
register("fastq_payload", lambda s, d: mates.to_fastq(reads(s, d), suffix=True, strip=True, umi=["XX", "BC"], casava=True),
    f"""WITH {_PAYLOAD} SELECT concat(qname, coalesce(':' || bc, ''), CASE WHEN part > 0 THEN '/' || part ELSE '' END) AS qname, part, route, ts AS seq, tq AS qual,
      concat(CASE WHEN flag & 128 <> 0 THEN 2 ELSE 1 END, ':', CASE WHEN flag & 512 <> 0 THEN 'Y' ELSE 'N' END, ':0:', coalesce(bc, name_bc, '0')) AS comment FROM t""", "reads")  # fmt: skip
register("fastq_copied_tags", lambda s, d: mates.to_fastq(reads(s, d), strip=True, strip_tag="XC", copy_tags=["RG", "XC", "NM"]),
    f"""WITH {_PAYLOAD} SELECT qname, part, route, ts AS seq, tq AS qual, concat_ws(chr(9), 'RG:Z:' || rg, 'NM:i:' || nm, CASE WHEN a + z > 0 THEN concat('XC:Z:', CASE WHEN flag & 16 <> 0
      THEN concat(list_aggregate(list_reverse(regexp_extract_all(cigar, '[0-9]+[A-Z]')), 'string_agg', ''), ':', reverse(translate(os, 'ACGT', 'TGCA')), ':', reverse(oq)) ELSE concat(cigar, ':', os, ':', oq) END) END) AS comment FROM t""", "reads")  # fmt: skip


def _tagged(s, d):
    """Reads whose barcodes are of two parts here and there, some parted elsewhere, some longer, some with qualities."""
    x, n = reads(s, d), F.col("ordinal")
    b = F.when(n % 11 == 0, F.concat(T.value("BC"), F.lit("ACGT"))).when(n % 5 == 0, F.concat(T.value("BC"), F.lit("-A"))).when(n % 7 == 0, F.concat(F.lit("AC+"), T.value("BC"))).when(n % 13 == 0, "NNNNNNNNNN").otherwise(F.concat(T.value("BC"), F.lit("NN")))
    return T.set_tag(T.set_tag(x, "BC", "Z", b), "QT", "Z", F.when(n % 3 > 0, F.substr("qual", F.lit(1), F.least(F.length(T.value("BC")), F.lit(7)))))


_BARCODES = """x AS (SELECT src, ordinal, CASE WHEN ordinal % 11 = 0 THEN bc || 'ACGT' WHEN ordinal % 5 = 0 THEN bc || '-A' WHEN ordinal % 7 = 0 THEN 'AC+' || bc WHEN ordinal % 13 = 0 THEN 'NNNNNNNNNN' ELSE bc || 'NN' END AS b,
    CASE WHEN ordinal % 3 > 0 THEN qual END AS ql FROM reads WHERE flag & 2304 = 0 AND (flag & 1 = 0 OR flag & 192 = 64)),
  y AS (SELECT src, ordinal, b, substr(ql, 1, least(length(b), 7)::INT) AS q FROM x WHERE b IS NOT NULL AND length(b) <= (SELECT length(b) FROM x WHERE b IS NOT NULL ORDER BY src, ordinal LIMIT 1)),
  c AS (SELECT src, ordinal, q, length(b) AS n, i, substr(b, i::INT, 1) AS c FROM (SELECT *, unnest(range(1, length(b) + 1)) AS i FROM y)),
  sep AS (SELECT i FROM c WHERE c NOT IN ('A', 'C', 'G', 'T', 'N') ORDER BY src, ordinal, i LIMIT 1),
  st AS (SELECT *, coalesce(min(i) FILTER (c NOT IN ('A', 'C', 'G', 'T', 'N') AND i <> (SELECT i FROM sep)) OVER (PARTITION BY src, ordinal), 1000) AS stop FROM c)"""
register("stats_barcode_bases", lambda s, d: S.barcode_bases(_tagged(s, d)),
    f"""WITH {_BARCODES} SELECT i::INT AS cycle, count(*) FILTER (c = 'A') AS a, count(*) FILTER (c = 'C') AS c, count(*) FILTER (c = 'G') AS g, count(*) FILTER (c = 'T') AS t, count(*) FILTER (c = 'N') AS n FROM st WHERE i < stop GROUP BY i""", "reads")
register("stats_barcode_qualities", lambda s, d: S.barcode_qualities(_tagged(s, d)),
    f"""WITH {_BARCODES} SELECT i::INT AS cycle, (ascii(substr(q, i::INT, 1)) - 33)::INT AS quality, count(*) AS n FROM st WHERE stop = 1000 AND length(q) = n GROUP BY 1, 2""", "reads")

_ORDERS = [("coordinate", None), ("name", None), ("ascii", None), ("template", None), ("minimizer", None), ("coordinate", "ms"), ("name", "BC")]
_CHAIN = [{"ID": "align", "PN": "align"}, {"ID": "sort", "PN": "sort", "PP": "align"}, {"ID": "other", "PN": "other"}]


def _headers(s, d):
    """The lines of the header after each order, with the sorter as one more program at both ends of the chain."""
    programs = multi.program_chain(_CHAIN, "sort", "sort it")
    each = [regions.header_lines(header_sq(s, d), header_rg(s, d), by, tag, "@HD\tVN:1.5\tGO:query\tXX:kept", programs).withColumn("order", F.lit(f"{by} {tag or ''}")) for by, tag in _ORDERS]
    return reduce(DataFrame.unionByName, each).select("order", "kind", F.row_number().over(Window.partitionBy("order").orderBy("kind", "place")).alias("number"), "line")


register("header_order", _headers,
    """WITH o AS (SELECT * FROM (VALUES ('coordinate ', 'SO:coordinate'), ('name ', 'SO:queryname SS:queryname:natural'), ('ascii ', 'SO:queryname SS:queryname:lexicographical'),
        ('template ', 'SO:unsorted GO:query SS:unsorted:template-coordinate'), ('minimizer ', 'SO:unsorted SS:unsorted:minhash'), ('coordinate ms', 'SO:unsorted SS:unsorted:ms:coordinate'), ('name BC', 'SO:unsorted SS:unsorted:BC:queryname:natural')) v("order", told)),
      l AS (SELECT 1 AS kind, lpad(tid::VARCHAR, 12, '0') AS place, concat('@SQ SN:', name, ' LN:', length) AS line FROM sq UNION ALL SELECT 2, id, concat_ws(' ', '@RG', 'ID:' || id, 'LB:' || lb, 'SM:' || sm) FROM rgs
        UNION ALL SELECT 3, place, line FROM (VALUES ('0', '@PG ID:align PN:align'), ('1', '@PG ID:sort PN:sort PP:align'), ('2', '@PG ID:other PN:other'), ('3', '@PG ID:sort.1 PN:sort PP:sort CL:sort~it'), ('4', '@PG ID:sort.2 PN:sort PP:other CL:sort~it')) p(place, line)),
      a AS (SELECT "order", 0 AS kind, '' AS place, '@HD VN:1.5 XX:kept ' || told AS line FROM o UNION ALL SELECT "order", kind, place, line FROM o, l)
    SELECT "order", kind, row_number() OVER (PARTITION BY "order" ORDER BY kind, place)::INT AS number, replace(replace(line, ' ', chr(9)), '~', ' ') AS line FROM a""", "sq", "rgs")  # fmt: skip


def _merged(s, d, **options):
    """The second input numbers its references backwards and uses the same read groups."""
    one, two = reads(s, d).where("src = 0"), reads(s, d).where("src = 1").withColumns({"tid": 5 - F.col("tid"), "mtid": 5 - F.col("mtid")})
    return multi.merge_inputs([(one, header_sq(s, d), header_rg(s, d)), (two, header_sq(s, d).withColumn("tid", 5 - F.col("tid")), header_rg(s, d))], **options)


def _ranked(df):
    return sorts.rank_within(df, ["tid"], sorts.coordinate_keys()[1:], keep=["ordinal", "src", "tid", "mtid", T.value("RG").alias("rg")])


#: The names that the second input's groups get: fixed by the constants of the generator.
_NEW = "CASE {0} WHEN 'rgA' THEN 'rgA-055424A4' WHEN 'rgN' THEN 'rgN-3A2CCEF5' WHEN 'rgR' THEN 'rgR-6ADB4A65' END"
_RANK = "row_number() OVER (PARTITION BY tid ORDER BY coalesce(pos, 0), flag & 16, src, ordinal)::INT AS rank"
register("merge_inputs", lambda s, d: _ranked(_merged(s, d)[0]), f"SELECT ordinal, src, tid, mtid, CASE WHEN src = 1 THEN {_NEW.format('rg')} ELSE rg END AS rg, {_RANK} FROM reads", "reads")
register("merge_inputs_combined", lambda s, d: _ranked(_merged(s, d, combine_groups=True)[0]), f"SELECT ordinal, src, tid, mtid, rg, {_RANK} FROM reads", "reads")
register("merge_inputs_groups", lambda s, d: _merged(s, d)[2].select("id", "lb", "sm"), f"SELECT id, lb, sm FROM rgs UNION ALL SELECT {_NEW.format('id')}, lb, sm FROM rgs", "rgs")
