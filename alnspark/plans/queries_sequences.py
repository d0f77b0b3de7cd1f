"""Queries for sequence files and text output."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fastx as X, mates
from . import queries_templates  # noqa: F401  (the SQL of to_fastq)
from .derive import contigs, reads
from .registry import ORACLES, register

register("dict", lambda s, d: X.dictionary(contigs(s, d)).drop("line"), "SELECT name, length(seq) AS length, md5(upper(seq)) AS md5 FROM contigs", "contigs")
register("dict_lines", lambda s, d: X.dictionary(contigs(s, d), assembly="made", species="none").select("line"),
    "SELECT concat('@SQ', chr(9), 'SN:', name, chr(9), 'LN:', length(seq), chr(9), 'M5:', md5(upper(seq)), chr(9), 'AS:made', chr(9), 'SP:none') AS line FROM contigs", "contigs")
_STRETCHES = "SELECT unnest(['part3:11-30', 'part8:41', 'part10', 'part199:1,5-25']) AS region, unnest(['part3', 'part8', 'part10', 'part199']) AS name, unnest([11, 41, 1, 15]) AS a, unnest([30, 100000, 100000, 25]) AS b"
_REGIONS = ["part3:11-30", "part8:41", "part10", "part199:1,5-25"]
register("faidx_fetch", lambda s, d: X.fetch(contigs(s, d), _REGIONS).select("region", "seq"), f"SELECT region, substr(seq, a, b - a + 1) AS seq FROM ({_STRETCHES}) JOIN contigs USING (name)", "contigs")
register("faidx_reverse_complement", lambda s, d: X.fetch(contigs(s, d), _REGIONS, reverse=True, mark=True).select("region", "seq"),
    f"SELECT region || '/rc' AS region, reverse(translate(substr(seq, a, b - a + 1), 'ACGTacgt', 'TGCAtgca')) AS seq FROM ({_STRETCHES}) JOIN contigs USING (name)", "contigs")
register("faidx_wrap", lambda s, d: X.wrap(contigs(s, d), 70), "SELECT name, k::INT AS line, substr(seq, CAST(k * 70 + 1 AS INT), 70) AS text FROM (SELECT name, seq, unnest(range(0, (length(seq) - 1) // 70 + 1)) AS k FROM contigs)", "contigs")
register("sam_text", lambda s, d: X.sam_text(reads(s, d)),
    """SELECT src, ordinal, concat_ws(chr(9), qname, flag, coalesce(rname, '*'), coalesce(pos, 0), coalesce(mapq, 255), coalesce(cigar, '*'), CASE WHEN rnext IS NULL THEN '*' WHEN rnext = rname THEN '=' ELSE rnext END, coalesce(pnext, 0), tlen,
      coalesce(seq, '*'), coalesce(qual, '*'), CASE WHEN rg IS NOT NULL THEN concat('RG:Z:', rg) END, CASE WHEN bc IS NOT NULL THEN concat('BC:Z:', bc) END, CASE WHEN ms IS NOT NULL THEN concat('ms:i:', ms) END, concat('NM:i:', nm)) AS value FROM reads""", "reads")  # fmt: skip
register("import_fastq", lambda s, d: X.import_fastq(mates.to_fastq(reads(s, d)).where("route = 'pair'").select(F.xxhash64("qname").alias("ordinal"), (F.col("part") - 1).alias("part"), F.col("qname").alias("name"), F.lit("").alias("comment"), "seq", "qual"), paired=True).select("qname", "flag", "seq", "qual"),
    f"SELECT qname, CASE part WHEN 1 THEN 77 ELSE 141 END::INT AS flag, seq, qual FROM ({ORACLES['to_fastq']}) WHERE route = 'pair'")
