"""Reads, headers and intervals derived from the star-schema tables, as SQL that Spark and DuckDB read alike.

The test tables hold no alignments. These relations make a deterministic set of them from integers of lineitem, so
that every operator can run on any scale factor and be checked against an independent engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Integers first, so that both engines do the same exact arithmetic.
_BASE = """
SELECT l_orderkey AS o, l_partkey AS p, l_suppkey AS s, CAST(l_linenumber AS BIGINT) AS n, CAST(l_quantity AS BIGINT) AS q,
       l_returnflag AS r, ((l_orderkey * 8 + l_linenumber) * 100000000 + l_partkey * 100 + l_suppkey % 100) * 64 + CAST(l_quantity AS BIGINT) AS ordinal, l_orderkey * 31 + l_partkey * 7 + l_linenumber AS h
FROM lineitem"""

_FLAG = """
1 + CASE WHEN n % 2 = 1 THEN 64 ELSE 128 END + CASE WHEN h % 4 = 0 THEN 2 ELSE 0 END + CASE WHEN p % 37 = 0 THEN 4 ELSE 0 END
+ CASE WHEN h % 23 = 0 THEN 8 ELSE 0 END + CASE WHEN p % 2 = 0 THEN 16 ELSE 0 END + CASE WHEN h % 3 = 0 THEN 32 ELSE 0 END
+ CASE WHEN n = 5 THEN 256 ELSE 0 END + CASE WHEN h % 29 = 0 THEN 512 ELSE 0 END + CASE WHEN h % 31 = 0 THEN 1024 ELSE 0 END
+ CASE WHEN n = 6 THEN 2048 ELSE 0 END - CASE WHEN h % 17 = 0 THEN 1 + CASE WHEN n % 2 = 1 THEN 64 ELSE 128 END ELSE 0 END"""

_CIGAR = """CASE h % 6 WHEN 0 THEN '10M' WHEN 1 THEN '3S7M' WHEN 2 THEN '5M2D5M' WHEN 3 THEN '4M1I5M' WHEN 4 THEN '4M3N6M' ELSE '2H8M2S' END"""

#: Columns of READS but for the tags, and the tags' values as plain columns rg, bc, ms, nm.
READS_SQL = f"""
SELECT ordinal, CAST(o % 2 AS INT) AS src, concat('q', o) AS qname, CAST({_FLAG} AS INT) AS flag,
       CASE WHEN p % 74 = 0 THEN NULL ELSE CAST(s % 5 AS INT) END AS tid,
       CASE WHEN p % 74 = 0 THEN NULL ELSE concat('chr', s % 5 + 1) END AS rname,
       CASE WHEN p % 74 = 0 THEN NULL ELSE (h * 13) % 2000 + 1 END AS pos,
       CASE WHEN h % 41 = 0 THEN NULL ELSE CAST(q AS INT) END AS mapq,
       CASE WHEN p % 37 = 0 THEN NULL ELSE {_CIGAR} END AS cigar,
       CASE WHEN h % 19 = 0 THEN NULL ELSE CAST((s + CASE WHEN h % 5 = 0 THEN 1 ELSE 0 END) % 5 AS INT) END AS mtid,
       CASE WHEN h % 19 = 0 THEN NULL ELSE concat('chr', (s + CASE WHEN h % 5 = 0 THEN 1 ELSE 0 END) % 5 + 1) END AS rnext,
       CASE WHEN h % 19 = 0 THEN NULL ELSE (h * 17) % 2000 + 1 END AS pnext,
       (h * 11) % 1001 - 500 AS tlen,
       translate(lpad(CAST((p * 7919 + o * 104729 + n * 31) % 10000000000 AS VARCHAR(20)), 10, '7'), '0123456789', 'ACGTACGTNG') AS seq,
       CASE WHEN h % 43 = 0 THEN NULL ELSE translate(lpad(CAST((p * 15485863 + o * 32452843 + n * 7) % 10000000000 AS VARCHAR(20)), 10, '3'), '0123456789', '#+5?IS./:D') END AS qual,
       CASE WHEN o % 11 = 0 THEN NULL ELSE concat('rg', r) END AS rg,
       CASE WHEN h % 7 = 0 THEN NULL ELSE translate(lpad(CAST(h % 10000 AS VARCHAR(20)), 4, '0'), '0123456789', 'ACGTACGTAC') END AS bc,
       CASE WHEN h % 13 = 0 THEN NULL ELSE q END AS ms, p % 100 AS nm
FROM ({_BASE}) base"""

#: Five references with reads and one without.
HEADER_SQ_SQL = """
SELECT CAST(n_nationkey AS INT) AS tid, concat('chr', n_nationkey + 1) AS name, CAST(2100 AS BIGINT) AS length FROM nation WHERE n_nationkey < 6"""

HEADER_RG_SQL = """
SELECT DISTINCT concat('rg', l_returnflag) AS id, CASE WHEN l_returnflag = 'A' THEN 'lib1' ELSE 'lib2' END AS lb,
       CASE WHEN l_returnflag = 'R' THEN NULL ELSE concat('sm', l_returnflag) END AS sm FROM lineitem"""

#: Intervals that overlap here and there, one of them on the reference without reads.
BED_SQL = """
SELECT concat('chr', n_nationkey % 6 + 1) AS chrom, CAST((n_nationkey * 137) % 1900 AS BIGINT) AS start0,
       CAST((n_nationkey * 137) % 1900 + 20 + n_nationkey % 7 * 15 AS BIGINT) AS end0, concat('iv', n_nationkey) AS name FROM nation"""

#: One reference sequence of 2100 bases for each of the six, from a rule on the position.
REFERENCE_SQL_SPARK = """
SELECT concat('chr', c + 1) AS name, array_join(transform(sequence(1, 2100), x -> substr('ACGT', CAST((x * x + x * (c + 3) + c) % 4 + 1 AS INT), 1)), '') AS seq
FROM (SELECT explode(sequence(0, 5)) AS c)"""
REFERENCE_SQL_DUCKDB = """
SELECT concat('chr', c + 1) AS name, list_aggregate(list_transform(range(1, 2101), lambda x: substr('ACGT', CAST((x * x + x * (c + 3) + c) % 4 + 1 AS INT), 1)), 'string_agg', '') AS seq
FROM (SELECT unnest(range(0, 6)) AS c)"""


def _view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    return spark.sql(sql.replace("FROM lineitem", "FROM {lineitem}").replace("FROM nation", "FROM {nation}"), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def flat_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, READS_SQL, "lineitem")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The read records with their tags as a map."""
    names = {"rg": ("RG", "Z"), "bc": ("BC", "Z"), "ms": ("ms", "i"), "nm": ("NM", "i")}
    entries = [F.when(F.col(c).isNotNull(), F.struct(F.lit(t).alias("key"), F.struct(F.lit(k).alias("t"), F.col(c).cast("string").alias("v")).alias("value"))) for c, (t, k) in names.items()]
    present = F.array_compact(F.array(*entries))
    return flat_reads(spark, sf_dir).withColumns({"tags": F.map_from_entries(present), "tag_order": F.transform(present, lambda e: e["key"])}).drop(*names)


def close_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of templates whose first and second record overlap, 10 aligned bases each."""
    kept = reads(spark, sf_dir).where("cast(substr(qname, 2) as bigint) % 3 < 2 and flag & 2304 = 0")
    o = "cast(substr(qname, 2) as bigint)"
    chrom = f"concat('chr', {o} % 5 + 1)"
    return kept.withColumns({
        "rname": F.expr(chrom), "rnext": F.expr(chrom), "tid": F.expr(f"cast({o} % 5 as int)"), "mtid": F.expr(f"cast({o} % 5 as int)"), "cigar": F.lit("10M"),
        "pos": F.expr(f"({o} * 37) % 1900 + (ordinal % 7) + 1"), "pnext": F.expr(f"({o} * 37) % 1900 + 4"), "tlen": F.expr("cast(ordinal % 15 as bigint)"),
    })


def spread_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The placed reads over 150 million bases of their references, some across a gap of 20,000."""
    placed = reads(spark, sf_dir).where("rname is not null")
    return placed.withColumns({"pos": F.expr("(ordinal % 1000000007 * 7919) % 150000000 + 1"), "cigar": F.expr("if(ordinal % 50 = 0, '4M20000N6M', '10M')")})


def wide_header_sq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return header_sq(spark, sf_dir).withColumn("length", F.lit(150_100_000).cast("bigint"))


def header_sq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, HEADER_SQ_SQL, "nation")


def header_rg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, HEADER_RG_SQL, "lineitem")


def bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, BED_SQL, "nation")


def reference(spark: SparkSession) -> DataFrame:
    return spark.sql(REFERENCE_SQL_SPARK)


#: Short sequences with a name each, one of every part: bases from the letters of its descriptions, some in small letters.
CONTIGS_SQL = """
SELECT concat('part', p_partkey) AS name, CASE WHEN p_partkey % 5 = 0 THEN lower(bases) ELSE bases END AS seq
FROM (SELECT p_partkey, repeat(translate(lower(concat(p_name, p_type, p_brand, p_size)), 'abcdefghijklmnopqrstuvwxyz #0123456789', 'ACGTACGTTGCATTGACCGTAGGCATNTACGTTACGATC'), CAST(3 + p_partkey % 7 AS INT)) AS bases FROM part) b"""


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CONTIGS_SQL.replace("FROM part", "FROM {part}"), part=spark.read.parquet(f"{sf_dir}/part.parquet"))


#: Primers of five amplicons on each of five references.
PRIMERS_SQL = """
SELECT concat('chr', n_nationkey % 5 + 1) AS chrom, CAST((n_nationkey - n_nationkey % 5) * 60 AS BIGINT) AS start0, CAST((n_nationkey - n_nationkey % 5) * 60 + 25 AS BIGINT) AS end0, '+' AS strand FROM nation
UNION ALL SELECT concat('chr', n_nationkey % 5 + 1), CAST((n_nationkey - n_nationkey % 5) * 60 + 225 AS BIGINT), CAST((n_nationkey - n_nationkey % 5) * 60 + 250 AS BIGINT), '-' FROM nation"""


def primers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, PRIMERS_SQL, "nation")
