"""Queries against their DuckDB twins on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from alnspark.plans.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
CHOSEN = [
    "flagstat", "idxstats", "view_expr_tag", "view_bed", "view_regions", "cigar_metrics", "depth", "coverage", "bedcov", "sort_name_natural", "sort_tag", "fixmate", "to_fastq", "markdup",
    "markdup_metrics", "reset", "stats_summary", "stats_gc_content", "stats_indels_by_cycle", "stats_insert_sizes", "amplicon_reads", "primer_clips", "consensus", "mpileup_depth", "calmd_nm", "reference_from_md", "sam_text", "dict", "faidx_wrap",
    "mpileup", "mpileup_inputs", "mpileup_all_positions", "view_expr_precedence", "view_expr_library", "checksum_counts", "stats_mismatches_by_cycle", "stats_read_bases_by_cycle",
    "consensus_ambiguous", "consensus_text", "calmd", "calmd_masked", "reference_text", "stats_trimmed_bases", "fixmate_template_cigar", "sort_template_coordinate", "markdup_sequence_mode",
    "markdup_remove_barcode", "rmdup_paired", "markdup_optical", "header_groups", "header_references", "matching_references", "name_hash", "view_validated", "original_alignment", "fastq_counts", "fastq_tag_filters",
    "stats_barcode_bases", "stats_barcode_qualities", "header_order", "merge_inputs", "merge_inputs_combined", "merge_inputs_groups",
    "fastq_payload", "fastq_copied_tags", "primer_clip_counts", "markdup_barcode_pattern", "markdup_counts", "markdup_flags",
    "view_subsample", "import_fastq", "markdup_chains", "markdup_chain_counts", "mpileup_merged_mates", "stats_bases_once", "stats_coverage_once", "amplicon_template_depth",
    "consensus_columns", "consensus_fastq", "consensus_over_reference", "consensus_bayesian", "write_bam", "view_regions_indexed", "sort_written_order",
]


def same(v):
    return round(v, 6) if isinstance(v, float) else int(v) if isinstance(v, bool) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{DATA}/{t}'")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_twin(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    found = duck.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(same(row[columns.index(c)]) for c in df.columns) for row in found.fetchall()), key=repr)
    assert sorted((tuple(same(v) for v in r) for r in df.collect()), key=repr) == want


def test_checksums_depend_on_no_order(spark):
    from alnspark.operators import checksum
    from alnspark.plans.derive import reads

    df = reads(spark, DATA)
    rows = lambda x: sorted(map(repr, x.collect()))
    whole = checksum.checksum(df)
    assert rows(whole) == rows(checksum.checksum(df.repartition(7)))
    parts = checksum.checksum(df.where("src = 0")).union(checksum.checksum(df.where("src = 1")))
    assert rows(checksum.merge_checksums(parts)) == rows(whole)


def test_every_query_is_registered_once():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert set(QUERIES) <= set(names) and set(__spark_entry__.oracle_sql()) <= set(names)
    assert len(QUERIES) > 100


def test_validation_fails_on_bad_input(spark):
    from alnspark.operators.filters import validated
    from alnspark.plans.derive import header_sq, reads

    some, sq = reads(spark, DATA).where("cigar is not null").limit(3), header_sq(spark, DATA)
    with pytest.raises(Exception, match="invalid CIGAR"):
        validated(some.withColumn("cigar", F.lit("10Q")), sq).collect()
    with pytest.raises(Exception, match="no SQ lines"):
        validated(some, sq.where("tid < 0")).collect()
    assert validated(some.withColumns({"cigar": F.lit(None).cast("string"), "rname": F.lit(None).cast("string")}), sq.where("tid < 0")).count() == 3


def test_name_hash_is_the_published_one(spark):
    from alnspark.functions.hashes import x31

    names = ["", "a", "read:1:2", "x" * 40]

    def whole(s):
        h = 0
        for b in s.encode():
            h = (h * 31 + b) % 2**32
        return h

    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", x31(F.col("n")).alias("h")).collect()
    assert {r["n"]: r["h"] for r in got} == {n: whole(n) for n in names}


def test_fnv_is_the_published_one(spark):
    from alnspark.functions.hashes import fnv1a

    def whole(s, seed):
        h, m = 14695981039346656037 ^ seed, 2**64
        for b in s.encode():
            h = (h ^ b) * 1099511628211 % m
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 % m
        h = (h ^ h >> 27) * 0x94D049BB133111EB % m
        return h ^ h >> 31

    names = ["", "a", "read:1:2", "é" * 40, "q4711"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for seed in (0, 42):
        got = {r["n"]: r["h"]["hi"] << 32 | r["h"]["lo"] for r in df.select("n", fnv1a(F.col("n"), seed).alias("h")).collect()}
        assert got == {n: whole(n, seed) for n in names}


def test_header_line_without_one():
    from alnspark.operators.sorts import header_line

    assert header_line(None, "name") == "@HD\tVN:1.6\tSO:queryname\tSS:queryname:natural"
