"""Small hand-checked inputs with the results that the operators must give."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from alnspark import sources
from alnspark.functions import flags as FL, tags as T
from alnspark.functions.expr import compile_filter
from alnspark.operators import counts, dedup, depth, fastx, filters, intervals, mates, multi, pileup, sorts, stats
from alnspark.schema import READS
from alnspark.sources.alignments import parse_header, parse_record


def sam(spark, *lines, refs=(("chr1", 2000),)):
    tids = {n: k for k, (n, _) in enumerate(refs)}
    return spark.createDataFrame([parse_record(x.replace(" ", "\t"), k, 0, tids) for k, x in enumerate(lines)], READS)


def header(spark, *refs):
    return spark.createDataFrame([(k, n, size) for k, (n, size) in enumerate(refs)], "tid int, name string, length bigint")


def at(df):
    return sorted((r.pos, r.depth) for r in df.collect())


@pytest.fixture(scope="module")
def masked(spark):
    return sam(spark, "normal 0 chr1 1 60 2M * 0 0 AA II", "dup 1024 chr1 2 60 2M * 0 0 AA II", "rev 16 chr1 4 60 2M * 0 0 AA II")


def test_depth_masks(masked):
    assert at(depth.depth(masked)) == [(1, 1), (2, 1), (4, 1), (5, 1)]
    assert at(depth.depth(masked, exclude=FL.DEPTH_MASK & ~FL.DUP)) == [(1, 1), (2, 2), (3, 1), (4, 1), (5, 1)]
    assert at(depth.depth(masked, exclude=FL.DEPTH_MASK & ~FL.DUP, include=FL.DUP)) == [(2, 1), (3, 1)]


def test_depth_read_length_and_deletions(spark):
    df = sam(spark, "short 0 chr1 1 60 2M * 0 0 AA II", "long 0 chr1 4 60 2M1I2M * 0 0 CCGTT IIIII")
    assert at(depth.depth(df, min_length=3)) == [(4, 1), (5, 1), (6, 1), (7, 1)]
    gap = sam(spark, "g 0 chr1 1 60 2M2D2M * 0 0 AAAA IIII")
    assert at(depth.depth(gap)) == [(1, 1), (2, 1), (3, 0), (4, 0), (5, 1), (6, 1)]
    assert at(depth.depth(gap, deletions=True)) == [(k, 1) for k in range(1, 7)]


def test_sweep_equals_explosion_across_bins(spark):
    df = sam(spark, *(f"r{k} 0 chr1 {16380 + k} 60 9M * 0 0 AAAAAAAAA IIIIIIIII" for k in range(12)), refs=(("chr1", 10**6),))
    b = depth.block_rows(df).select(F.explode(F.sequence(F.col("start0") + 1, F.col("end0"))).alias("pos")).groupBy("pos").count()
    assert at(depth.depth(df)) == sorted((r.pos, r["count"]) for r in b.collect())


def test_coverage_counts_missing_qualities_as_255(spark):
    df = sam(spark, "missing 0 chr1 1 60 4M * 0 0 ACGT *", "present 0 chr1 1 60 4M * 0 0 TGCA !!!!")
    r = depth.coverage(df, header(spark, ("chr1", 4))).first()
    assert (r.numreads, r.covbases, r.coverage, r.meandepth, r.meanbaseq, r.meanmapq) == (2, 4, 100, 2, 127.5, 60)


def test_bedcov(spark):
    bed = spark.createDataFrame([("chr1", 0, 4)], "chrom string, start0 bigint, end0 bigint")
    df = sam(spark, "normal 0 chr1 1 60 2M * 0 0 AA II", "dup 1024 chr1 2 60 2M * 0 0 AA II")
    assert depth.bedcov(df, bed).first().bases == 2
    assert depth.bedcov(df, bed, exclude=FL.DEPTH_MASK & ~FL.DUP).first().bases == 4
    wide = spark.createDataFrame([("chr1", 0, 6)], "chrom string, start0 bigint, end0 bigint")
    gaps = sam(spark, "d 0 chr1 1 60 2M2D2M * 0 0 AAAA IIII", "n 0 chr1 1 60 2M2N2M * 0 0 AAAA IIII")
    assert depth.bedcov(gaps, wide).first().bases == 12 and depth.bedcov(gaps, wide, skip_deletions=True).first().bases == 8
    two = sam(spark, "r1 0 chr1 1 60 4M * 0 0 AAAA IIII", "r2 0 chr1 3 30 4M * 0 0 AAAA IIII")
    r = depth.bedcov(two, spark.createDataFrame([("chr1", 2, 5)], "chrom string, start0 bigint, end0 bigint"), min_depth=2).first()
    assert (r.bases, r.deep, r.reads) == (5, 2, 2)


def test_insert_sizes_and_orientation(spark):
    rows = []
    for name, t, p in (("a", 100, 1), ("b", 100, 300), ("c", 900, 600)):
        rows += [f"{name} 99 chr1 {p} 60 10M = {p + t - 10} {t} AAAAAAAAAA IIIIIIIIII", f"{name} 147 chr1 {p + t - 10} 60 10M = {p} -{t} AAAAAAAAAA IIIIIIIIII"]
    r = stats.insert_size_summary(sam(spark, *rows), main_bulk=0.5).first()
    assert (r.mean, r.sd) == (100.0, 0.0)
    ways = sam(spark, "a 83 chr1 1 60 10M = 91 100 AAAAAAAAAA IIIIIIIIII", "a 163 chr1 91 60 10M = 1 -100 AAAAAAAAAA IIIIIIIIII", "b 65 chr1 1 60 10M = 91 100 AAAAAAAAAA IIIIIIIIII", "b 129 chr1 91 60 10M = 1 -100 AAAAAAAAAA IIIIIIIIII")
    m = {r.metric: r.value for r in stats.summary(ways).collect()}
    assert (m["inward oriented pairs"], m["outward oriented pairs"], m["pairs with other orientation"]) == (0, 1, 1)


def test_sorts(spark):
    names = lambda df: [r.qname for r in df.collect()]
    df = sam(spark, "high 0 chr1 1 60 1M * 0 0 A I AS:i:10", "low2 0 chr1 3 60 1M * 0 0 A I AS:i:2", "missing 0 chr1 2 60 1M * 0 0 A I", "low1 0 chr1 1 60 1M * 0 0 A I AS:i:2")
    assert names(sorts.sort(df, tag="AS")) == ["missing", "low1", "low2", "high"]
    groups = sam(spark, "z 0 chr1 1 60 1M * 0 0 A I RG:Z:g", "b 0 chr1 2 60 1M * 0 0 A I", "a 0 chr1 3 60 1M * 0 0 A I RG:Z:g")
    assert names(sorts.sort(groups, "name", tag="RG")) == ["b", "a", "z"]
    natural = sam(spark, *(f"{n} 4 * 0 0 * * 0 0 A I" for n in ("x10", "x7", "x07b", "x", "y1", "x1:2")))
    assert names(sorts.sort(natural, "name")) == ["x", "x1:2", "x7", "x07b", "x10", "y1"]
    a, b = sam(spark, "x10 0 chr1 1 60 1M * 0 0 A I"), sam(spark, "x7 0 chr1 1 60 1M * 0 0 A I")
    assert names(sorts.merge([a, b])) == ["x10", "x7"] and names(sorts.merge([a, b], "name")) == ["x7", "x10"]
    with pytest.raises(Exception, match="differ in length"):
        multi.merge_headers([header(spark, ("chr1", 5)), header(spark, ("chr1", 6))]).collect()


def test_fixmate(spark):
    far = sam(spark, "p 99 ref1 10000000010 60 23M = 10000000008 0 * *", "p 147 ref1 10000000008 60 23M = 10000000010 0 * *", refs=(("ref1", 10000000100),))
    assert [r.tlen for r in mates.fixmate(far).orderBy("ordinal").collect()] == [21, -21]
    pair = sam(spark, "p 65 chr1 1 60 4M * 0 0 ACGT IIII ms:i:1", "p 129 chr1 5 60 4M * 0 0 ACGT 5555")
    fixed = mates.fixmate(pair, scores=True).orderBy("ordinal").select(T.value("ms").alias("ms"), "tag_order", T.value("MC").alias("mc")).collect()
    assert [r.ms for r in fixed] == ["80", "160"] and fixed[0].tag_order == ["MQ", "MC", "ms"] and fixed[0].mc == "4M"


def test_rmdup(spark):
    one = sam(spark, "low 0 chr1 1 10 4M * 0 0 ACGT IIII", "high 0 chr1 1 60 4M * 0 0 ACGT IIII", "reverse 16 chr1 1 30 4M * 0 0 ACGT IIII", "unmapped 4 * 0 0 * * 0 0 ACGT IIII")
    assert {r.qname for r in dedup.rmdup(one, single_end=True).collect()} == {"high", "reverse", "unmapped"}
    two = []
    for name, q, p in (("a", 60, 1), ("b", 10, 1), ("c", 10, 2)):
        two += [f"{name} 99 chr1 {p} {q} 4M = 91 94 ACGT IIII", f"{name} 147 chr1 91 {q} 4M = {p} -94 ACGT IIII"]
    assert {r.qname for r in dedup.rmdup(sam(spark, *two)).collect()} == {"a", "c"}


def test_library_size():
    assert [dedup.library_size(*x) for x in ((10, 4, 0), (14, 6, 0), (10, 8, 2), (6, 4, 4))] == [4, 5, 1, 0]


def test_fastq(spark):
    df = sam(spark, "pair 65 chr1 1 60 4M * 0 0 ACGT !!!!", "pair 129 chr1 5 60 4M * 0 0 TGCA ####", "solo 4 * 0 0 * * 0 0 NNNN IIII")
    out = {(r.qname, r.part): (r.route, r.seq, r.qual) for r in mates.to_fastq(df).collect()}
    assert out == {("pair", 1): ("pair", "ACGT", "!!!!"), ("pair", 2): ("pair", "TGCA", "####"), ("solo", 0): ("other", "NNNN", "IIII")}


def test_reference_and_md(spark):
    md = sam(spark, "r1 0 chr1 1 60 4M1D4M * 0 0 ACGTTGCA * MD:Z:4^A4")
    assert [r.text for r in pileup.reference_text(pileup.reference_from_md(md), header(spark, ("chr1", 12))).collect()] == ["ACGTATGCANNN"]
    ref = spark.createDataFrame([("chr1", "ACGTACGTACGT")], "name string, seq string")
    r = pileup.md_nm(sam(spark, "r1 0 chr1 1 60 4M1I2M1D2M * 0 0 ACGTTCGAC *"), ref).first()
    assert (r.nm, r.md) == (6, "4A0C0^G0T0A0")
    binned = pileup.calmd(sam(spark, "r1 0 chr1 1 60 8M * 0 0 ACGTTCGT !+5?IS]g"), spark.createDataFrame([("chr1", "ACGTACGT")], "name string, seq string"), bin_qualities=True)
    row = binned.select("qual", T.value("NM").alias("nm"), T.value("MD").alias("md")).first()
    assert (row.qual, row.nm, row.md) == ("!2<FPZdn", "1", "4A3")


def test_view_filters(spark):
    df = sam(spark, "a 0 chr1 1 60 4M * 0 0 ACGT IIII RG:Z:grp1 NM:i:0", "b 0 chr1 2 60 4M * 0 0 ACGT IIII RG:Z:grp2 NM:i:1", "c 0 chr1 3 5 4M * 0 0 ACGT IIII RG:Z:grp3 NM:i:2", "d 0 chr1 4 60 4M * 0 0 ACGT IIII")
    names = lambda x: "".join(sorted(r.qname for r in x.collect()))
    assert names(filters.by_read_group(df, ["grp2"])) == "bd" and names(filters.by_read_group(df, ["grp1", "grp3"])) == "acd"
    assert names(filters.by_tag(df, "NM")) == "abc" and names(filters.by_tag(df, "NM", ["1"])) == "b"
    groups = spark.createDataFrame([("grp1", "libA"), ("grp2", "libB"), ("grp3", "libA")], "id string, lb string")
    assert [filters.by_library(df, groups, x).count() for x in ("libA", "libB", "libZ")] == [2, 1, 0]
    for text, want in (("mapq >= 20", "abd"), ("[NM] >= 1", "bc"), ("[NM]", "abc"), ("![NM]", "d"), ('rname =~ "chr" && pos % 2 == 0', "bd"), ("qlen == 4 && (flag & 4) == 0 && [RG] != \"grp1\"", "bc"), ("min(qual) == 40", "abcd"), ("exists([NM]) && -pos < -2", "c")):
        assert names(df.where(compile_filter(text))) == want, text
    for bad in ("mapq >=", "nope == 1", "(mapq", "a @ b"):
        with pytest.raises(ValueError):
            compile_filter(bad)


def test_flags(spark):
    assert FL.parse_flags("0xFFF") == 4095 and FL.parse_flags("paired,READ1") == 65 and FL.parse_flags("020") == 16
    with pytest.raises(ValueError):
        FL.parse_flags("NOPE")
    assert spark.range(1).select(FL.flags_report(F.lit(65)).alias("x")).first().x == "0x41\t65\tPAIRED,READ1"


def test_bed_lines(spark, tmp_path):
    (tmp_path / "x.bed").write_text("chr1 9 20 name\nchr1 20\nchr1\t20\t20\ntrack name=x\n\tchr1 1 2\n# no\n\n")
    assert sorted((r.start0, r.end0) for r in sources.read_bed(spark, str(tmp_path / "x.bed")).collect()) == [(9, 20), (19, 20)]
    assert intervals.parse_region("chr1:1,000-2,000") == ("chr1", 999, 2000)


def test_flagstat_adds_up(spark, masked):
    other = sam(spark, "x 4 * 0 0 * * 0 0 A I", "y 77 * 0 0 * * 0 0 A I")
    total = lambda df: {r.category: r.passed + r.failed for r in counts.flagstat(df).collect()}
    a, b, c = total(masked), total(other), total(masked.union(other))
    assert all(c[k] == a[k] + b[k] for k in c)


def test_sources_round_trip(spark, tmp_path):
    sources.register(spark)
    lines = ["@HD\tVN:1.6", "@SQ\tSN:chr1\tLN:100", "@SQ\tSN:chr2\tLN:50", "@CO\tsome text"]
    body = [f"r{k}\t{16 * (k % 2)}\tchr{k % 2 + 1}\t{k + 1}\t60\t4M\t=\t{k + 2}\t0\tACGT\tIIII\tNM:i:{k}\tXX:Z:a:b" for k in range(200)] + ["u\t4\t*\t0\t255\t*\t*\t0\t0\t*\t*"]
    (tmp_path / "x.sam").write_text("\n".join([*lines, *body]) + "\n")
    for split in (100, 1000, 1 << 20):
        df = spark.read.format("sam").option("splitbytes", split).load(str(tmp_path / "x.sam"))
        assert [r.value for r in fastx.sam_text(df).orderBy("ordinal").collect()] == body
    assert parse_header("\n".join(lines))["SQ"][1] == {"SN": "chr2", "LN": "50"}
    (tmp_path / "x.fa").write_text(">one first\nACGTAC\nGT\n>two\nNNNN\n")
    fa = spark.read.format("fasta").load(str(tmp_path / "x.fa"))
    assert [(r.name, r.seq, r.length, r.offset, r.linebases, r.linewidth) for r in fa.collect()] == [("one", "ACGTACGT", 8, 11, 6, 7), ("two", "NNNN", 4, 26, 4, 5)]
    (tmp_path / "x.fq").write_text("@a/1 c\nACGT\n+\n@@@@\n@b/1\nAA\n+b\nII\n")
    fq = spark.read.format("fastq").load(str(tmp_path / "x.fq"))
    assert [(r.name, r.comment, r.seq, r.qual) for r in fq.collect()] == [("a/1", "c", "ACGT", "@@@@"), ("b/1", "", "AA", "II")]
    assert [r.flag for r in fastx.import_fastq(fq, interleaved=True).orderBy("ordinal").collect()] == [77, 141]


def test_bam(spark, tmp_path):
    import gzip
    import struct

    name, seq = b"r1\0", "ACGTN"
    packed = bytes([0x12, 0x48, 0xF0])
    tags = b"NMC\x03" + b"RGZgrp\0" + b"XBBs\x02\0\0\0\x01\0\xff\xff" + b"XFf" + struct.pack("<f", 1.5)
    rec = struct.pack("<iiBBHHHiiii", 0, 9, len(name), 60, 0, 2, 16, 5, -1, -1, 0) + name + struct.pack("<2I", 3 << 4, 2 << 4 | 4) + packed + bytes([30] * 5) + tags
    data = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 100) + struct.pack("<i", len(rec)) + rec
    from alnspark.sources.sequences import BGZF_END, quickcheck

    (tmp_path / "x.bam").write_bytes(gzip.compress(data) + BGZF_END)
    (tmp_path / "cut.bam").write_bytes(gzip.compress(data))
    sources.register(spark)
    r = spark.read.format("bam").load(str(tmp_path / "x.bam")).first()
    assert (r.qname, r.flag, r.rname, r.pos, r.mapq, r.cigar, r.seq, r.qual) == ("r1", 16, "chr1", 10, 60, "3M2S", seq, "?" * 5)
    assert {k: (v.t, v.v) for k, v in r.tags.items()} == {"NM": ("i", "3"), "RG": ("Z", "grp"), "XB": ("B", "s,1,-1"), "XF": ("f", "1.5")}
    assert quickcheck(str(tmp_path / "x.bam")) == 0 and quickcheck(str(tmp_path / "cut.bam")) == 16 and quickcheck(str(tmp_path / "none")) == 2


def test_flagstat_stream(spark, masked, tmp_path):
    from alnspark.streaming.counts import flagstat_stream, read_stream

    masked.write.parquet(str(tmp_path / "in"))
    q = flagstat_stream(read_stream(spark, str(tmp_path / "in")), "seen")
    q.processAllAvailable()
    q.stop()
    assert {r.category: r.passed for r in spark.table("seen").collect()}["total"] == 3


def test_target_segments(spark):
    from alnspark.operators import models

    size = 2600
    df = sam(spark, f"r1 0 chr1 1 60 {size}M * 0 0 {'A' * size} {'I' * size}", refs=(("chr1", size),))
    assert [tuple(r) for r in models.target_segments(df, header(spark, ("chr1", size))).collect()] == [("chr1", 1, size, "A" * size)]
    short = sam(spark, f"r1 0 chr1 1001 60 200M * 0 0 {'A' * 200} {'I' * 200}", refs=(("chr1", size),))
    assert models.target_segments(short, header(spark, ("chr1", size))).count() == 0


def test_phase(spark):
    from alnspark.operators import models

    rows = [f"a{k} 0 chr1 1 60 12M * 0 0 AAAAAACCCCCC IIIIIIIIIIII" for k in range(4)] + [f"b{k} 0 chr1 1 60 12M * 0 0 CCCCCCAAAAAA IIIIIIIIIIII" for k in range(4)]
    found = models.phase(sam(spark, *rows), least_lod=30).orderBy("pos").collect()
    assert len(found) == 12 and {r.block for r in found} == {1} and all(r.against == 0 for r in found)
    assert "".join(r["first"] for r in found) in ("AAAAAACCCCCC", "CCCCCCAAAAAA")
    assert models.phase(sam(spark, *rows), least_lod=30, min_base_quality=50).count() == 0
    call = {r.pos: r.call for r in bayes(sam(spark, *rows)).collect()}
    assert set(call.values()) == {"M"}


def bayes(df):
    from alnspark.operators import assembly

    return assembly.bayesian(assembly.columns(df), ambiguous=True)


def test_bayesian_consensus_takes_all_records_and_gaps(spark):
    deep = [f"r{k} 0 chr1 1 60 4M * 0 0 {'AACC' if k % 2 else 'CACC'} IIII" for k in range(510)]  # each second one has another base
    found = {r.pos: r for r in bayes(sam(spark, *deep)).collect()}
    assert found[1].call == "M" and found[2].call == "A" and {r.depth for r in found.values()} == {510}
    gone = [f"d{k} 0 chr1 1 60 4M2D4M * 0 0 ACGTACGT IIIIIIII" for k in range(10)]
    there = [f"e{k} 0 chr1 1 60 10M * 0 0 ACGTGGACGT IIIIIIIIII" for k in range(10)]
    call = lambda rows: "".join(r.call for r in bayes(sam(spark, *rows)).orderBy("pos").collect())
    assert call(gone) == "ACGT**ACGT" and call(there) == "ACGTGGACGT" and call(gone + there) == "ACGTggACGT"
    assert call(["n 0 chr1 1 60 2M * 0 0 NN II"]) == "**"  # nothing was seen


def test_depad(spark):
    from alnspark.operators import models

    padded = spark.createDataFrame([("chr1", "AC**GTAC")], "name string, seq string")
    df = sam(spark, "r1 0 chr1 1 60 8M * 0 0 ACTTGTAC IIIIIIII", "r2 0 chr1 5 60 4M * 0 0 GTAC IIII", "r3 0 chr1 1 60 2M2D4M * 0 0 ACGTAC IIIIII")
    assert [(r.pos, r.cigar) for r in models.depad(df, padded).orderBy("ordinal").collect()] == [(1, "2M2I4M"), (3, "4M"), (1, "2M2P4M")]


def test_clipping(spark):
    from alnspark.operators import amplicon

    primers = spark.createDataFrame([("chr1", 0, 5, "+"), ("chr1", 15, 20, "-")], "chrom string, start0 bigint, end0 bigint, strand string")
    df = sam(spark, "f 0 chr1 3 60 10M * 0 0 ACGTACGTAC IIIIIIIIII NM:i:0", "r 16 chr1 11 60 10M * 0 0 ACGTACGTAC IIIIIIIIII", "in 0 chr1 8 60 5M * 0 0 ACGTA IIIII", "all 0 chr1 1 60 4M * 0 0 ACGT IIII")
    soft = {r.qname: (r.pos, r.cigar, r.flag, r.tag_order) for r in amplicon.clip(df, primers).collect()}
    assert soft["f"] == (6, "3S7M", 0, []) and soft["r"] == (11, "5M5S", 16, []) and soft["in"][1] == "5M" and soft["all"][1:3] == (None, 4)
    hard = {r.qname: (r.cigar, r.seq) for r in amplicon.clip(df, primers, hard=True).collect()}
    assert hard["f"] == ("3H7M", "TACGTAC") and hard["r"] == ("5M5H", "ACGTA")


def test_trimming(spark):
    def brute(q, reverse, threshold):
        if len(q) < 35:
            return 0
        total = most = at = 0
        for k in range(len(q) - 34):
            total += threshold - (q[k] if reverse else q[-1 - k])
            if total < 0:
                break
            if total > most:
                most, at = total, k
        return at

    cases = [[30] * 40 + [2] * 12, [2] * 10 + [35] * 40, [30] * 20, [20, 5, 35, 3] * 15]
    rows = [("".join(chr(33 + x) for x in q), r) for q in cases for r in (False, True)]
    found = spark.createDataFrame(rows, "qual string, r boolean").select(stats.trimmed(F.col("qual"), F.col("r"), 20).alias("n"))
    assert [x.n for x in found.collect()] == [brute(q, r, 20) for q in cases for r in (False, True)]


def test_optical_duplicates(spark):
    rows = []
    for k, place in enumerate(("1:10:10", "1:60:60", "1:900:900", "2:10:10")):
        rows += [f"m:1:f:1:{place} 99 chr1 100 60 4M = 200 104 ACGT II{'I' * (k == 0)}{'5' * (k != 0)}I MC:Z:4M", f"m:1:f:1:{place} 147 chr1 200 60 4M = 100 -104 ACGT IIII MC:Z:4M"]
    df = sam(spark, *rows)
    by = {(r.qname, r.flag): None for r in df.collect()}
    assert len(by) == 8
    found = df.join(dedup.optical(df, 100), ["src", "ordinal"]).collect()
    assert {r.qname[8:] for r in found if r.flag == 99 and r.optical} == {"1:60:60"}
    assert {r.qname[8:] for r in found if r.flag == 99} == {"1:60:60", "1:900:900", "2:10:10"}


def test_renamed_ids():
    new = multi.rename_ids({"a"}, ["a", "b"])
    assert new["b"] == "b" and new["a"].startswith("a-") and len(new["a"]) == 10


def test_filter_precedence_and_library(spark):
    from alnspark.functions.expr import compile_filter

    df = sam(spark, "a 4 * 0 0 * * 0 0 A I RG:Z:g1", "b 16 chr1 1 9 1M * 0 0 A I RG:Z:g2", "c 0 chr1 1 9 1M * 0 0 A I")
    got = lambda e: [r.qname for r in df.where(compile_filter(e, {"g1": "one", "g2": "two"})).orderBy("qname").collect()]
    assert got("flag & 4 == 4") == ["a"] and got("flag & 20 == 16") == ["b"] and got("1 | 2 == 3 && flag == 0") == ["c"]
    assert got('library == "two"') == ["b"] and got('library == ""') == ["c"]


def test_region_bounds_reach_the_scan(spark, tmp_path, capsys):
    from alnspark.operators import filters

    sam(spark, "a 0 chr1 1 60 4M * 0 0 ACGT IIII", "b 0 chr1 90 60 4M20N4M * 0 0 ACGTACGT IIIIIIII", "c 0 chr2 5 60 4M * 0 0 ACGT IIII").write.parquet(str(tmp_path / "x"))
    df = spark.read.parquet(str(tmp_path / "x"))
    found = filters.by_regions(df, ["chr1:100-120"], longest=40)
    assert [r.qname for r in found.collect()] == ["b"]
    found.explain("formatted")
    plan = capsys.readouterr().out
    assert "LessThanOrEqual(pos,120)" in plan and "GreaterThan(pos,59)" in plan and "EqualTo(rname,chr1)" in plan


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_stretches_of_a_reference(spark, monkeypatch, most):
    from alnspark.operators import reference as R

    monkeypatch.setattr(R, "CHUNK", 10)
    monkeypatch.setattr(R, "BROADCAST_BASES", most)
    seq = "".join("ACGT"[(k * k + k // 7) % 4] for k in range(95))
    spans = [(a, b) for a in (0, 3, 9, 10, 38, 90) for b in (a + 1, a + 7, a + 12, 95) if b <= 95]
    df = spark.createDataFrame([("chr1", a, b, 0, k) for k, (a, b) in enumerate(spans)] + [("none", 0, 5, 0, 99)], "chrom string, start0 bigint, end0 bigint, src int, ordinal bigint")
    found = R.with_stretch(df, spark.createDataFrame([("chr1", seq)], "name string, seq string")).collect()
    assert sorted((r.start0, r.end0, r.stretch) for r in found) == sorted((a, b, seq[a:b]) for a, b in spans)


def test_genotype_costs_one_by_one():
    import numpy as np

    from alnspark.operators import models

    rng = np.random.default_rng(4)
    weight, beta, het = models.error_model()

    def by_hand(reads):  # (base, strand, quality), best first
        total, count, seen = [0.0] * 4, [0] * 4, {}
        for b, r, q in sorted(reads, key=lambda e: (-e[2], e[1], e[0])):
            cost = beta[q, len(reads), count[b]]
            total[b] += weight[seen.get((b, r), 0)] * (cost if np.isfinite(cost) else 0)
            count[b] += 1
            seen[b, r] = seen.get((b, r), 0) + 1
        all_ = sum(total)
        return [[all_ - total[i] if i == j else max(0.0, all_ - total[i] - total[j] - 10 / np.log(10) * het[count[i] + count[j], count[max(i, j)]]) for j in range(4)] for i in range(4)]

    rows, want = [], []
    for c in range(6):
        reads = [(int(rng.integers(4)), int(rng.integers(2)), int(rng.integers(4, 41))) for _ in range(int(rng.integers(1, 60)))]
        want.append(by_hand(reads))
        rows += [(c, *k, reads.count(k)) for k in set(reads)]
    assert np.allclose(models.genotype_costs(*map(np.array, zip(*rows, strict=True))), want)
    deep = models.genotype_costs(np.zeros(2, int), np.array([0, 1]), np.zeros(2, int), np.array([30, 30]), np.array([3000, 1000]))
    assert deep.shape == (1, 4, 4) and np.isfinite(deep).all() and (deep == deep.swapaxes(1, 2)).all() and deep[0, 0, 0] < deep[0, 1, 1]
    # without a limit the formulas go on beyond the table
    q, n = 30, 400
    whole = models.genotype_costs(np.zeros(2, int), np.array([0, 1]), np.zeros(2, int), np.array([q, q]), np.array([300, 100]), None)
    assert models.tail_costs(q, 200)[:200] == pytest.approx(beta[q, 200, :200])
    tail = models.tail_costs(q, n)
    cost = lambda k: sum(models.error_model()[0][min(j, 255)] * tail[j] for j in range(k))
    assert whole[0, 0, 0] == pytest.approx(cost(100)) and whole[0, 1, 1] == pytest.approx(cost(300))
    few = models.genotype_costs(np.zeros(2, int), np.array([0, 1]), np.zeros(2, int), np.array([q, q]), np.array([150, 50]), None)
    assert np.allclose(few, models.genotype_costs(np.zeros(2, int), np.array([0, 1]), np.zeros(2, int), np.array([q, q]), np.array([150, 50])))


def test_phase_goes_on_over_a_site_that_templates_skip(spark):
    from alnspark.operators import models

    # at position 2 all that join 1 and 3 have a third base
    rows = [f"a{k} 0 chr1 1 60 3M * 0 0 AGC III" for k in range(4)] + [f"b{k} 0 chr1 1 60 3M * 0 0 CGA III" for k in range(4)]
    rows += [f"x{k} 0 chr1 2 60 1M * 0 0 {'TC'[k % 2]} I" for k in range(40)]
    found = {r.pos: r for r in models.phase(sam(spark, *rows), least_lod=5).collect()}
    assert found[1].block == found[3].block == 1 and found[3].support == 8
    assert {(found[1]["first"], found[3]["first"])} <= {("A", "C"), ("C", "A")}


def test_checksum_of_a_group_called_all(spark):
    from alnspark.operators import checksum

    df = sam(spark, "a 0 chr1 1 60 1M * 0 0 A I RG:Z:all", "b 512 chr1 1 60 1M * 0 0 C I RG:Z:g", "c 0 chr1 1 60 1M * 0 0 G I")
    whole = checksum.checksum(df)
    assert {(r.scope, r.group): r.n for r in whole.collect()} == {("group", "all"): 1, ("group", "g"): 1, ("group", None): 1, ("all", None): 3, ("pass", None): 2, ("fail", None): 1}
    again = checksum.merge_checksums(checksum.checksum(df.limit(1)).union(checksum.checksum(df.where("qname <> 'a'"))))
    assert {(r.scope, r.group): r.n for r in again.collect()} == {(r.scope, r.group): r.n for r in whole.collect()}


def bam_bytes(records, block, refs=(("chr1", 2000), ("chr2", 2000))):
    """A BAM file of these SAM lines in blocks of so many bytes each."""
    import struct
    import zlib

    from alnspark.sources.alignments import BASES, OPS

    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", len(refs)) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in refs)
    body = b""
    for name, flag, tid, pos, cigar, seq in records:
        codes = [BASES.index(c) for c in seq + "=" * (len(seq) % 2)]
        rest = name.encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | OPS.index(k)) for n, k in cigar) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True)) + bytes([30] * len(seq)) + b"RGZg\0"
        rec = struct.pack("<iiBBHHHiiii", tid, pos - 1, len(name) + 1, 60, 0, len(cigar), flag, len(seq), -1, -1, 0) + rest
        body += struct.pack("<i", len(rec)) + rec
    data, out = head + body, b""
    for k in range(0, len(data), block):
        part = data[k : k + block]
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        packed = z.compress(part) + z.flush()
        out += b"\x1f\x8b\x08\x04" + b"\0" * 5 + b"\xff\x06\0BC\x02\0" + struct.pack("<H", len(packed) + 25) + packed + struct.pack("<II", zlib.crc32(part), len(part))
    from alnspark.sources.sequences import BGZF_END

    return out + BGZF_END


@pytest.mark.parametrize("block", [150, 1000, 60000])
def test_bam_by_ranges_of_blocks(spark, tmp_path, block):
    records = [(f"read{k}", 16 * (k % 2), k % 2, k + 1, [(3 + k % 50, "M"), (2, "S")], "ACGTN"[k % 5] * (5 + k % 50)) for k in range(300)] + [("long", 0, 1, 5, [(5000, "M")], "A" * 5000)] + [("x", 0, 1, 9, [(1, "M")], "C")]
    data = bam_bytes(records, block)
    (tmp_path / "x.bam").write_bytes(data)
    sources.register(spark)
    for split in (400, 3000, 10**8):
        df = spark.read.format("bam").option("splitBytes", split).load(str(tmp_path / "x.bam"))
        got = df.orderBy("ordinal").collect()
        assert [(r.qname, r.flag, r.rname, r.pos, r.cigar, r.seq) for r in got] == [(n, f, f"chr{t + 1}", p, "".join(f"{a}{b}" for a, b in c), s) for n, f, t, p, c, s in records]
        assert df.rdd.getNumPartitions() == -(-len(data) // split)
    with pytest.raises(Exception, match="cut|BGZF|incomplete"):
        (tmp_path / "y.bam").write_bytes(data[: len(data) // 2])
        spark.read.format("bam").load(str(tmp_path / "y.bam")).collect()


def test_bam_ranges_fail_rather_than_guess_wrong():
    from alnspark.sources import alignments as A

    reader = A.BamReader({"path": "none"})
    reader._start = lambda *_: None
    with pytest.raises(ValueError, match="splitBytes"):
        import tempfile

        with tempfile.NamedTemporaryFile(suffix=".bam") as f:
            f.write(bam_bytes([(f"r{k}", 0, 0, k + 1, [(4, "M")], "ACGT") for k in range(200)], 300))
            f.flush()
            list(reader.read(A._Range(f.name, 0, 0, 500)))


def test_checksum_fields_by_hand(spark):
    import struct
    import zlib

    from alnspark.operators import checksum

    df = sam(spark, "a 67 chr1 7 60 2M1S = 20 0 ACG III", "b 4 * 0 255 * * 0 0 ACG III")
    rows = {r.scope: r for r in checksum.checksum(df, position=True, cigar=True, mate=True).collect()}
    product = lambda *crcs: crcs[0] % checksum.PRIME * (crcs[1] % checksum.PRIME) % checksum.PRIME
    crc = lambda flag, rest: zlib.crc32(bytes([flag & 193]) + b"ACG" + rest) & checksum.PRIME
    assert rows["all"].pos == product(crc(67, struct.pack("<iq", 0, 6)), crc(4, struct.pack("<iq", -1, -1)))
    assert rows["all"].mate == product(crc(67, struct.pack("<iq", 0, 19)), crc(4, struct.pack("<iq", -1, -1)))
    assert rows["all"].cigar == product(crc(67, struct.pack("<III", 60, 2 << 4, 1 << 4 | 4)), crc(4, struct.pack("<I", 255)))
    assert {r.scope for r in checksum.combined(checksum.checksum(df, position=True)).collect()} == set(rows)
    assert checksum.checksum(df).columns == ["scope", "group", "n", "seq", "name", "qual", "aux"]


def test_clip_options(spark):
    from alnspark.operators import amplicon

    primers = spark.createDataFrame([("chr1", 0, 5, "+"), ("chr1", 15, 20, "-")], "chrom string, start0 bigint, end0 bigint, strand string")
    df = sam(
        spark, "f 0 chr1 3 60 10M * 0 0 ACGTACGTAC IIIIIIIIII NM:i:0", "in 0 chr1 8 60 5M * 0 0 ACGTA IIIII", "bad 512 chr1 3 60 10M * 0 0 ACGTACGTAC IIIIIIIIII", "far 0 chr2 3 60 4M * 0 0 ACGT IIII",
        "both 0 chr1 3 60 16M * 0 0 ACGTACGTACGTACGT IIIIIIIIIIIIIIII", refs=(("chr1", 2000), ("chr2", 2000)),
    )
    got = lambda **o: {r.qname: r for r in amplicon.clip(df, primers, **o).collect()}
    plain = got()
    assert {k: r.cigar for k, r in plain.items()} == {"f": "3S7M", "in": "5M", "bad": "10M", "far": "4M", "both": "3S13M"}
    assert got(both_ends=True)["both"].cigar == "3S10M3S"
    assert got(original=True)["f"].tags["OA"].v == "f,3,+,10M,60,0;" and "OA" not in got(original=True)["in"].tags
    assert {k: r.flag for k, r in got(mark_fail=True).items()} == {"f": 0, "in": 512, "bad": 512, "far": 0, "both": 0}
    assert {k: r.flag for k, r in got(fail_length=7).items()} == {"f": 512, "in": 512, "bad": 512, "far": 0, "both": 0}
    assert set(got(filter_length=7)) == {"bad", "far", "both"} and set(got(filter_length=7, rejects=True)) == {"f", "in"}
    unmapped = got(unmap_length=5)["in"]
    assert (unmapped.flag, unmapped.mapq, unmapped.cigar) == (4, 0, None)
    assert set(got(only_clipped=True)) == {"f", "bad", "far", "both"} and set(got(drop_excluded=True)) == {"f", "in", "both"}
    assert amplicon.clip_counts(df, primers, both_ends=True).first().asDict() == {"total": 5, "excluded": 2, "forward": 2, "reverse": 1, "both": 1, "not_clipped": 1}


def test_fastq_names_clips_and_comments(spark):
    df = sam(spark, "a#7 80 chr1 1 60 2S3M * 0 0 ACGTN ABCDE OQ:Z:IIIII RX:Z:AC-G BC:Z:ac-g NM:i:1", "a#7 128 chr1 1 60 5M * 0 0 ACGTA *", "gone 0 chr1 1 60 4S * 0 0 ACGT IIII", "b 512 chr1 1 60 4M * 0 0 ACGT IIII BC:Z:1AC")
    full = {(r.qname, r.part): r for r in mates.to_fastq(df, suffix=True, original=True, default_quality="!", umi=["RX"], casava=True, strip=True).collect()}
    one, two = full[("a:AC+G#7/1", 1)], full[("a#7/2", 2)]
    assert (one.seq, one.qual, one.comment) == ("NAC", "III", "1:N:0:AC+G") and (two.seq, two.qual, two.comment) == ("ACGTA", "!!!!!", "2:N:0:AC+G")
    assert full[("b", 0)].comment == "1:Y:0:0" and len(full) == 3
    kept = {r.qname: r.comment for r in mates.to_fastq(df.where("flag <> 128"), strip=True, strip_tag="XC", copy_tags=[]).collect()}
    assert kept["a#7"] == "OQ:Z:IIIII\tRX:Z:AC-G\tBC:Z:ac-g\tNM:i:1\tXC:Z:3M2S:GT:BA" and kept["b"] == "BC:Z:1AC"
    lines = {r.value for r in mates.fastq_text(mates.to_fastq(df.where("qname = 'b'"), casava=True)).collect()}
    assert lines == {"@b 1:Y:0:0\nACGT\n+\nIIII"}


def test_duplicates_of_a_crowded_place(spark):
    df = sam(spark, *(f"p{k} {99 if k % 2 else 99 + 512} chr1 100 60 10M = 200 110 ACGTACGTAC {chr(60 + k % 7) * 10} MC:Z:10M" for k in range(60)), *(f"s{k} 0 chr1 100 60 10M * 0 0 ACGTACGTAC IIIIIIIIII" for k in range(5)), "t 0 chr1 500 60 4M * 0 0 ACGT IIII", "u 0 chr1 500 60 4M * 0 0 ACGT JJJJ")
    kept = {r.qname for r in dedup.duplicates(df, include_fails=True).where("not dup").collect()}
    assert kept == {"p13", "u"}
    assert dedup.duplicate_counts(df).first().n == 29 and dedup.markdup_metrics(df).first().excluded == 30
