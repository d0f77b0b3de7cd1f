"""BAM files: written by tasks, indexed, read by region."""

import os
import random

import pytest
from pyspark.sql import functions as F

from alnspark import sources
from alnspark.operators import regions as R, sorts
from alnspark.schema import READS
from alnspark.sources import alignments as A, bai

HEADER = "@HD\tVN:1.6\tSO:coordinate\n@SQ\tSN:chr1\tLN:400000000\n@SQ\tSN:chr2\tLN:1000\n@RG\tID:g\n"


def made(n, seed=1):
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        placed = rnd.random() < 0.97
        size = rnd.randint(1, 60)
        cigar = rnd.choice([f"{size}M", f"{size}M30000N{1}M", f"2S{size}M3I1D4M"]) if placed else None
        seq = None if k % 11 == 0 else "".join(rnd.choice("ACGTNRY") for _ in range({1: size, 2: size + 1, 3: size + 9}[len(A_ops(cigar))] if cigar else size))
        tags = {"RG": ("Z", "g"), "XA": ("A", "c"), "XF": ("f", "0.5"), "XB": ("B", "s,-1,300"), "XI": ("i", str(k - 5))} if k % 3 else {}
        out.append((
            k, 0, f"r{k}", rnd.choice([0, 16, 99]) if placed else 4, 0 if placed else None, "chr1" if placed else None, rnd.randint(1, 300_000_000) if placed else None, None if k % 7 == 0 else 30, cigar,
            1 if k % 5 == 0 else None, "chr2" if k % 5 == 0 else None, 77 if k % 5 == 0 else None, k - 9, seq, None if k % 13 == 0 or seq is None else "I" * len(seq), tags, list(tags),
        ))
    return out


def A_ops(cigar):
    import re

    kinds = re.findall(r"\d+([MIDNS])", cigar)
    return {("M",): [1], ("M", "N", "M"): [1, 2]}.get(tuple(kinds), [1, 2, 3])


def plain(df):
    return [tuple(r)[2:] for r in df.collect()]


@pytest.fixture(scope="module")
def bam(spark, tmp_path_factory):
    sources.register(spark)
    path = str(tmp_path_factory.mktemp("bam") / "sorted")
    df = spark.createDataFrame(made(6000), READS)
    R.write_bam(df.orderBy(*sorts.coordinate_keys()).repartitionByRange(8, F.coalesce("pos", F.lit(10**10))).sortWithinPartitions(*sorts.coordinate_keys()), path, HEADER, index=True)
    return df, path


def test_round_trip_in_order_by_eight_tasks(spark, bam):
    df, path = bam
    assert sorted(os.listdir(path)) == sorted(f"part-{k:05d}.bam{x}" for k in range(8) for x in ("", ".bai"))
    want = sorted(plain(df), key=repr)
    for split in (2_000, 10**8):
        got = spark.read.format("bam").option("splitBytes", split).load(path)
        assert sorted(plain(got), key=repr) == want
        places = [(r.pos or 10**10) for r in got.orderBy("src", "ordinal").collect()]
        assert places == sorted(places)
    assert A.bam_header_text(f"{path}/part-00007.bam") == HEADER


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    sources.register(spark)
    path = str(tmp_path / "x")
    bad = spark.createDataFrame(made(50), READS).withColumn("rname", F.when(F.col("ordinal") == 40, "chrX").otherwise(F.col("rname")))
    with pytest.raises(Exception, match="no reference 'chrX'"):
        R.write_bam(bad.repartition(3), path, HEADER)
    assert os.listdir(path) == []
    R.write_bam(spark.createDataFrame(made(50), READS), path, HEADER)
    with pytest.raises(Exception, match="overwrite"):
        R.write_bam(bad, path, HEADER, mode="append")
    R.write_bam(spark.createDataFrame(made(9), READS).coalesce(1), path, HEADER)
    assert spark.read.format("bam").load(path).count() == 9 and len(os.listdir(path)) == 1


def test_an_index_needs_the_order(spark, tmp_path):
    sources.register(spark)
    df, path = spark.createDataFrame(made(50), READS).coalesce(1), str(tmp_path / "x")
    with pytest.raises(Exception, match="order of their places"):
        R.write_bam(df, path, HEADER, index=True)
    R.write_bam(df, path, HEADER.replace("coordinate", "unsorted"))
    with pytest.raises(Exception, match="order of their places"):
        R.write_indices(spark, path)


def test_more_operations_than_the_record_holds(spark, tmp_path):
    sources.register(spark)
    cigar = "1M1I" * 40_000
    row = (0, 0, "long", 0, 0, "chr1", 5, 60, cigar, None, None, None, 0, "A" * 80_000, None, {"NM": ("i", "3")}, ["NM"])
    R.write_bam(spark.createDataFrame([row], READS), str(tmp_path / "x"), HEADER)
    assert plain(spark.read.format("bam").load(str(tmp_path / "x"))) == [tuple(spark.createDataFrame([row], READS).first())[2:]]


def test_index_equals_the_one_by_hand_and_the_writers(spark, bam, tmp_path):
    df, path = bam
    read = spark.read.format("bam").load(path)
    rows = [(r.src, r.ordinal, r.pos - 1, r.pos - 1 + max(1, span)) for r in read.collect() if r.pos for span in [sum(int(n) for n, c in ops(r.cigar) if c in "MDN=X")]]
    chunks, windows = {}, {}
    for src, at, a, b in rows:
        k = (src, 0, bai.bin_of(a, b), at >> 16)
        lo, hi = chunks.get(k, (at, at))
        chunks[k] = (min(lo, at), max(hi, at))
        for w in range(a >> 14, (b - 1 >> 14) + 1):
            windows[src, 0, w] = min(windows.get((src, 0, w), at), at)
    assert sorted(map(tuple, R.index_chunks(read).collect())) == sorted((s, t, b, lo, hi + 1) for (s, t, b, _), (lo, hi) in chunks.items())
    assert sorted(map(tuple, R.index_windows(read).collect())) == sorted((*k, at) for k, at in windows.items())
    import shutil

    copy = str(tmp_path / "copy")
    shutil.copytree(path, copy)
    made_by_tasks = {f: open(f"{copy}/{f}", "rb").read() for f in os.listdir(copy) if f.endswith(".bai")}
    for f in made_by_tasks:
        os.remove(f"{copy}/{f}")
    R.write_indices(spark, copy).collect()
    assert {f: open(f"{copy}/{f}", "rb").read() for f in made_by_tasks} == made_by_tasks


def ops(cigar):
    import re

    return re.findall(r"(\d+)([MIDNSHP=X])", cigar or "")


def test_regions_read_few_blocks(spark, tmp_path, monkeypatch):
    sources.register(spark)
    monkeypatch.setattr("alnspark.sources.bam_write.MOST", 2_000)
    from alnspark.sources.bam_write import BamWriter

    path = str(tmp_path / "x")
    writer = BamWriter({"path": path, "header": HEADER, "index": "true"}, True)
    rows = [r for r in spark.createDataFrame(made(20_000, 3), READS).orderBy(*sorts.coordinate_keys()).collect()]
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("C", (), {"partitionId": lambda s: 0, "taskAttemptId": lambda s: 1})())
    writer.commit([writer.write(iter(rows))])
    opened = []
    blocks = A._blocks
    monkeypatch.setattr(A, "_blocks", lambda f, at, size: (opened.append(x) or x for x in blocks(f, at, size)))
    reader = A.BamReader({"path": path})
    whole = [r for p in reader.partitions() for r in reader.read(p)]
    assert len(whole) == 20_000 and len(opened) > 1_000
    spans = [(r, r[6] - 1, r[6] - 1 + max(1, sum(int(n) for n, c in ops(r[8]) if c in "MDN=X"))) for r in whole if r[6]]
    for region, a, b in (("chr1:100,000,001-100,200,000", 100_000_000, 100_200_000), ("chr1:1-16384", 0, 16_384), ("chr1:299,999,000", 299_998_999, 10**9), ("chr2", 0, 0), ("chrX", 0, 0)):
        opened.clear()
        reader = A.BamReader({"path": path, "regions": region})
        got = {r[0] for p in reader.partitions() for r in reader.read(p)}
        assert {r[0] for r, x, y in spans if x < b and y > a} <= got
        assert len(opened) < 20
    f = A.BamReader({"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual

    conditions = [EqualTo(("rname",), "chr1"), GreaterThan(("pos",), 50_000_000), LessThanOrEqual(("pos",), 50_300_000)]
    assert f.pushFilters(conditions) == conditions
    opened.clear()
    got = {r[0] for p in f.partitions() for r in f.read(p)}
    assert {r[0] for r in whole if r[6] and 50_000_000 < r[6] <= 50_300_000} <= got and len(opened) < 20


def test_regions_by_option_and_by_condition(spark, bam):
    df, path = bam
    region = ["chr1:40,000,001-60,000,000"]
    want = sorted(plain(R.filters.by_regions(df, region)), key=repr)
    assert want and sorted(plain(R.read_regions(spark, path, region)), key=repr) == want
    some = spark.read.format("bam").load(path).where("rname = 'chr1' and pos > 40000000 and pos <= 60000000")
    assert some.count() == df.where("pos > 40000000 and pos <= 60000000").count()
    unplaced = R.read_regions(spark, path, ["*"])  # no index tells where those are: all is read
    assert unplaced.count() == df.where("rname is null").count() > 0


def test_a_list_of_files(spark, bam, tmp_path):
    _, path = bam
    (tmp_path / "list").write_text(f"{path}/part-00000.bam\n\n{path}/part-00003.bam\n")
    one = spark.read.format("bam").option("pathsFile", str(tmp_path / "list")).load()
    assert one.groupBy("src").count().count() == 2


def test_batches_are_the_records_one_by_one(tmp_path):
    """Both ways of writing and of reading give the same bytes and values: BAM is made and read by batches, not by rows."""
    import pyarrow as pa

    from alnspark.sources import bam_write as W

    names = ["chr1", "chr2"]
    columns = list(zip(*made(3_000, 7), strict=True))
    columns[15] = [[(k, {"t": t, "v": v}) for k, (t, v) in tags.items()][::-1] for tags in columns[15]]  # the map has no order of its own
    batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, A.ARROW, strict=True)], schema=A.ARROW)
    tids = {n: k for k, n in enumerate(names)}
    whole = W.encode_batch(batch, tids)
    each = [W.encode({**r, "tags": {k: v for k, v in r["tags"]}}, tids) for r in batch.to_pylist()]
    assert whole.data.tobytes() == b"".join(e.data for e in each)
    assert [*zip(whole.tid, whole.start0, whole.end0, strict=True)] == [(e.tid, e.start0, e.end0) for e in each]
    items = [(k, e.data[4:]) for k, e in enumerate(each)]
    assert A._bam_batch(items, 2, names).equals(A._one_by_one(items, 2, names))
    some = [(k, e.data[4:]) for k, e in enumerate(each) if e.data[-1:] == b"\0"][:2] + [(9, each[0].data[4:] + b"NMi\1\0\0\0NMi\2\0\0\0")]
    assert A._bam_batch(some, 0, names).equals(A._one_by_one(some, 0, names))
    with pytest.raises(ValueError, match="no reference"):
        W.encode_batch(batch, {"chr2": 0})
    assert A.BamSource({"path": str(tmp_path)}).writer(None, True).__class__.__mro__[1].__name__ == "DataSourceArrowWriter"
