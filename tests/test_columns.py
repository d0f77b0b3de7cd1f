"""Positions laid out in batches, against the plain rows of each base."""

import random

import numpy as np
import pyarrow as pa
import pytest

from alnspark.operators import assembly as A, columns as L, pileup as P
from alnspark.plans.derive import reads, reference
from alnspark.schema import READS

DATA = "/root/testdata/sf0.001"
BASES = "".join(random.Random(4).choice("ACGT") for _ in range(120))


def made(n, seed=2):
    rnd, out = random.Random(seed), []
    for k in range(n):
        cigar = rnd.choice(["9M", "2S5M2I3M1H", "3M2D4M", "4M30N5M", "2M1D1I3M", "1I4=2X", "5M3D", "3P4M1N2M", "6M4I"])
        seq = None if k % 17 == 0 else "".join(rnd.choice("ACGTNacgt") for _ in range(rnd.choice([12, 12, 12, 5])))
        qual = None if k % 13 == 0 or seq is None else "*" if k % 29 == 0 else "".join(chr(33 + rnd.randint(0, 60)) for _ in seq)
        md = {"MD": ("Z", rnd.choice(["3A2^AC4", "0C8", "9", "2G0T5"]))} if k % 2 else {}
        out.append((k * 37 % n, k % 3, f"r{k}", rnd.choice([0, 16]), 0, rnd.choice(["chr1", "chr2"]), rnd.randint(1, 110), None if k % 7 == 0 else rnd.randint(0, 120), cigar, None, None, None, 0, seq, qual, md, list(md)))
    return out


@pytest.fixture(scope="module")
def some(spark):
    return spark.createDataFrame(made(400), READS).repartition(3), spark.createDataFrame([("chr1", BASES), ("chr2", BASES[::-1].lower())], "name string, seq string")


def told(r):
    low = str.lower if r.reverse else str.upper
    if r.base is None:
        return ""
    base = "*" if r.base == "*" else "<>"[not r.reverse] if r.base == ">" else ",."[not r.reverse] if r.base.upper() == r.ref else low(r.base)
    indel = (f"+{len(r.ins)}{low(r.ins)}" if r.ins is not None else "") + (f"-{r.del_}{low(r.gap)}" if r.del_ is not None else "")
    return ("^" + chr(min(r.mapq, 93) + 33) if r.first else "") + base + indel + ("$" if r.last else "")


def test_pileup_is_that_of_each_base(spark, some):
    df, ref = some
    for least in (0, 13):
        at = {}
        for r in P.bases(df, least, reference=ref).collect():
            at.setdefault((r.chrom, r.pos), []).append((r.src, r.ordinal, told(r), chr(min(r.q, 93) + 33), r.ref))
        want = {k: (min(e[4] for e in v), len(v), "".join(e[2] for e in sorted(v)) or "*", "".join(e[3] for e in sorted(v))) for k, v in at.items()}
        found = P.mpileup(df, ref, min_base_quality=least)
        assert {(r.chrom, r.pos): (r.ref, r.depth, r.bases, r.quals) for r in found.collect()} == want


def test_pileup_shuffles_no_row_for_each_base(spark, some):
    assert "Generate" not in P.mpileup(*some)._jdf.queryExecution().toString()
    # a task tells one row of a position of all its records
    df = spark.createDataFrame([(k, 0, "r", 0, 0, "chr1", 5, 60, "9M", None, None, None, 0, "ACGTACGTA", None, {}, []) for k in range(500)], READS)
    assert P._parts(df.coalesce(1), some[1]).count() <= 9 * 4


def test_merged_qualities_beyond_ascii(spark, some):
    from alnspark.operators import overlaps as O

    # two mates whose equal bases have qualities of 60 each: merged 120, a sign of two bytes
    flags = [99, 147]
    rows = [(k, 0, "r", flags[k], 0, "chr1", 5 + 2 * k, 60, "6M", 0, "chr1", 7 - 2 * k, 8, "ACGTAC"[2 * k :] + "ACGT"[: 2 * k], "]]]]]5" if k else "5]]]]]", {}, []) for k in range(2)]
    df = spark.createDataFrame(rows, READS)
    assert any(ord(c) > 127 for r in O.merge_mates(df).collect() for c in r.qual)
    at = {}
    for r in P.bases(O.merge_mates(df), 13, reference=some[1]).collect():
        at.setdefault(r.pos, []).append((r.ordinal, chr(min(r.q, 93) + 33)))
    found = {r.pos: r.quals for r in P.mpileup(df, some[1], mates=True).collect()}
    assert found == {p: "".join(q for _, q in sorted(v)) for p, v in at.items()}


def test_slices_change_nothing(monkeypatch, some):
    rows = [r for r in made(300) if r[5] == "chr1"]
    columns = {"src": [0] * len(rows), "ordinal": list(range(len(rows))), "rname": [r[5] for r in rows], "pos": [r[6] for r in rows], "cigar": [r[8] for r in rows], "seq": [r[13] for r in rows], "qual": [r[14] for r in rows], "mapq": [r[7] or 0 for r in rows], "reverse": [r[3] == 16 for r in rows], "_stretch": [BASES[r[6] - 1 :] for r in rows]}
    batch = pa.RecordBatch.from_pydict(columns)

    def joined():
        out = {}
        for part in L.pileup_parts(iter([batch]), 13):
            for r in sorted(part.to_pylist(), key=lambda r: r["ordinal"]):
                n, t, q = out.get(r["pos"], (0, "", ""))
                out[r["pos"]] = n + r["n"], t + r["t"], q + r["q"]
        return out

    whole = joined()
    monkeypatch.setattr(L, "BASES", 25)
    assert joined() == whole


def plain_md(cigar: str, seq: str, ref: str) -> tuple[str, int]:
    import re

    text, run, nm, q, r = [], 0, 0, 0, 0
    for n, k in ((int(n), k) for n, k in re.findall(r"(\d+)([MIDNSHP=X])", cigar)):
        if k in "M=X":
            for a, b in zip(seq[q : q + n], ref[r : r + n], strict=False):
                if a == "=" or (a != "N" and a.upper() == b.upper()):
                    run += 1
                else:
                    text += [str(run), b.upper()]
                    run, nm = 0, nm + 1
            q, r = q + n, r + n
        elif k == "D":
            text += [str(run), "^", ref[r : r + n].upper()]
            run, nm, r = 0, nm + n, r + n
        elif k == "N":
            r += n
        elif k in "IS":
            q, nm = q + n, nm + (n if k == "I" else 0)
    return "".join([*text, str(run)]), nm


def plain_reference(cigar: str, seq: str, md: str) -> list[str]:
    """The reference over the record's span; '' where a skip leaves it open."""
    import re

    parts = iter(re.findall(r"\d+|\^[A-Za-z]+|[A-Za-z]", md))
    told: list[str | None] = []  # of aligned and deleted bases: None as the read has it
    for p in parts:
        told += [None] * int(p) if p.isdigit() else list(p[1:]) if p[0] == "^" else [p]
    out, q, t = [], 0, 0
    for n, k in ((int(n), k) for n, k in re.findall(r"(\d+)([MIDNSHP=X])", cigar)):
        if k in "M=X":
            for i in range(n):
                out.append(((told[t + i] if t + i < len(told) else None) or seq[q + i]).upper())
            q, t = q + n, t + n
        elif k == "D":
            out += [(told[t + i] if t + i < len(told) else "N") or "N" for i in range(n)]
            t += n
        elif k == "N":
            out += [""] * n
        elif k in "IS":
            q += n
    return out


def test_md_is_that_of_each_record(some):
    df, ref = some
    rows = [r for r in df.collect() if r.seq]
    whole = {"chr1": BASES, "chr2": BASES[::-1].lower()}
    want = {(r.src, r.ordinal): plain_md(r.cigar, r.seq, whole[r.rname][r.pos - 1 :]) for r in rows}
    assert {(r.src, r.ordinal): (r.md, r.nm) for r in P.md_nm(df.where("seq is not null"), ref).collect()} == want
    tagged = {(r.src, r.ordinal): (r.tags["MD"].v, int(r.tags["NM"].v)) for r in P.calmd(df.where("seq is not null"), ref).collect()}
    assert tagged == want


def test_reference_is_that_of_each_record(some):
    df = some[0].where("length(seq) = 12 and tags['MD'] is not null and cigar not in ('6M4I', '1I4=2X')")
    want = {}
    for r in sorted(df.collect(), key=lambda r: (r.src, r.ordinal)):
        for k, base in enumerate(plain_reference(r.cigar, r.seq, r.tags["MD"].v)):
            if base:
                want[r.rname, r.pos + k] = base
    assert len(want) > 100
    assert {(r.chrom, r.pos): r.base for r in P.reference_from_md(df).collect()} == want


def test_calmd_joins_no_records_with_themselves(spark, some):
    df = reads(spark, DATA)
    plan = P.calmd(df, reference(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lineitem") <= 1 and plan.count("Join") == 1
    unknown = some[1].where("name = 'chr1'")
    kept = P.calmd(some[0].where("seq is not null"), unknown)
    assert kept.count() == some[0].where("seq is not null").count()
    assert kept.where("rname = 'chr2' and tags['NM'] is not null").count() == 0 < kept.where("rname = 'chr1' and tags['NM'] is not null").count()


def test_reference_of_a_task_is_one_row_for_each_position(spark):
    df = spark.createDataFrame([(k, 0, "r", 0, 0, "chr1", 5, 60, "9M", None, None, None, 0, "ACGTACGTA", None, {"MD": ("Z", "9")}, ["MD"]) for k in range(3000)], READS)
    batches = df.coalesce(1).selectExpr("rname", "src", "ordinal", "pos", "cigar", "seq", "tags['MD'].v as md").mapInArrow(L.reference_told, L.TOLD)
    assert batches.count() == 9


def test_weighed_columns_call_the_same(spark, some):
    rows = lambda x: sorted(map(tuple, A.bayesian(x, ambiguous=True).collect()))
    shallow = some[0].where("length(seq) = 12")
    deep = shallow.crossJoin(spark.range(20)).drop("id").coalesce(2)
    for df in (shallow, deep):
        assert rows(A.weighed(df)) == rows(A.columns(df))
    # deep columns are told by whole qualities, so most observations of a task are counted together
    assert A.weighed(deep).selectExpr("sum(size(seen))").first()[0] < A.columns(deep).selectExpr("sum(size(seen))").first()[0]
    with pytest.raises(ValueError, match="least quality"):
        A.bayesian(A.weighed(shallow), min_base_quality=5)


def test_observations_given_on_early_add_up(some):
    rows = [r for r in made(300) if r[13]]
    batch = pa.RecordBatch.from_pydict({"rname": [r[5] for r in rows], "pos": [r[6] for r in rows], "cigar": [r[8] for r in rows], "seq": [r[13] for r in rows], "qual": pa.array([r[14] for r in rows], pa.string()), "place": [r[7] or 255 for r in rows], "_mm": pa.array([[2, 5]] * len(rows), pa.list_(pa.int32()))})
    fold = lambda q, mapq, nm, poly: A.levels(q, mapq, nm, poly, np.full(len(q), A.SHALLOW))

    def total(most):
        out = {}
        for part in L.observed(iter([batch] * 3), fold, 10**9, 50, most):
            for r in part.to_pylist():
                n = r.pop("n")
                out[tuple(r.values())] = out.get(tuple(r.values()), 0) + n
        return out

    assert total(10) == total(1 << 22)


def test_calmd_by_chunks_keeps_every_record(monkeypatch, some):
    from alnspark.operators import reference as R

    df, ref = some[0].where("seq is not null"), some[1].where("name = 'chr1'")
    tags = lambda: sorted((r.src, r.ordinal, sorted((k, v.v) for k, v in r.tags.items())) for r in P.calmd(df, ref).collect())
    whole = tags()
    monkeypatch.setattr(R, "BROADCAST_BASES", 0)
    monkeypatch.setattr(R, "CHUNK", 16)
    assert tags() == whole and len(whole) == df.count()


def test_base_counts_are_those_of_each_base(spark, some):
    from alnspark.operators import models as M

    df, _ = some
    for least, mapq in ((0, 0), (13, 20)):
        want = {}
        for r in P.bases(df, least, mapq).where("base in ('A', 'C', 'G', 'T')").collect():
            key = r.chrom, r.pos, "ACGT".index(r.base), int(r.reverse), max(min(r.q, r.mapq or 255, 63), 4)
            want[key] = want.get(key, 0) + 1
        found = M.columns(df, least, mapq).collect()
        assert {(r.chrom, r.pos, e.base, e.reverse, e.q): e.n for r in found for e in r.seen} == want


@pytest.mark.parametrize("most", [1, 30, 60])
def test_base_counts_that_are_given_on(most, monkeypatch):
    rows = [r for r in made(300) if r[13]]
    batch = pa.RecordBatch.from_pydict({"rname": [r[5] for r in rows], "pos": [r[6] for r in rows], "cigar": [r[8] for r in rows], "seq": [r[13] for r in rows], "qual": [r[14] for r in rows], "mapq": [r[7] or 0 for r in rows], "reverse": [r[3] == 16 for r in rows]})

    def summed(most):
        out = {}
        for part in L.base_counts(iter([batch]), 13, most):
            for r in part.to_pylist():
                key = tuple(r.values())[:-1]
                out[key] = out.get(key, 0) + r["n"]
        return out

    monkeypatch.setattr(L, "BASES", 40)
    assert summed(most) == summed(1 << 14)
