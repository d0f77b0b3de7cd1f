"""Phasing by local haplotypes against all paths, and piece by piece."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from alnspark.operators import haplotypes as H

from .test_fixtures import sam


def counts_one_by_one(rows, size, k):
    out = np.zeros((size, 1 << k), int)
    for first, codes, n in rows:
        for j in range(1, len(codes)):
            window = ["0"] * max(0, k - 1 - j) + list(codes[max(0, j - k + 1) : j + 1])
            if window[-1] == "0" or sum(c != "0" for c in window) <= 1:
                continue
            for fill in itertools.product("12", repeat=window.count("0")):
                rest = iter(fill)
                out[first + j][int("".join("01"[(next(rest) if c == "0" else c) == "2"] for c in window), 2)] += n
    return out


def patterns(rnd, size, n):
    out = []
    for _ in range(n):
        a = rnd.randrange(size - 1)
        codes = "".join(rnd.choice("0121212") for _ in range(rnd.randint(2, size - a))).strip("0")
        if len(codes) > 1:
            out.append((a, codes, rnd.randint(1, 3)))
    return out


@pytest.mark.parametrize("k", [2, 3, 5])
def test_counts_and_path_against_all_haplotypes(k):
    rnd = random.Random(k)
    for size in (2, 4, 7):
        rows = patterns(rnd, size, 12)
        w = H.window_counts(rows, size, k)
        assert (w == counts_one_by_one(rows, size, k)).all()
        mask = (1 << k) - 1

        def total(bits):  # k - 1 bits before the first site are free
            return sum(w[i][v] + w[i][mask & ~v] for i in range(size) for v in [int("".join(map(str, bits[i : i + k])), 2)])

        best = max(total(b) for b in itertools.product((0, 1), repeat=size + k - 1))
        path = H.best_path(w)
        mine = max(total((*free, *path.tolist())) for free in itertools.product((0, 1), repeat=k - 1))
        assert mine == best


def test_chimeras_and_doubtful_templates():
    assert H.judge("111", "000") == {"phase": False, "in_count": 3, "out_count": 0, "ambig": False, "flip": False, "fixed": "111"}
    assert H.judge("222", "000")["phase"] is True and H.judge("1012", "0000")["ambig"] is True
    cut = H.judge("1111122222", "0000000000")
    assert cut["flip"] and cut["fixed"] in ("1111111111", "2222222222")
    assert not H.judge("1111122222", "0000000000", fix=False)["flip"] and not H.judge("11122", "00000")["flip"]


def test_masks():
    good, bad = (9, 0, 9, 0), (1, 6, 1, 6)
    assert H.masks([good] * 3 + [bad] * 3 + [good] * 9) == [False] * 3 + [True] * 3 + [False] * 9
    assert H.masks([good] * 5) == [False] * 5 and H.masks([]) == [] and H.masks([good, bad]) == [False, False]  # ends before it can tell


def test_blocks_by_hand(spark, monkeypatch):
    rnd = random.Random(5)
    monkeypatch.setattr(H, "STRETCH", 50)
    where = sorted(rnd.sample(range(1, 1000), 60))
    seen = []
    for t in range(45):
        a = rnd.randrange(60)
        seen += [("chr1", where[s], f"t{t}", rnd.choice([0, 1, 2])) for s in range(a, min(60, a + rnd.randint(1, 3)))]
    want, open_ = [], []
    for s, pos in enumerate(where):
        spans = {}
        for _, p, q, _ in seen:
            lo, hi = spans.get(q, (p, p))
            spans[q] = min(lo, p), max(hi, p)
        joined = any(lo < pos <= hi for lo, hi in spans.values())
        open_ = [*open_, pos] if joined else [pos]
        want.append((pos, open_[0], len(open_) - 1))
    sites = spark.createDataFrame([("chr1", p, "A", "C") for p in where], "chrom string, pos long, low string, high string")
    got = H.blocks(sites, spark.createDataFrame(seen, "chrom string, pos long, qname string, code int"))
    assert sorted((r.pos, r.block, r.i) for r in got.collect()) == want
    assert {(r.block, r["size"]) for r in got.collect()} == {(b, sum(x[1] == b for x in want)) for _, b, _ in want}


def test_pieces_join_to_the_path_of_the_whole(spark):
    rnd = random.Random(8)
    size, truth = 60, [rnd.randint(0, 1) for _ in range(60)]
    rows = []
    for t in range(150):
        a, side = rnd.randrange(size - 4), rnd.randint(0, 1)
        n = rnd.randint(3, 9)
        codes = "".join(str(1 + (truth[s] ^ side)) if rnd.random() < 0.97 else "0" for s in range(a, min(size, a + n))).strip("0")
        rows.append(("chr1", 5, a, codes, 1))
    placed = spark.createDataFrame([("chr1", 5, i, size) for i in range(size)], "chrom string, block long, i int, size int")
    pats = spark.createDataFrame([r for r in rows if r[3]], "chrom string, block long, first int, codes string, n long")
    for piece, overlap in ((1000, 100), (12, 8), (7, 6)):
        got = [r.bit for r in H.paths(placed, pats, 5, piece, overlap).orderBy("i").collect()]
        assert got in (truth, [1 - b for b in truth])


def test_the_published_fixture(spark):
    rows = [f"a{k} 0 chr1 1 60 12M * 0 0 AAAAAACCCCCC IIIIIIIIIIII" for k in range(2)] + [f"b{k} 0 chr1 1 60 12M * 0 0 CCCCCCAAAAAA IIIIIIIIIIII" for k in range(2)]
    found = H.Phased(sam(spark, *rows), least_lod=1, k=3, min_base_quality=1)
    sites = found.sites().orderBy("pos").collect()
    assert [r.pos for r in sites] == list(range(1, 13)) and {(r.block, r.kind) for r in sites} == {(1, 1)}
    assert "".join(r["first"] for r in sites) in ("AAAAAACCCCCC", "CCCCCCAAAAAA")
    assert {(r.support0, r.errors0, r.support1, r.errors1) for r in sites} == {(2, 0, 2, 0)}
    sides = {r.qname: r.phase for r in found.templates().collect()}
    assert sides["a0"] == sides["a1"] != sides["b0"] == sides["b1"]
    assert H.Phased(sam(spark, *rows), least_lod=1, k=3, min_base_quality=50).sites().count() == 0


def test_reads_go_to_their_parts(spark):
    from alnspark.functions.hashes import x31

    one, two = "A" * 12, "C" * 12
    rows = [f"a{k} 0 chr1 1 60 12M * 0 0 {one} {'I' * 12}" for k in range(5)] + [f"b{k} 0 chr1 1 60 12M * 0 0 {two} {'I' * 12}" for k in range(5)]
    rows += [f"mix 0 chr1 1 60 12M * 0 0 {one[:7] + two[:5]} {'I' * 12}", f"far 0 chr1 900 60 12M * 0 0 {one} {'I' * 12}", f"a0 1024 chr1 1 60 12M * 0 0 {one} {'I' * 12}"]
    df = sam(spark, *rows)
    found = {(r.qname, r.flag): r for r in H.Phased(df, least_lod=10).routed().collect()}
    assert len(found) == df.count()
    assert {found[f"a{k}", 0].part for k in range(5)} | {found[f"b{k}", 0].part for k in range(5)} == {0, 1}
    assert found["a0", 0].part != found["b0", 0].part and found["a0", 0].tags["ZP"]["v"] == "Y"
    assert found["mix", 0].part == 2 and "ZP" not in found["mix", 0].tags
    by_name = {r.qname: r.h & 1 for r in df.select("qname", x31(F.col("qname")).alias("h")).collect()}
    assert found["far", 0].part == by_name["far"] and found["a0", 1024].part == by_name["a0"]


def test_a_site_alone(spark):
    rows = [f"a{k} 0 chr1 1 60 4M * 0 0 {'ACGT' if k % 2 else 'CCGT'} IIII" for k in range(12)]
    found = H.Phased(sam(spark, *rows), least_lod=10)
    assert [(r.kind, r.pos, {r["first"], r.second}, r.support0) for r in found.sites().collect()] == [(0, 1, {"A", "C"}, 0)]
    assert {r.phase for r in found.templates().collect()} == {True, False} and all(r.phased for r in found.templates().collect())


def test_a_template_is_its_known_sites_however_far_apart(spark):
    placed = spark.createDataFrame([("chr1", 10 * (i + 1), 10, i, 10**8) for i in (0, 1, 10**8 - 1)], "chrom string, pos long, block long, i int, size int")
    seen = spark.createDataFrame([("chr1", 10, "a", 1), ("chr1", 20, "a", 0), ("chr1", 10**9, "a", 2)], "chrom string, pos long, qname string, code int")
    (row,) = H.templates(placed, seen).collect()
    assert (row.beg, row.end, [tuple(e) for e in row.known]) == (9, 10**9, [(0, 1), (10**8 - 1, 2)])


@pytest.mark.parametrize("k", [3, 5])
def test_many_windows_sum_up_as_few_do(k):
    rnd = random.Random(k)
    told = [(known, known & rnd.randrange(1 << k), rnd.randint(1, 9)) for known in range(1 << k) for _ in range(20)]
    rows = [("".join("0" if not known >> s & 1 else "12"[value >> s & 1] for s in range(k - 1, -1, -1)), n) for known, value, n in told]
    want = np.zeros(1 << k, int)
    for codes, n in rows:
        for bits in range(1 << k):
            want[bits] += n * all(c == "0" or int(c) - 1 == bits >> (k - 1 - s) & 1 for s, c in enumerate(codes))
    known, value, n = np.array(told).T
    assert (H.fits(known, value, n, k) == want).all()  # many: by halves
    assert (sum(H.fits(known[j : j + 1], value[j : j + 1], n[j : j + 1], k) for j in range(len(n))) == want).all()


def test_all_templates_are_judged_as_each_is():
    rnd = random.Random(3)
    each = []
    for _ in range(400):
        n, cut = rnd.randint(0, 14), rnd.randint(0, 14)
        bits = "".join(rnd.choice("01") for _ in range(n))
        codes = "".join(str(1 + (int(b) ^ (k < cut) ^ (rnd.random() < 0.15))) for k, b in enumerate(bits))
        each.append((codes, bits))
    row = np.repeat(np.arange(len(each)), [len(c) for c, _ in each])
    code, bit = (np.array([int(x) for pair in each for x in pair[which]]) for which in (0, 1))
    for fix in (True, False):
        told = H.judge_all(row, code, bit, len(each), fix)
        for k, (c, b) in enumerate(each):
            want = H.judge(c, b, fix)
            assert {n: bool(told[n][k]) if isinstance(want[n], bool) else int(told[n][k]) for n in want if n != "fixed"} == {n: v for n, v in want.items() if n != "fixed"}
            assert "".join(map(str, told["fixed"][row == k])) == want["fixed"]
    assert any(H.judge(c, b)["flip"] for c, b in each)


def test_no_row_for_each_base(spark):
    from alnspark.operators import models as M
    from alnspark.plans.derive import reads

    df = reads(spark, "/root/testdata/sf0.001")
    assert "Generate" not in M.columns(df)._jdf.queryExecution().toString()
    found = H.Phased(df, least_lod=5)
    # a template is one row, and its sites aren't looked up one by one
    assert found.judged.count() == found.judged.select("chrom", "qname").distinct().count()
    assert "Generate" not in H._judged(found.members, found.along, True)._jdf.queryExecution().toString().split("Physical Plan")[1]


def test_small_chunks_and_paths_that_are_joined_change_nothing(spark, monkeypatch):
    rnd = random.Random(6)
    one, two = ("".join(rnd.choice("ACGT") for _ in range(60)) for _ in range(2))
    rows = []
    for k in range(60):
        at, size = rnd.randrange(40), rnd.randint(3, 20)
        cigar, used = rnd.choice([(f"{size}M", size), (f"2M3N{size - 2}M", size), (f"2M1I{size - 2}M", size + 1), (f"1M2D{size - 1}M", size)])
        rows.append(f"t{k % 45} {rnd.choice([0, 16])} chr{k % 2 + 1} {at + 1} 60 {cigar} * 0 0 {(one if k % 3 else two)[at : at + used].ljust(used, 'A')} {'I' * used}")
    df = sam(spark, *rows)
    told = lambda: [sorted(map(repr, x.collect())) for found in [H.Phased(df, least_lod=1, k=4, min_base_quality=1)] for x in (found.sites(), found.templates())]
    whole = told()
    assert len(whole[0]) > 20 and len(whole[1]) > 20
    monkeypatch.setattr(H, "CHUNK", 4)
    monkeypatch.setattr(H, "PATH", 3)
    assert told() == whole
    monkeypatch.setattr(H, "BROADCAST_SITES", 0)
    assert told() == whole
