"""Consensus columns with insertions, Bayesian calls, assembled sequences."""

import math

import numpy as np
import pytest

from alnspark.operators import assembly as A

from .test_fixtures import header, sam


def cols(spark, *rows, **options):
    return A.columns(sam(spark, *rows), **options)


def test_columns_between_positions(spark):
    rows = ["a 0 chr1 1 60 2M2I2M * 0 0 ACGGTT IIIIII", "b 0 chr1 1 60 4M * 0 0 ACTT 5555", "c 0 chr1 1 60 2M1I2M * 0 0 ACTTT IIIII", "d 0 chr1 1 60 1M2N1M * 0 0 AT II", "e 0 chr1 1 60 1M1D2M * 0 0 ATT III"]
    found = {(r.pos, r.nth): sorted((e.base, e.n) for e in r.seen) for r in cols(spark, *rows).collect()}
    assert set(found) == {(1, 0), (2, 0), (2, 1), (2, 2), (3, 0), (4, 0)}
    assert sorted(b for b, _ in found[2, 1]) == ["*", "*", "G", "T"] and sorted(b for b, _ in found[2, 2]) == ["*", "*", "*", "G"]
    assert set(cols(spark, *rows, insertions=False).select("nth").distinct().toPandas()["nth"]) == {0}
    call = {(r.pos, r.nth): (r.call, r.quality) for r in A.simple(cols(spark, *rows), call_fraction=0.5).collect()}
    assert call[2, 0] == ("C", 75) and call[2, 1] == ("*", 50) and call[1, 0] == ("A", 100)
    best = {(r.pos, r.nth): r.quality for r in A.simple(cols(spark, *rows), min_base_quality=21, use_quality=True).collect()}
    assert best[1, 0] == 100


def test_mismatches_near_by_and_homopolymers(spark):
    far = "A" * 60
    rows = [f"a 0 chr1 1 60 66M * 0 0 CAATTTA{far[:59]} {'I' * 66} MD:Z:0A2^GG3G59", "b 0 chr1 1 255 2M * 0 0 AA *"]
    seen = {r.pos: {(e.nm, e.poly, e.mapq, e.q) for e in r.seen} for r in cols(spark, *rows).collect()}
    assert (2, 1, 60, 40) in seen[1] and (0, 2, 255, 255) in seen[1]
    assert {e[1] for e in seen[5] if e[2] == 60} == {3}
    assert {e[0] for e in seen[66]} == {0}  # both mismatches lie beyond 50 bases
    assert {e[0] for e in seen[52] if e[2] == 60} == {1}


def by_hand(observations, depth, het_prior=1e-3):
    """The genotype model, one observation after the other: (base 0-5, q, mapq, nm, poly)."""

    def log2(x):
        m, e = math.frexp(x)
        d = 2 * m
        return e - 2 + ((-1 / 3) * d + 2) * d - 2 / 3

    s = [0.0] * 15
    for base, q, mapq, nm, poly in observations:
        place = int(min(max(mapq / (nm + 1) * (1 + 2 * (0.5 - min(depth, 30) / 60)), 1), 60))
        e, m = 10 ** (-min(10 if q == 255 else q, 100) / 10), 10 ** (-place * 0.9 / 10)
        quality = max(-3.0103 * log2(e + 0.75 * m - e * m), 1)
        k, k2 = max(int(min(quality, 100)), 1), max(int(min(max(quality - (poly - 2) * 0.01, 1), 100)), 1)
        hit, miss = lambda k: math.log(1 - 10 ** (-k / 10)), lambda k: math.log(10 ** (-k / 10) / 3)
        mean = lambda a, b: math.log((math.exp(a) + math.exp(b)) / 2)
        extra = min(miss(k2), hit(k2) - 0.5)
        for g, (x, y) in enumerate(A.PAIRS):
            if base == 4:
                v = hit(k2) if x == 4 else mean(extra, hit(k2)) if y == 4 else extra
            elif y == 4:
                v = extra if x == 4 else min(mean(extra, hit(k2)), mean(hit(k2), miss(k2)) + 0.5) if base in (x, 5) else mean(extra, miss(k2))
            else:
                v = hit(k) if base == 5 or x == y == base else mean(hit(k), miss(k)) if base in (x, y) else miss(k)
            s[g] += v - miss(k)
    s = [round(v + math.log(1 if x == y else (2e-4 if y == 4 else het_prior) / 6), 9) for v, (x, y) in zip(s, A.PAIRS)]
    one = max((g for g in range(15) if A.PAIRS[g][0] == A.PAIRS[g][1]), key=lambda g: (s[g], -g))
    het = max((g for g in range(15) if A.PAIRS[g][0] != A.PAIRS[g][1]), key=lambda g: (s[g], -g))
    step = lambda v: math.exp(int(v * 10) / 10) if abs(v) <= 50 else math.exp(int(max(v, -500)))
    p = [step(v - max(s)) for v in s]
    rest = lambda g: math.fsum(p[j] for j in range(15) if j != g)
    value = rest(one) if p[one] == 1 and rest(one) < 0.01 else 1 - p[one] / (rest(one) + p[one])
    return A.PAIRS[one][0], max(0, int(-3.0103 * log2(value) + 0.5)), het, int(3.0103 * (log2(p[het]) - log2(rest(het))) + 0.5)


def test_calls_one_by_one():
    rng = np.random.default_rng(7)
    parts, want, depths = [], [], []
    for c in range(40):
        n = int(rng.integers(1, 50))
        weights = rng.dirichlet(np.ones(5) * 0.3)
        obs = [(int(rng.choice(5, p=weights)), int(rng.choice([2, 20, 37, 255])), int(rng.choice([0, 13, 60, 255])), int(rng.integers(0, 3)), int(rng.integers(1, 9))) for _ in range(n)]
        parts += [(c, *o, 1) for o in obs]
        depths.append(n + 3)
        want.append(by_hand(obs, n + 3))
    column, base, q, mapq, nm, poly, n = map(np.array, zip(*parts))
    got = A.call_columns(column, base, q, mapq, nm, poly, n, np.array(depths))
    assert [tuple(int(g[c]) for g in got[:4]) for c in range(40)] == want


def test_cutoff_depth_and_ambiguity(spark):
    both = [f"r{k} 0 chr1 1 60 1M * 0 0 {'AC'[k % 2]} I" for k in range(8)]
    one = lambda rows, **o: [(r.call, r.quality) for r in A.bayesian(cols(spark, *rows), **o).collect()][0]
    assert one(both, ambiguous=True)[0] == "M"
    assert one(both) == ("N", 0) and one(both, cutoff=0)[0] in "AC"
    assert one(both[:1], min_depth=2) == ("N", 0)
    assert one(["x 0 chr1 1 60 1M * 0 0 A #"])[0] == "N"


def text(df, part="seq"):
    out = {}
    for r in df.orderBy("chrom", "line").collect():
        out[r.chrom] = out.get(r.chrom, "") + r[part]
    return out


@pytest.mark.parametrize("chunk", [3, 7_000])
def test_assembled_sequence(spark, chunk):
    rows = ["a 0 chr1 3 60 2M2I2M1D2M * 0 0 ACGGTTCC IIIIIIII", "b 0 chr1 13 60 2M * 0 0 GG II", "c 0 chr2 2 60 1M * 0 0 T I"]
    calls = A.simple(cols(spark, *rows))
    sq = header(spark, ("chr1", 16), ("chr2", 4), ("chr3", 5))
    assert text(A.assemble(calls, chunk=chunk)) == {"chr1": "ACGGTTCCNNNGG", "chr2": "T"}
    assert text(A.assemble(calls, chunk=chunk), "qual")["chr1"] == "~" * 8 + "!!!" + "~~"
    lines = A.assemble(calls, chunk=chunk, line=5).where("chrom = 'chr1'").orderBy("line").collect()
    assert [r.seq for r in lines] == ["ACGGT", "TCCNN", "NGG"]
    assert text(A.assemble(calls, sq, every=True, chunk=chunk)) == {"chr1": "NNACGGTTCCNNNGGNN", "chr2": "NTNN", "chr3": "NNNNN"}
    assert text(A.assemble(calls, show_deleted=True, chunk=chunk))["chr1"] == "ACGGTT*CCNNNGG"
    ref = spark.createDataFrame([("chr1", "tttttttttttttttt"), ("chr2", "gg")], "name string, seq string")
    found = A.assemble(calls, sq, every=True, reference=ref, reference_quality=30, chunk=chunk)
    assert text(found) == {"chr1": "TTACGGTTCCTTTGGTT", "chr2": "GTNN", "chr3": "NNNNN"}
    assert text(found, "qual")["chr2"] == "?~!!"
