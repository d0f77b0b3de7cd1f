"""Duplicate chains and counts against a pass over the records one after the other."""

import random

import pytest
from pyspark.sql import functions as F

from alnspark.operators import chains as H

from .test_fixtures import sam


def rows(seed, n, places=3):
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        pos, mate = rnd.randrange(places) * 10 + 100, rnd.choice([400, 500])
        qual = "".join(chr(33 + rnd.choice([20, 30])) for _ in range(4))
        name = f"m:1:{rnd.randint(1, 2)}:{rnd.randint(0, 900)}:{rnd.randint(0, 300)}"
        if rnd.random() < 0.6:
            flag = rnd.choice([99, 99, 99, 99 | 512])
            out.append(f"{name}k{k}a {flag} chr1 {pos} 60 4M = {mate} {mate - pos} ACGT {qual} MC:Z:4M ms:i:{rnd.choice([50, 100])}")
        else:
            out.append(f"{name}k{k}s 0 chr1 {pos} 60 4M * 0 0 ACGT {qual}")
    return out


def one_by_one(lines, include_fails=True):
    """root and count of each record; the sequential rules."""
    recs = []
    for line in lines:
        f = line.split()
        tags = {t.split(":")[0]: t.split(":")[2] for t in f[11:]}
        recs.append({"name": f[0], "flag": int(f[1]), "pos": f[3], "mate": f[7], "score": sum(ord(c) - 33 for c in f[10] if ord(c) - 33 >= 15), "ms": int(tags.get("ms", 0))})
    pair, single, orig, count = {}, {}, {}, [1] * len(recs)
    for i, r in enumerate(recs):
        if r["flag"] & 1:
            j = single.get(r["pos"])
            if j is None:
                single[r["pos"]] = i
            elif not recs[j]["flag"] & 1:
                orig[j] = i
                count[i] += 1
                single[r["pos"]] = i
            j = pair.get((r["pos"], r["mate"]))
            if j is None:
                pair[r["pos"], r["mate"]] = i
                continue
            old, new = recs[j], r
            if (old["flag"] ^ new["flag"]) & 512:
                wins = bool(old["flag"] & 512)
            else:
                a, b = old["score"] + old["ms"], new["score"] + new["ms"]
                wins = b > a or (a == b and new["name"] < old["name"])
            if wins:
                orig[j], pair[r["pos"], r["mate"]] = i, i
                count[i] += count[j]
            else:
                orig[i] = j
                count[j] += 1
        else:
            j = single.get(r["pos"])
            if j is None:
                single[r["pos"]] = i
            elif recs[j]["flag"] & 1 or r["score"] <= recs[j]["score"]:
                orig[i] = j
                count[j] += 1
            else:
                orig[j], single[r["pos"]] = i, i
                count[i] += count[j]
    root = {}
    for i in orig:
        j = i
        while j in orig:
            j = orig[j]
        root[i] = j
    return recs, root, {i: count[i] for i in range(len(recs)) if i not in orig}


@pytest.mark.parametrize("n,places", [(2, 1), (30, 2), (200, 3)])
def test_chains_and_counts(spark, n, places):
    for seed in range(2):
        lines = rows(seed, n, places)
        recs, root, count = one_by_one(lines)
        df = sam(spark, *lines).repartition(3)
        got = H.chains(df, 100, include_fails=True).collect()
        assert {r.ordinal: (r.root_ordinal, r.origin) for r in got} == {i: (j, recs[j]["name"]) for i, j in root.items()}
        assert {r.ordinal: r.n for r in H.counts(df, include_fails=True).collect()} == count

        def near(a, b):
            p, q = a["name"].split(":"), b["name"].split(":")
            return p[:3] == q[:3] and abs(int(p[3]) - int(q[3])) <= 100 and abs(int(p[4].split("k")[0]) - int(q[4].split("k")[0])) <= 100

        def beaten(a, b):  # a by b
            if (a["flag"] ^ b["flag"]) & 1:
                return not a["flag"] & 1
            if (a["flag"] ^ b["flag"]) & 512:
                return bool(a["flag"] & 512)
            x, y = (r["score"] + (r["ms"] if r["flag"] & 1 else 0) for r in (a, b))
            return x < y or (x == y and b["name"] < a["name"])

        want = {i: any(near(recs[i], recs[j]) and (j == root[i] or (root.get(j) == root[i] and beaten(recs[i], recs[j]))) for j in range(len(recs)) if j != i) for i in root}
        assert {r.ordinal: r.type == "SQ" for r in got} == want
    assert {r.type for r in H.chains(df).collect()} <= {"LB"}


def test_a_large_set_is_not_one_group(spark):
    lines = spark.range(60_000).select((F.col("id") * 7919 % 60_013).alias("ordinal"), (F.col("id") * 31 % 997).alias("v"))
    got = H.running_least(lines.select(F.lit("k").alias("key"), F.struct("ordinal").alias("at"), "v"), "key", "at", "v", 16)
    want, least = {}, 10**9
    for r in sorted(lines.collect()):
        least = min(least, r.v)
        want[r.ordinal] = least
    assert {r["at"]["ordinal"]: r.least for r in got.collect()} == want


def test_a_chain_in_one_cell_is_not_held_against_itself(spark):
    at = spark.range(5000).selectExpr("0 as src", "id as ordinal", "0 as root_src", "-1L as root_ordinal", "false as _is_root", "struct(id as r) as rank", "'t' as tile", "id % 7 as x", "id % 5 as y", "0L as cx", "0L as cy")
    beaten, best = H._best_of_cells(at)
    assert beaten.count() == 4999 and {(r.ordinal, abs(r.cx) <= 1, abs(r.cy) <= 1) for r in best.collect()} == {(0, True, True)} and best.count() == 8


def test_running_minima_only_where_singles_count(spark, monkeypatch):
    seen = []
    real = H.running_least
    monkeypatch.setattr(H, "running_least", lambda rows_, *a: seen.append(rows_.count()) or real(rows_, *a))
    pairs = [f"p{k} 99 chr1 {100 + k} 60 4M = 900 9 ACGT IIII MC:Z:4M ms:i:50" for k in range(50)]
    got = {r.ordinal: r.n for r in H.counts(sam(spark, *pairs, "s 0 chr1 100 60 4M * 0 0 ACGT IIII")).collect()}
    assert seen == [2] and sorted(got.values()) == [1] * 49 + [2]  # the pair at the single's place, and the single
