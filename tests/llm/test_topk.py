"""Exact top-k against all inner products."""

import math
import random

from pyspark.sql import functions as F

from alnspark.llm import topk

SCHEMA = "vec_id long, embedding array<float>"


def every(rows, k):
    vectors = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v) in enumerate(vectors):
        if i % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(v, w)), j) for b, (j, w) in enumerate(vectors) if a != b)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def found(df, k=5):
    return sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0, k).collect()))


def test_all_inner_products(spark, monkeypatch):
    rnd = random.Random(2)
    rows = [(i, [rnd.choice([-1.0, 0.5, 0.25, rnd.gauss(0, 1)]) for _ in range(6)]) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)]  # one vector many times: ties
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df) == every(rows, 5)
    for name, value in (("QUERIES", 3), ("BLOCK", 2), ("STEP", 16), ("SAMPLE", 5), ("PIVOTS", 3)):
        monkeypatch.setattr(topk, name, value)
    assert found(df.repartition(3), 7) == every(rows, 7)


def test_bounds_are_never_below_the_score():
    import numpy as np

    x = np.random.default_rng(1).integers(-300, 300, (200, 8))
    norm, far = topk.distances(x, topk.farthest(x, 9))
    assert (topk.bounds(norm, far, norm, far) >= topk.scores(x, x)).all()


def test_candidates_behind_the_bound_are_not_scored(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(4)
    centres = rng.integers(-4000, 4000, (20, 8))
    x = np.repeat(centres, 200, 0) + rng.integers(-5, 5, (4000, 8))
    norm, far = topk.distances(x, topk.farthest(x, 32))
    table = {"row": np.arange(4000), "vec_id": np.arange(4000), "norm": norm, "far": far, "vector": x}
    q = {k: v[:1] for k, v in table.items()}
    compared = []
    monkeypatch.setattr(topk, "scores", lambda a, b, f=topk.scores: compared.append(len(b)) or f(a, b))
    best = topk._Best(1, 5, np.full(1, np.iinfo(np.int64).min))
    topk.search_rows(q, table, best)
    assert sum(compared) < 4000
    every_score = (x @ x[0])[1:]
    assert best.found[1].tolist() == sorted(every_score.tolist(), reverse=True)[:5]


def test_nulls_odd_vectors_repeats_and_empty_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, -2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (None, [9.0, 9.0]), (5, [0.5]), (6, []), (50, [0.001, -0.001])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df.withColumns({"rank": F.lit(1), "row": F.lit(2), "Score": F.lit(3)})) == every(rows, 5)
    assert found(df.limit(0)) == []
    assert found(df.where("vec_id = 50")) == []
    assert found(df.where("vec_id = 5")) == []


def test_large_components_are_exact_or_fail(spark):
    import pytest

    rows = [(0, [3.0e6 + 1, 1.0]), (1, [2.0**22 + 1, 0.0])]
    assert found(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) == [(0, 1, 1, (3 * 10**6 + 1) * 256 * (2**22 + 1) * 256)]
    with pytest.raises(Exception, match="64 bits"):
        found(spark.createDataFrame([(0, [1e14]), (1, [1e14])], SCHEMA))
