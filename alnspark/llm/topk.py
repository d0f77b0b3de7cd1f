"""Exact top-k by inner product, with a table of distances to pivots that bounds scores before vectors are compared."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import clean, materialize, sliced

#: Pivots, and the rows that they are chosen from (those with the smallest hashes; they also give the first thresholds).
PIVOTS, SAMPLE = 64, 2_048
#: Queries that are sent to the executors at once, queries whose bounds are worked out together, rows of a step.
QUERIES, BLOCK, STEP = 8_192, 64, 1_024
#: Integers up to here are exact as doubles, and as 64-bit integers.
DOUBLE, LONG = 2**53, 2**63


def scaled(vector: Column, factor: int) -> Column:
    """floor(factor * x) of each component, as x is in double; null for a vector that is null or holds a component that is
    null, infinite or not a number."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~odd, F.transform(vector, lambda x: F.floor(F.lit(factor) * x.cast("double"))))


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Integer vectors as rows of `width` columns; shorter ones end in zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, ends = np.asarray(lists.flatten(), np.int64), np.cumsum([0, *np.asarray(lists.value_lengths())])
    sizes = np.diff(ends)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    for k, (a, n) in enumerate(zip(ends[:-1], sizes)):
        out[k, :n] = flat[a : a + n]
    return out


def distances(vectors: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared norms, and distances to each pivot, in double."""
    x, p = vectors.astype(float), pivots.astype(float)
    norms = (x * x).sum(1)
    return norms, np.sqrt(np.maximum(norms[:, None] + (p * p).sum(1) - 2 * x @ p.T, 0))


def farthest(vectors: np.ndarray, count: int) -> np.ndarray:
    """At most `count` of the vectors, each the farthest from those taken before it; the first is the longest."""
    x = vectors.astype(float)
    taken, near = [], np.full(len(x), np.inf)
    at = int((x * x).sum(1).argmax()) if len(x) else 0
    while len(taken) < min(count, len(x)) and near[at] > 0:
        taken.append(at)
        near = np.minimum(near, ((x - x[at]) ** 2).sum(1))
        at = int(near.argmax())
    return vectors[taken]


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products, exact: by doubles where they hold every sum, by 64-bit integers where these do."""
    most = lambda m: max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0))))
    if (top := most(queries) * most(rows) * max(1, rows.shape[1])) < DOUBLE:
        return (queries.astype(float) @ rows.astype(float).T).astype(np.int64)
    if top >= LONG:
        raise OverflowError("inner products of these vectors may pass 64 bits")
    return queries @ rows.T


def bounds(norms_q: np.ndarray, to_q: np.ndarray, norms_x: np.ndarray, to_x: np.ndarray) -> np.ndarray:
    """The most that an inner product can be: |q - x| is at least the greatest difference of their distances to a pivot."""
    least = np.zeros((len(to_q), len(to_x)))
    for p in range(to_q.shape[1]):
        np.maximum(least, np.abs(to_q[:, p : p + 1] - to_x[:, p]), out=least)
    both = norms_q[:, None] + norms_x
    least = np.maximum(least - 1e-6 * np.sqrt(both) - 1e-3, 0)  # what rounding may have added
    return (both - least * least) * 0.5 + 1e-9 * both + 1


class _Best:
    """The best k of each query so far."""

    def __init__(self, queries: int, k: int, least: np.ndarray):
        self.k, self.least, self.found = k, least.copy(), [np.zeros(0, np.int64) for _ in range(4)]

    def add(self, *columns: np.ndarray) -> None:
        """query, score, vec_id, row of more candidates."""
        query, score, ids, row = (np.concatenate([a, b]) for a, b in zip(self.found, columns))
        order = np.lexsort([row, ids, -score, query])
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        order = order[place < self.k]
        self.found = [query[place < self.k], score[order], ids[order], row[order]]
        full = place[place < self.k] == self.k - 1
        np.maximum.at(self.least, self.found[0][full], self.found[1][full])


def search_rows(q: dict, rows: dict, best: _Best) -> None:
    """Candidates in the order of their bounds, for BLOCK queries at a time; a query ends where no bound that follows
    reaches its k-th score (a bound that equals it may be a tie)."""
    for a in range(0, len(q["row"]), BLOCK):
        part = slice(a, a + BLOCK)
        bound = bounds(q["norm"][part], q["far"][part], rows["norm"], rows["far"])
        order = np.argsort(-bound.max(0))
        ahead = np.maximum.accumulate(bound[:, order][:, ::-1], axis=1)[:, ::-1]  # the greatest bound from here on
        for b in range(0, len(order), STEP):
            alive = np.flatnonzero(ahead[:, b] >= best.least[part])
            if not len(alive):
                break
            some = order[b : b + STEP]
            score = scores(q["vector"][part][alive], rows["vector"][some])
            hit = (score >= best.least[part][alive][:, None]) & (q["row"][part][alive][:, None] != rows["row"][some])
            i, j = np.nonzero(hit)
            if len(i):
                best.add(a + alive[i], score[i, j], rows["vec_id"][some[j]], rows["row"][some[j]])


def _columns(batch, width: int) -> dict:
    far = batch.column("far")
    far = far.combine_chunks() if isinstance(far, pa.ChunkedArray) else far
    far = np.asarray(far.flatten()).reshape(batch.num_rows, len(far.flatten()) // max(1, batch.num_rows))
    return {
        "row": np.asarray(batch.column("row")), "vec_id": np.asarray(batch.column("vec_id")), "norm": np.asarray(batch.column("norm")),
        "vector": matrix(batch.column("vector"), width), "far": far,
    }


def pivot_table(vectors: DataFrame, factor: int = 256) -> tuple[DataFrame, dict, int]:
    """row, vec_id, vector (scaled integers), norm (squared), far (distances to the pivots), as a written table; the rows
    of the sample; the components of the longest vector. Rows without a vec_id, and vectors that `scaled` has nothing for,
    take no part. Shorter vectors count as ending in zeros."""
    kept = clean(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding"), factor).alias("vector"))
    kept = kept.where("vec_id is not null and vector is not null")
    sample = kept.orderBy(F.xxhash64("vec_id", "vector"), "vec_id", "vector").limit(SAMPLE).toArrow()
    width = kept.agg(F.max(F.size("vector"))).first()[0] or 0
    pivots = farthest(matrix(sample["vector"], width), PIVOTS)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 4 * STEP):
            norm, far = distances(matrix(batch.column("vector"), width), pivots)
            lists = pa.ListArray.from_arrays(np.arange(len(norm) + 1, dtype=np.int32) * len(pivots), far.ravel())
            yield pa.record_batch([batch.column("vec_id"), batch.column("vector"), pa.array(norm), lists], names=["vec_id", "vector", "norm", "far"])

    measured = kept.mapInArrow(measure, "vec_id long, vector array<long>, norm double, far array<double>")
    table = materialize(measured.withColumn("row", F.monotonically_increasing_id()), "pivots")
    norm, far = distances(matrix(sample["vector"], width), pivots)
    return table, {"vector": matrix(sample["vector"], width), "vec_id": np.asarray(sample["vec_id"]), "norm": norm, "far": far}, width


def first_thresholds(q: dict, sample: dict, k: int) -> np.ndarray:
    """The k-th best score in the sample, without the row that may be the query's own: no final one is below."""
    least = np.full(len(q["row"]), np.iinfo(np.int64).min)
    for a in range(0, len(least), BLOCK):
        score = scores(q["vector"][a : a + BLOCK], sample["vector"])
        own = q["vec_id"][a : a + BLOCK][:, None] == sample["vec_id"]
        score = np.where(own, np.iinfo(np.int64).min, score)
        if score.shape[1] >= k:
            least[a : a + BLOCK] = np.sort(score, 1)[:, -k]
    return least


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, factor: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row that is_query holds for, the k rows of all others with the
    greatest inner products of scaled vectors; ties go to the smaller vec_id. Fewer rows than k: all of them. Rows that
    share a vec_id are rows of their own, as queries and as candidates. Columns other than vec_id and embedding are not
    read. An empty table gives none.

    The pivot table is written once. Queries go to the executors QUERIES at a time; every task holds them against its own
    rows, so no vector is shuffled, only the best k of each task and query."""
    spark = vectors.sparkSession
    table, sample, width = pivot_table(vectors, factor)
    queries = materialize(table.where(is_query), "queries")
    total = queries.count()
    parts = -(-total // QUERIES)
    found = []
    for part in range(parts):
        some = queries.where(F.pmod(F.xxhash64("row"), F.lit(parts)) == part)  # QUERIES rows on the average
        q = _columns(some.toArrow(), width)
        sent = spark.sparkContext.broadcast((q, first_thresholds(q, sample, k)))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            q, least = sent.value
            best = _Best(len(q["row"]), k, least)
            for batch in sliced(batches, 2 * STEP):
                search_rows(q, _columns(batch, width), best)
            query, score, ids, row = best.found
            yield pa.record_batch([pa.array(c) for c in (q["row"][query], q["vec_id"][query], score, ids, row)], names=["q", "query_id", "score", "vec_id", "row"])

        near = table.mapInArrow(search, "q long, query_id long, score long, vec_id long, row long")
        found.append(near if parts == 1 else materialize(near, "near"))
    none = spark.createDataFrame([], "q long, query_id long, score long, vec_id long, row long")
    best = reduce(DataFrame.unionByName, found) if found else none
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id", "row")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
