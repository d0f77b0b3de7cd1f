"""Near duplicates by min-max hashing, every link confirmed on the full shingle sets.

1. One Python pass turns each text into the set of its word shingles (64-bit hashes), the set's 128-bit key and band
   hashes: under each permutation both the minimum and the maximum are kept, so one evaluation gives two values.
2. Equal sets are one class with one number; a group of copies is never expanded.
3. In each bucket every class is held against the bucket's pivot, its smallest number: first against the one pivot that
   most of its bands name, then, what that doesn't join, against its others. The members of a pivot are dealt over
   tasks, to each of which the pivot's set goes along. This joins near copies in time linear in the bucket.
4. What is left are buckets that hold more than one component. In these the classes outside of the pivot's component are
   held against all others, block by block, by an inverted index; buckets with the same members count once. So every
   pair that shares a bucket is either joined already or compared, and no task holds more than two blocks of sets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

from pyspark.sql import DataFrame, functions as F

from .common import HOT_KEYS, HOT_ROWS, clean, hot_counts, hot_keys, join_salted, keep_by_id, materialize, small_batches
from .graph import components

NGRAM = 5
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: 50 bands of 6 values: a pair at 0.75 shares no band with probability 6e-5, at 0.3 it shares one with 4 %.
BANDS, ROWS = 50, 6
#: Members of a pivot in one task.
MEMBERS = 500
#: Shingles in a block of a bucket; a task holds two blocks.
BLOCK_SHINGLES = 250_000
SEED = 8


def shingles(text: str | None, ngram: int = NGRAM):
    """Sorted distinct 64-bit hashes of the word n-grams (A-Z lower-cased); of all the words if fewer; empty without words."""
    import numpy as np
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < ngram:
        return np.array([xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    out = np.zeros(len(words) - ngram + 1, np.uint64)
    for k in range(ngram):
        out = (out ^ h[k : len(words) - ngram + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


class MinMax:
    """Band hashes of a shingle set: BANDS signed 64-bit integers."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = SEED):
        import numpy as np

        rng = np.random.default_rng(seed)
        n = -(-bands * rows // 2)
        self.np, self.shape = np, (bands, rows)
        self.a = rng.integers(0, 2**31, n, np.uint32) * np.uint32(2) + np.uint32(1)
        self.c = rng.integers(0, 2**32, n, np.uint32)
        self.band = rng.integers(0, 2**63, bands, np.uint64)

    def __call__(self, hashes):
        np = self.np
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        low, high = [], []
        step = max(1, (1 << 20) // len(x))
        for k in range(0, len(self.a), step):
            y = x * self.a[k : k + step, None] + self.c[k : k + step, None]
            low.append(y.min(axis=1))
            high.append(y.max(axis=1))
        values = np.stack([np.concatenate(low), np.concatenate(high)], 1).ravel()[: self.shape[0] * self.shape[1]].reshape(self.shape).astype(np.uint64)
        key = self.band.copy()
        for k in range(self.shape[1]):
            key = (key ^ values[:, k]) * np.uint64(0xD6E8FEB86659FD93)
            key ^= key >> np.uint64(32)
        return key.view(np.int64)


def signatures(docs: DataFrame, ngram: int = NGRAM) -> DataFrame:
    """doc_id, n_shingles, set_key (null for an empty set), bands."""
    import pyarrow as pa

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        minmax = MinMax()
        for batch in batches:
            n, keys, bands = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text, ngram)
                n.append(len(s))
                keys.append(xxh3_128_digest(s.tobytes()) if len(s) else None)
                bands.append(minmax(s) if len(s) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set_key", "bands"],
            )

    return clean(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, set_key binary, bands array<bigint>")


def linked(common, size, sizes, percent: int):
    return (100 * common >= percent * (size + sizes - common)) & (common > 0)


def links_between(queries: list[tuple], members: list[tuple], percent: int = PERCENT) -> list[tuple[int, int]]:
    """(query, member) that are linked, for (id, label, set) of both: those that join labels not joined yet here.

    All intersections come from an inverted index over the members. Pairs that links or labels have joined are left out.
    """
    import numpy as np

    ids = np.array([m[0] for m in members])
    sizes = np.array([len(m[2]) for m in members])
    names, label = np.unique([m[1] for m in members] + [q[1] for q in queries], return_inverse=True)
    label, mine = label[: len(members)].copy(), label[len(members) :].copy()
    tokens, owner = np.concatenate([m[2] for m in members]), np.repeat(np.arange(len(members)), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    found = []
    for k, (id_, _, wanted) in enumerate(queries):
        open_ = label != mine[k]
        if not open_.any():
            continue
        first, last = np.searchsorted(tokens, wanted), np.searchsorted(tokens, wanted, side="right")
        counts = last - first
        steps = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)
        common = np.bincount(owner[steps], minlength=len(members))
        for m in np.flatnonzero(linked(common, len(wanted), sizes, percent) & open_):
            if label[m] != mine[k]:
                found.append((id_, int(ids[m])))
                old, new = label[m], mine[k]
                label[label == old] = new
                mine[mine == old] = new
    return found


def _sets(docs: DataFrame, wanted: DataFrame, ngram: int) -> DataFrame:
    """id and set (little-endian 64-bit) of the classes in `wanted` (id, doc_id, set_key). Of rows that repeat a doc_id
    those with the class's own set count."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            sets = [shingles(t, ngram).astype("<u8").tobytes() for t in batch.column(2).to_pylist()]
            keep = pa.array([xxh3_128_digest(s) == k for s, k in zip(sets, batch.column(1).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "set"]).filter(keep)

    texts = keep_by_id(clean(docs, "doc_id", "text"), wanted, "doc_id").select("id", "set_key", "text")
    return materialize(texts.mapInArrow(run, "id bigint, set binary").dropDuplicates(["id"]), "sets")


def _streamed(batches: Iterator, columns: int) -> Iterable[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(k).to_pylist() for k in range(columns)), strict=True)


def against_pivots(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges (a, its pivot b) that are links. MEMBERS members of a pivot, about, go to a task, and its set with them."""
    import pyarrow as pa

    deals = edges.groupBy("b").count().select("b", F.ceil(F.col("count") / MEMBERS).cast("int").alias("deals"))
    deals = materialize(deals, "deals")
    of_pivot = sets.withColumnRenamed("id", "b").join(deals, "b").select("b", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), F.lit(None).cast("bigint").alias("a"), "set")
    many = deals.where("deals > 1")
    dealt = join_salted(edges, many, "b", hot_keys(edges, "b"), "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("deals", F.lit(1))).cast("int").alias("deal"))
    of_members = dealt.join(sets.withColumnRenamed("id", "a"), "a").select("b", "deal", "a", "set")
    together = of_pivot.union(of_members).repartition("b", "deal").sortWithinPartitions("b", "deal", F.asc_nulls_first("a"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        pivot = set_ = None
        for batch in batches:
            out: tuple[list[int], list[int]] = ([], [])
            for b, _, a, data in _streamed(iter([batch]), 4):
                mine = np.frombuffer(data, "<u8")
                if a is None:
                    pivot, set_ = b, mine
                elif b == pivot and 100 * min(len(mine), len(set_)) >= percent * max(len(mine), len(set_)):
                    common = len(np.intersect1d(mine, set_, assume_unique=True))
                    if linked(common, len(mine), len(set_), percent):
                        out[0].append(a)
                        out[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])

    return together.mapInArrow(run, "a bigint, b bigint")


def within_buckets(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components within buckets; members: bucket, id, label, n. The pivot has been held against all."""
    import pyarrow as pa

    # the members' numbers, folded, tell which buckets are alike
    whole = members.groupBy("bucket").agg(
        F.min(F.struct("id", "label")).alias("p"), F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size"), F.sum("n").alias("n"),
        F.bit_xor(F.xxhash64("id")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("s2"),
    )
    mixed = whole.where("low <> high and size > 2").select("bucket", F.col("p.id").alias("pivot"), F.col("p.label").alias("main"), "n", "size", "s1", "s2")
    mixed = materialize(mixed.groupBy("size", "s1", "s2").agg(F.min(F.struct("bucket", "pivot", "main", "n", "size")).alias("x")).select("x.*"), "mixed")
    hot = hot_counts(mixed.select("bucket", F.col("size").alias("count")), "bucket", HOT_ROWS)
    inside = join_salted(members.withColumnRenamed("n", "own"), mixed.drop("size"), "bucket", hot).where("id <> pivot")
    inside = materialize(inside.select("bucket", "id", "label", "own", "n", (F.col("label") != F.col("main")).alias("asks")), "inside")
    asking = inside.where("asks").groupBy("bucket").agg(F.sum("own").alias("asked"), F.max("n").alias("n"))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK_SHINGLES).cast("int")
    shape = asking.select("bucket", blocks("asked").alias("rows"), blocks("n").alias("columns"))
    placed = join_salted(inside.select("bucket", "id", "label", "asks"), shape, "bucket", hot)
    row, column = F.pmod(F.xxhash64("id"), F.col("rows")).cast("int"), F.pmod(F.xxhash64("id"), F.col("columns")).cast("int")
    to = lambda r, c, ask: F.struct(r.alias("i"), c.alias("j"), F.lit(ask).alias("ask"))
    as_member = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda r: to(r, column, False))
    as_query = F.when(F.col("asks"), F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda c: to(row, c, True))).otherwise(F.array().cast("array<struct<i:int,j:int,ask:boolean>>"))
    tasks = placed.select("bucket", "id", "label", F.explode(F.concat(as_member, as_query)).alias("t")).select("bucket", "t.i", "t.j", "t.ask", "id", "label")
    dealt = tasks.join(sets, "id").select("bucket", "i", "j", "ask", "id", "label", "set").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "ask", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for _, group in groupby(_streamed(batches, 7), key=lambda r: r[:3]):
            sides: tuple[list, list] = ([], [])
            for r in group:
                sides[r[3]].append((r[4], r[5], np.frombuffer(r[6], "<u8")))
            if sides[0] and sides[1] and (found := links_between(sides[1], sides[0], percent)):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint")


def _labels(ids: DataFrame, confirmed: DataFrame) -> DataFrame:
    """id, n, label of all `ids` (id, n), by what is confirmed."""
    return materialize(ids.join(components(confirmed).withColumnRenamed("component", "label"), "id", "left").select("id", "n", F.coalesce("label", "id").alias("label")), "labelled")


def classified(docs: DataFrame, percent: int = PERCENT, ngram: int = NGRAM) -> DataFrame:
    """doc_id, n_shingles, set_key and component_id for every row of docs: set_key stands for the row's shingle set (null
    for an empty one), component_id is the smallest doc_id of the component."""
    sig = materialize(signatures(docs, ngram), "signatures")
    full = sig.where("set_key is not null and doc_id is not null")
    classes = full.groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = materialize(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    members = classes.select("id", F.explode("bands").alias("bucket"))
    buckets = materialize(members.groupBy("bucket").agg(F.min("id").alias("pivot"), F.count("*").alias("count")).where("count > 1"), "buckets")
    hot = hot_counts(buckets.select("bucket", "count"), "bucket", max(HOT_ROWS, classes.count() * BANDS // HOT_KEYS))
    met = materialize(join_salted(members, buckets.drop("count"), "bucket", hot), "met")
    # of each class its pivots, with how many of its bands name them
    edges = materialize(met.where("id <> pivot").groupBy(F.col("id").alias("a"), F.col("pivot").alias("b")).agg(F.count("*").alias("times")), "pivots")
    clustered = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    clustered = materialize(classes.select("id", "n", "doc_id", "set_key").join(clustered, "id", "left_semi"), "clustered")
    sets, ids = _sets(docs, clustered.drop("n"), ngram), clustered.select("id", "n")
    best = materialize(edges.groupBy("a").agg(F.max(F.struct("times", (-F.col("b")).alias("b"))).alias("x")).select("a", (-F.col("x.b")).alias("b")), "best")
    first = materialize(against_pivots(best, sets, percent), "links")
    label = _labels(ids, first).drop("n")
    rest = edges.drop("times").join(label.select(F.col("id").alias("a"), F.col("label").alias("la")), "a")
    rest = join_salted(rest, label.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b", hot_keys(edges, "b")).where("la <> lb").select("a", "b")
    second = against_pivots(materialize(rest.join(best, ["a", "b"], "left_anti"), "rest"), sets, percent)
    second = materialize(first.union(second), "links")
    third = within_buckets(met.select("bucket", "id").join(_labels(ids, second), "id"), sets, percent)
    label = _labels(ids, materialize(second.union(third), "links"))
    # the smallest doc_id of each component is its name; rows of one class are joined by the class
    of = materialize(classes.select("id", "set_key", "doc_id").join(label, "id", "left").withColumn("label", F.coalesce("label", "id")), "of")
    smallest = of.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    names = materialize(join_salted(of.select("label", "set_key"), smallest, "label", hot_keys(of, "label")).select("set_key", "component_id"), "names")
    found = join_salted(sig.drop("bands"), names, "set_key", hot_keys(sig, "set_key"), "left")
    return found.select("doc_id", "n_shingles", "set_key", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, ngram: int = NGRAM) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Null, empty or blank text: empty set, its own component, kept. Fewer words than a shingle: one shingle of all.
    Each row that repeats a doc_id stands for its own text. A null doc_id takes no part: component_id null, kept. An
    empty table gives no rows. Only doc_id and text are read.
    """
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return classified(docs, percent, ngram).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def deduplicate(docs: DataFrame, percent: int = PERCENT, ngram: int = NGRAM) -> DataFrame:
    """docs with one document of each component: the one with the smallest doc_id. Rows without a doc_id stay, and so do
    rows without words. Of rows that repeat a doc_id each is judged by its own text; of those that stay and have one set
    of shingles, or no words, the one with the smallest text stays."""
    found = materialize(classified(docs, percent, ngram).where("doc_id is not null"), "components")
    gone = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    repeated = found.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not repeated.limit(1).count():
        return keep_by_id(docs, gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = materialize(repeated, "repeated")
    single = keep_by_id(keep_by_id(docs, gone, "doc_id", "left_anti"), repeated, "doc_id", "left_anti").select(*docs.columns)
    return single.unionByName(_of_repeated(docs, found, repeated, ngram))


def _of_repeated(docs: DataFrame, found: DataFrame, repeated: DataFrame, ngram: int) -> DataFrame:
    """What stays of the rows whose doc_id is repeated."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            sets = [shingles(t, ngram) for t in batch.column(1).to_pylist()]
            keys = pa.array([xxh3_128_digest(s.tobytes()) if len(s) else b"" for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], keys], ["doc_id", "text", "set_key"])

    few = materialize(keep_by_id(docs, repeated, "doc_id", "left_semi").select("doc_id", "text", F.struct(*docs.columns).alias("whole")), "repeats")
    keyed = few.select("doc_id", "text").distinct().mapInArrow(run, "doc_id bigint, text string, set_key binary")
    stays = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id", F.coalesce("set_key", F.lit(b"")).alias("set_key")).distinct()
    text = F.coalesce("text", F.lit(""))
    first = keyed.join(stays, ["doc_id", "set_key"], "left_semi").groupBy("doc_id", "set_key").agg(F.min(text).alias("t")).drop("set_key")
    rows = few.withColumn("t", text).join(first, ["doc_id", "t"])
    return rows.groupBy("doc_id", "t").agg(F.min_by("whole", F.to_json("whole")).alias("whole")).select("whole.*")
