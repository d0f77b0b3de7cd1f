"""Best-fit packing of whole documents into training sequences, with large-item matching.

Packing only depends on lengths, and there are at most `capacity` of them. So the cluster counts the pieces of each
length, the driver packs that histogram (a few thousand steps at any corpus size), and each piece finds its place by
its rank among the pieces of its length. Bins are filled across the whole corpus, not within partitions.

Pieces above a third of the capacity are matched greedily, at most two to a bin: the largest with the largest that
fits beside it. Smaller pieces then go, in descending order, into the tightest gap that holds them.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import bpe
from .common import clean, materialize, small_batches

CAPACITY = 1024
END_ID = 2
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids binary"
#: Rows of one length that one task ranks; longer runs are dealt over more tasks.
RANKED = 500


def cut(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of n ids: only the first may be shorter."""
    return ([n % capacity] if n % capacity else []) + [capacity] * (n // capacity)


def tokenize(docs: DataFrame, capacity: int = CAPACITY, vocabulary: tuple | None = None, end_id: int = END_ID) -> DataFrame:
    """Pieces of the documents: doc_id, piece, start, length, ids (little-endian unsigned 32-bit).
    `vocabulary`: what bpe.encoder takes."""
    import numpy as np
    import pyarrow as pa

    files = vocabulary or bpe.default_vocabulary()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.encoder(*files)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encoder.ids(text or "")
                ids.append(end_id)
                data, start = np.array(ids, "<u4").tobytes(), 0
                for k, length in enumerate(cut(len(ids), capacity)):
                    for column, value in zip(out, (doc_id, k, start, length, data[4 * start : 4 * (start + length)]), strict=True):
                        column.append(value)
                    start += length
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                ["doc_id", "piece", "start", "length", "ids"],
            )

    return clean(docs, "doc_id", "text").mapInArrow(run, PIECES)


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """(length, first rank, rank after the last, first sequence, pieces per sequence, offset of the first) for each
    run of pieces that go alike into consecutive sequences; the number of sequences."""
    left, taken, slots, n = Counter(counts), Counter(), [], 0
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []  # gaps that some sequences have, ascending

    def place(length: int, base: int, bins: int, per: int, offset: int) -> None:
        slots.append((length, taken[length], taken[length] + bins * per, base, per, offset))
        taken[length] += bins * per
        left[length] -= bins * per

    def push(gap: int, base: int, bins: int) -> None:
        if gap and bins:
            if not gaps.setdefault(gap, []):
                insort(order, gap)
            gaps[gap].append((base, bins))

    large = sorted((x for x in counts if 3 * x > capacity), reverse=True)
    for a in large:
        while left[a]:
            b = next((b for b in large if b <= min(a, capacity - a) and left[b] > (b == a)), 0)
            bins = left[a] if not b else left[a] // 2 if a == b else min(left[a], left[b])
            if a == b:
                place(a, n, bins, 2, 0)
            else:
                place(a, n, bins, 1, 0)
                if b:
                    place(b, n, bins, 1, a)
            push(capacity - a - b, n, bins)
            n += bins
    for s in sorted((x for x in counts if 3 * x <= capacity), reverse=True):
        while left[s]:
            if (k := bisect_left(order, s)) < len(order):
                gap = order[k]
                base, bins = gaps[gap].pop()
                if not gaps[gap]:
                    order.pop(k)
            else:
                gap, base, bins = capacity, n, -(-left[s] // (capacity // s))
                n += bins
            per = min(gap // s, left[s])
            full = min(bins, left[s] // per)
            place(s, base, full, per, capacity - gap)
            push(gap - per * s, base, full)
            push(gap, base + full, bins - full)
    return slots, n


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    vocabulary: tuple | None = None,
    end_id: int = END_ID,
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """Every piece and its place: doc_id, piece, start, length, sequence_id, offset and the columns of `carry`, made
    from the piece's ids (by default the ids themselves); only those are shuffled.

    A null or empty text is the end id alone. A null doc_id stays null. Repeated rows are packed each. An empty
    table gives no rows. Ties in length are dealt by row number. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    pieces = materialize(tokenize(docs, capacity, vocabulary, end_id).withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    slots, _ = pack_histogram(counts, capacity)
    plan = spark.createDataFrame(slots, "slot_length bigint, first bigint, after bigint, base bigint, per bigint, at bigint")
    deals = F.array(*[F.lit(max(1, counts.get(n, 0) // RANKED)) for n in range(capacity + 1)])
    dealt = pieces.withColumn("deal", F.pmod("row", F.get(deals, F.col("length").cast("int")).cast("long")))
    before = Window.partitionBy("length").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("length", "deal").count().select(
        F.col("length").alias("n_length"), F.col("deal").alias("n_deal"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before")
    )
    carried = {"ids": F.col("ids")} if carry is None else carry
    narrow = dealt.select("doc_id", "piece", "start", "length", "deal", "row", *[c.alias(k) for k, c in carried.items()])
    numbered = narrow.withColumn("k", F.row_number().over(Window.partitionBy("length", "deal").orderBy("row")))
    ranked = numbered.join(starts, (F.col("length") == F.col("n_length")) & (F.col("deal") == F.col("n_deal"))).withColumn("rank", F.col("before") + F.col("k") - 1)
    # the plan has a few rows per length, whatever the input
    return ranked.join(
        F.broadcast(plan), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("after"))
    ).select(
        "doc_id", "piece", "start", "length",
        F.expr("base + (rank - first) div per").alias("sequence_id"),
        F.expr("at + (rank - first) % per * length").alias("offset"),
        *carried,
    )


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (little-endian unsigned 32-bit, at most `capacity`)."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.expr("aggregate(parts, cast('' AS binary), (a, x) -> concat(a, x.ids))").alias("ids"))
