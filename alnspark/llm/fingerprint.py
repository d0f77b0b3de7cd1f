"""Document fingerprints by winnowing.

Rolling hashes of all k-grams of code points; of each window of w neighbouring hashes the smallest is taken, of equal
ones the rightmost. Any passage of w + k - 1 code points that two texts share gives both a common hash; positions are
kept, so a match can be shown in place.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import clean, materialize, small_batches

K, W = 20, 50
BASE = 0x9E3779B97F4A7C15
#: Neighbouring documents in a block, about; blocks at most.
BLOCK, HEADS = 400, 50_000


def code_points(text: str):
    import numpy as np

    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class Roller:
    """32-bit hashes of all k-grams, by differences of one running sum modulo 2**64."""

    def __init__(self, k: int = K):
        import numpy as np

        self.np, self.k, self.powers, self.inverse = np, k, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __call__(self, points):
        np = self.np
        n = len(points)
        if n < self.k:
            return np.empty(0, np.uint64)
        if len(self.powers) < n:
            size = 1 << (n - 1).bit_length()
            self.powers = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, BASE, np.uint64)], dtype=np.uint64)
            self.inverse = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, pow(BASE, -1, 1 << 64), np.uint64)], dtype=np.uint64)
        total = np.r_[np.uint64(0), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * self.inverse[:n], dtype=np.uint64)]
        h = (total[self.k :] - total[: -self.k]) * self.powers[: n - self.k + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h >> np.uint64(32)


def winnow(points, roller: Roller, w: int = W):
    """(hashes, positions) that the windows choose. A text of fewer than k code points, but one at least, counts as a
    single k-gram padded with zeros; one with fewer than w k-grams as a single window."""
    import numpy as np

    if not len(points):
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    if len(points) < roller.k:
        points = np.r_[points, np.zeros(roller.k - len(points), points.dtype)]
    h = roller(points)
    at = np.arange(len(h), dtype=np.uint64)
    key = (h << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - at)  # the smallest hash, then the rightmost
    width, low = 1, key
    w = min(w, len(h))
    while 2 * width <= w:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < w:
        low = np.minimum(low[: len(low) - (w - width)], low[w - width :])
    chosen = low[np.r_[True, low[1:] != low[:-1]]]
    return chosen >> np.uint64(32), np.uint64(0xFFFFFFFF) - (chosen & np.uint64(0xFFFFFFFF))


def encoded(hashes, positions) -> str:
    """16 hexadecimal digits for each chosen k-gram: its hash, its position."""
    return ((hashes << 32) | positions).astype(">u8").tobytes().hex()


def likeness(a, b) -> float:
    """Jaccard similarity of two arrays of distinct hashes; of two empty ones 1."""
    import numpy as np

    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) if len(a) or len(b) else 1.0


def fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """doc_id, n_chars, fingerprint of each row; no shuffle. A null text counts as empty, whose fingerprint is ''."""
    import pyarrow as pa

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller(k)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            prints = [encoded(*winnow(code_points(t), roller, w)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(prints, pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return clean(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, n_chars bigint, fingerprint string")


def in_order(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """block, key, carried, text, doc_id: partitions hold whole blocks of neighbours by doc_id, sorted; each block's
    last row is carried over from the next block (of the last block, from the first), so that a block can be read by
    itself. The text is shuffled once.

    Blocks begin at ids of the table, taken from the sorted ids alone; their number, HEADS at most, bounds what the
    driver gets. Rows of a block stream through a task, so larger blocks need no more memory.
    """
    keyed = clean(docs, "doc_id", "text").withColumn("key", F.coalesce("doc_id", F.lit(-(2**63))))
    ids = materialize(keyed.select("key").repartitionByRange("key").sortWithinPartitions("key").withColumn("m", F.monotonically_increasing_id()), "ids")
    each = max(block, ids.count() // (HEADS // 2) + 1)
    first = ids.agg(F.min("key")).first()[0]
    place = F.col("m").bitwiseAND((1 << 33) - 1)
    heads = sorted({r["key"] for r in ids.where(place % each == 0).select("key").distinct().collect()} | ({first} if first is not None else set()))

    @F.pandas_udf("block int, head boolean")
    def block_of(key: pd.Series) -> pd.DataFrame:
        import numpy as np
        import pandas as pd

        first = np.array(heads, np.int64)
        block = np.searchsorted(first, key.to_numpy(), side="right") - 1
        return pd.DataFrame({"block": block.astype(np.int32), "head": first[block] == key.to_numpy()})

    own = keyed.withColumn("b", block_of("key")).select("key", "doc_id", "text", "b.block", "b.head")
    before = F.when(F.col("block") == 0, len(heads) - 1).otherwise(F.col("block") - 1)
    copies = F.when(F.col("head"), F.array(F.struct(F.col("block"), F.lit(False).alias("carried")), F.struct(before.alias("block"), F.lit(True).alias("carried")))).otherwise(
        F.array(F.struct(F.col("block"), F.lit(False).alias("carried")))
    )
    dealt = own.select("key", "doc_id", "text", F.explode(copies).alias("to")).select(F.col("to.block"), F.col("to.carried"), "key", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return dealt.repartition("block").sortWithinPartitions("block", "carried", "key", "text")


PAIRS = "doc_id bigint, n_chars bigint, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def against_edited(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Each row's fingerprint, held against an edited text (its last quarter replaced by the beginning of the next
    document) and against the next document: doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited,
    near_next.

    Next is by doc_id, after the last the first; rows without a doc_id come first, rows that repeat one in order of
    their texts. A null text counts as empty. A single row is its own next. An empty table gives no rows.
    """
    import pyarrow as pa

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        roller = Roller(k)

        def chosen(text: str):
            hashes, positions = winnow(code_points(text), roller, w)
            return np.unique(hashes), encoded(hashes, positions)

        def rows() -> Iterable[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)
                yield None

        out: list[tuple] = []
        last = None  # block, doc_id, text, (hashes, fingerprint)
        for row in rows():
            if row is None:
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out = []
                continue
            block, carried, doc_id, text = row
            if carried and (last is None or last[0] != block):
                continue  # of several rows with the head's id only the first is anyone's next
            mine = chosen(text)
            if last is not None and last[0] == block:
                _, its_id, its_text, (hashes, print_) = last
                q = len(its_text) // 4
                edited = its_text[: len(its_text) - q] + text[:q]
                edited_hashes, edited_print = chosen(edited)
                out.append((its_id, len(its_text), edited, print_, edited_print, likeness(hashes, edited_hashes), likeness(hashes, mine[0])))
            last = None if carried else (block, doc_id, text, mine)

    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    names = [c.split()[0] for c in PAIRS.split(", ")]
    return in_order(docs).select("block", "carried", "doc_id", "text").mapInArrow(run, PAIRS)
