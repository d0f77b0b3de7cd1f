"""Language-model scoring by prediction by partial matching (PPM) over bytes, beside a unigram word model.

The corpus is counted once: each task counts the windows of ORDER + 1 bytes and the words of its documents, and the
sums are made by key. From the windows come the counts of all shorter contexts, all of which stay in a table. The most
frequent ones also make a trie that all workers hold; a window that it doesn't decide is looked up in the table by a
join, so the size of the trie changes no score.

A symbol that a context has costs (2c - 1) / 2n; otherwise the context's escape is paid and the next shorter one asked,
with the symbols of the longer one excluded. As every count of a longer context is also one of the shorter, what is
excluded depends on the longer context alone, so each node stores its excluded share beforehand.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import clean, materialize, sliced, small_batches

ORDER = 5
#: Bytes that no UTF-8 text has: before the first byte, after the last.
PAD, END = 0xFE, 0xFF
SYMBOLS = 256
#: Entries of the trie and words that are sent to all workers: 24 and 16 MB at most. What is beyond these is joined.
TRIE, HOT_WORDS = 1_500_000, 1_000_000
#: Direct-mapped memo of window costs in a worker.
MEMO_BITS = 20
FLUSH = 200_000
#: Documents at a time: a batch needs some 60 bytes for each of their bytes.
BATCH = 250
WORDS, WINDOWS = 0, 1
#: How often a context must have seen a symbol to have it; at 1 nothing that was seen is left out.
LEAST = 1
#: Orders with so few contexts that their tables are broadcast (65,792 entries at most), as many windows share each.
LOW = 1


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def hashes(tokens: list[bytes]):
    import numpy as np
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, tokens), np.uint64, len(tokens)).view(np.int64)


def end_key() -> int:
    """The end of a text as a token; a lone blank is no word."""
    return int(hashes([b" "])[0])


def windows(texts: list[str | None], order: int = ORDER):
    """The window that ends at each byte, and at the end, of each text; where each text begins."""
    import numpy as np

    data = [(t or "").encode() + bytes([END]) for t in texts]
    joined = np.frombuffer(b"".join(bytes([PAD]) * order + d for d in data), np.uint8).astype(np.int64)
    code = np.zeros(len(joined) - order, np.int64)
    for k in range(order + 1):
        code = (code << 8) | joined[k : len(joined) - order + k]
    sizes = np.array([len(d) for d in data])
    ends = np.cumsum(sizes + order) - order
    starts = ends - sizes
    keep = np.zeros(len(code) + 1, np.int8)
    np.add.at(keep, starts, 1)
    np.add.at(keep, ends, -1)
    return code[np.cumsum(keep[:-1]).astype(bool)], np.r_[0, np.cumsum(sizes)[:-1]]


def count(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """kind, key, count over all rows of docs (words with the end of each text, windows)."""
    import pyarrow as pa

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def out(kind, keys, counts):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int8)), pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], ["kind", "key", "count"])

        def merged(parts):
            keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            unique, at = np.unique(keys, return_inverse=True)
            return unique, np.bincount(at, weights=counts).astype(np.int64)

        seen: Counter[bytes] = Counter()
        parts, size, texts_n = [], 0, 0
        for batch in sliced(batches, BATCH):
            texts = batch.column(0).to_pylist()
            texts_n += len(texts)
            for t in texts:
                seen.update(words(t))
            if len(seen) > FLUSH:
                yield out(WORDS, hashes(list(seen)), np.fromiter(seen.values(), np.int64, len(seen)))
                seen.clear()
            parts.append(np.unique(windows(texts, order)[0], return_counts=True))
            size += len(parts[-1][0])
            if size > 4 * FLUSH:
                parts = [merged(parts)]
                size = len(parts[0][0])
                if size > 3 * FLUSH:
                    yield out(WINDOWS, *parts[0])
                    parts, size = [], 0
        if seen:
            yield out(WORDS, hashes(list(seen)), np.fromiter(seen.values(), np.int64, len(seen)))
        if parts:
            yield out(WINDOWS, *merged(parts))
        if texts_n:
            yield out(WORDS, [end_key()], [texts_n])

    return clean(docs, "text").mapInArrow(run, "kind tinyint, key bigint, count bigint").groupBy("kind", "key").agg(F.sum("count").alias("count"))


def threshold(table: DataFrame, most: int, least: int) -> int:
    """The smallest count, `least` at least, that no more than `most` rows of the table reach."""
    powers = table.select(F.least(F.floor(F.log2("count") * 4), F.lit(400)).alias("step")).groupBy("step").count().orderBy(F.desc("step")).collect()
    total, floor_step = 0, None
    for r in powers:
        total += r["count"]
        if total > most:
            break
        floor_step = r["step"]
    if total <= most:
        return least
    return 1 << 62 if floor_step is None else max(least, int(-(-(2 ** (floor_step / 4)) // 1)))


@dataclass
class Trie:
    """By order: sorted contexts, their escapes, their excluded shares, whether the trie has all their symbols; sorted
    context-and-symbol codes, their probabilities."""

    order: int
    contexts: list
    escapes: list
    excluded: list
    complete: list
    codes: list
    probabilities: list
    rest: float  # of a symbol that no context has
    whole: bool  # the trie has all contexts

    def costs(self, window):
        """log10 of the probability of the last byte of each window given those before; NaN where the answer depends on
        a context that the trie doesn't have, or not with all its symbols."""
        import numpy as np

        total = np.zeros(len(window))
        open_ = np.arange(len(window))
        out_of = np.zeros(len(window))  # what the next longer context excludes
        for j in range(self.order, -1, -1):
            code = window[open_] & ((1 << (8 * (j + 1))) - 1)
            context = code >> 8
            at = np.searchsorted(self.contexts[j], context)
            at[at == len(self.contexts[j])] = 0
            known = self.contexts[j][at] == context if len(self.contexts[j]) else np.zeros(len(code), bool)
            hit = np.searchsorted(self.codes[j], code)
            hit[hit == len(self.codes[j])] = 0
            found = self.codes[j][hit] == code if len(self.codes[j]) else np.zeros(len(code), bool)
            left = 1 - out_of[open_]
            if found.any():
                total[open_[found]] += np.log10(self.probabilities[j][hit[found]] / left[found])
            escaped = known & ~found
            if not self.whole:
                if len(self.contexts[j]):
                    escaped &= self.complete[j][at]
                total[open_[~found & ~escaped]] = np.nan
            if escaped.any():
                total[open_[escaped]] += np.log10(self.escapes[j][at[escaped]] / left[escaped])
                out_of[open_[escaped]] = self.excluded[j][at[escaped]]
            open_ = open_[~found if self.whole else escaped]
            if not len(open_):
                return total
        total[open_] += np.log10(self.rest)
        return total


def symbols(counts: DataFrame, order: int = ORDER, least: int = LEAST) -> DataFrame:
    """All contexts' symbols of the counted windows: j (order), code (context and symbol), count, n (of the context), low
    (the smallest count of the context's symbols)."""
    seen = counts.where(F.col("kind") == WINDOWS).select("key", "count", F.explode(F.sequence(F.lit(0), F.lit(order))).alias("j"))
    # a number in front keeps the orders apart; sums combine before the shuffle
    entries = seen.groupBy("j", tail("key", "j + 1").alias("code")).agg(F.sum("count").alias("count"))
    kept = (
        entries.groupBy("j", F.shiftright("code", 8).alias("context"))
        .agg(F.sum("count").alias("n"), F.collect_list(F.when(F.col("count") >= least, F.struct("code", "count"))).alias("kept"))  # 256 symbols at most
        .where(F.size("kept") > 0)
        .select("j", "n", F.array_min("kept.count").alias("low"), F.explode("kept").alias("e"))
    )
    return materialize(kept.select("j", F.col("e.code").alias("code"), F.col("e.count").alias("count"), "n", "low"), "contexts")


def tail(code: str, n: str) -> Column:
    """The last n bytes of a code."""
    return F.col(code).bitwiseAND(F.expr(f"shiftleft(1L, 8 * ({n})) - 1L"))


def trie(counts: DataFrame, order: int = ORDER, most: int = TRIE, least: int = LEAST) -> Trie:
    """The trie of the counted windows, `most` entries at most."""
    return hot_trie(symbols(counts, order, least), order, most, least)


def hot_trie(table: DataFrame, order: int, most: int, least: int) -> Trie:
    """The `most` most frequent of the symbols at most."""
    import numpy as np

    enough = threshold(table, most, least)
    rows = table.where(F.col("count") >= enough).select("j", "code", F.col("count").alias("c"), "n", (F.col("low") >= enough).alias("all")).toArrow()
    n_bytes = table.where("j = 0").count()
    j_all, code_all = rows["j"].to_numpy(), rows["code"].to_numpy()
    p_all, complete_all = (2 * rows["c"].to_numpy() - 1) / (2 * rows["n"].to_numpy()), rows["all"].to_numpy()
    contexts, escapes, codes, probabilities, excluded, complete = [], [], [], [], [], []
    for j in range(order + 1):
        mine = np.flatnonzero(j_all == j)
        mine = mine[np.argsort(code_all[mine])]
        c, p = code_all[mine], p_all[mine]
        ctx, first = np.unique(c >> 8, return_index=True)
        contexts.append(ctx)
        complete.append(complete_all[mine][first])
        codes.append(c)
        probabilities.append(p)
        escapes.append(1 - (np.add.reduceat(p, first) if len(p) else p))
        if j:
            low = np.searchsorted(codes[j - 1], c & ((1 << (8 * j)) - 1))
            excluded.append(np.add.reduceat(probabilities[j - 1][low], first) if len(p) else p)
        else:
            excluded.append(np.zeros(len(ctx)))
    return Trie(order, contexts, escapes, excluded, complete, codes, probabilities, 1 / max(1, SYMBOLS - 1 - n_bytes), enough <= least)


def costs_by_join(table: DataFrame, asked: DataFrame, order: int, rest: float) -> DataFrame:
    """window, cost for each (distinct) window of `asked`: what Trie.costs says, from the table of all symbols."""
    known = table.select("j", "code", F.shiftright("code", 8).alias("context"), ((2 * F.col("count") - 1) / (2 * F.col("n"))).alias("p"))
    # a symbol has 256 symbols of the next order above it at most, and a context 256 symbols, so no key is heavy
    shorter = known.select((F.col("j") + 1).alias("j"), F.col("code").alias("tail"), F.col("p").alias("q"))
    excluded = known.withColumn("tail", tail("code", "j")).join(shorter, ["j", "tail"], "left")
    contexts = materialize(excluded.groupBy("j", "context").agg((1 - F.sum("p")).alias("escape"), F.coalesce(F.sum("q"), F.lit(0.0)).alias("excluded")), "escapes")
    steps = asked.select("window", F.explode(F.sequence(F.lit(0), F.lit(order))).alias("j")).withColumn("code", tail("window", "j + 1")).withColumn("context", F.shiftright("code", 8))

    def looked_up(where: str, small: bool) -> DataFrame:
        sides = known.where(where).select("j", "code", "p"), contexts.where(where)
        one, two = map(F.broadcast, sides) if small else sides
        found = steps.where(where).join(one, ["j", "code"], "left").join(two, ["j", "context"], "left")
        return found.select("window", F.struct((-F.col("j")).alias("o"), "p", "escape", "excluded").alias("step"))

    both = looked_up(f"j <= {LOW}", True).union(looked_up(f"j > {LOW}", False))
    cost = F.expr(
        f"""aggregate(steps, named_struct('cost', 0D, 'out', 0D, 'done', false), (a, x) -> CASE
            WHEN a.done THEN a
            WHEN x.p IS NOT NULL THEN named_struct('cost', a.cost + log10(x.p / (1 - a.out)), 'out', a.out, 'done', true)
            WHEN x.escape IS NOT NULL THEN named_struct('cost', a.cost + log10(x.escape / (1 - a.out)), 'out', x.excluded, 'done', false)
            ELSE a END, a -> a.cost + IF(a.done, 0D, log10({rest!r}D)))"""
    )
    return both.groupBy("window").agg(F.sort_array(F.collect_list("step")).alias("steps")).select("window", cost.alias("cost"))


class Coster:
    """Costs of windows with a direct-mapped memo."""

    def __init__(self, model: Trie):
        import numpy as np

        self.np, self.model = np, model
        self.keys, self.values = np.full(1 << MEMO_BITS, -1, np.int64), np.zeros(1 << MEMO_BITS)

    def __call__(self, window):
        np = self.np
        slot = ((window.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - MEMO_BITS)).view(np.int64)
        out = self.values[slot]
        missed = np.flatnonzero(self.keys[slot] != window)
        if len(missed):
            fresh, back = np.unique(window[missed], return_inverse=True)
            cost = self.model.costs(fresh)
            out[missed] = cost[back]
            self.keys[slot[missed]], self.values[slot[missed]] = window[missed], out[missed]
        return out


def score(docs: DataFrame, train: Column, order: int = ORDER, least: int = LEAST) -> DataFrame:
    """doc_id, in_training, n_tokens, n_known, train_tokens, base_score, score (both log10) for every row of docs.

    The models learn from the rows where `train` holds; a null there counts as false. A null text counts as empty: its
    only token, and symbol, is the end. Repeated rows count and are scored each. Without training rows every word is
    unknown and every byte is equally likely. An empty table gives no rows. Words are told apart by 64-bit hashes.
    A symbol that a context has seen fewer than `least` times is part of the context's escape.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    small_batches(spark)
    mark = F.coalesce(train, F.lit(False))
    counts = materialize(count(docs.where(mark), order), "counts")
    vocabulary = counts.where(F.col("kind") == WORDS)
    total = vocabulary.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    enough = threshold(vocabulary, HOT_WORDS, 1)
    hot = vocabulary.where(F.col("count") >= enough).select("key", "count").toArrow()
    table = symbols(counts, order, least)
    model, base = hot_trie(table, order, TRIE, least), total["n"] + total["v"] + 1
    sent = spark.sparkContext.broadcast((model, hot["key"].to_numpy(), hot["count"].to_numpy()))
    whole, whole_trie, rest = enough <= 1, model.whole, model.rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        trie_, keys, hot_counts = sent.value
        order_ = np.argsort(keys)
        keys, logs = keys[order_], np.log10(hot_counts[order_] + 1.0)
        coster, end = Coster(trie_), np.array([end_key()])
        for batch in sliced(batches, BATCH):
            texts = batch.column(2).to_pylist()
            window, starts = windows(texts, order)
            cost = coster(window)
            left = np.flatnonzero(np.isnan(cost))
            cost[left] = 0
            scores = np.add.reduceat(cost, starts)
            open_ = pa.ListArray.from_arrays(pa.array(np.searchsorted(left, np.r_[starts, len(cost)]), pa.int32()), pa.array(window[left], pa.int64()))
            tokens = [np.r_[hashes(words(t)), end] for t in texts]
            sizes = np.array([len(t) for t in tokens])
            flat, offsets = np.concatenate(tokens), np.cumsum(sizes) - sizes
            at = np.searchsorted(keys, flat)
            at[at == len(keys)] = 0
            known = keys[at] == flat if len(keys) else np.zeros(len(flat), bool)
            sums = np.add.reduceat(np.where(known, logs[at], 0.0) if len(keys) else np.zeros(len(flat)), offsets)
            rare = [[] if whole else t[~known[o : o + n]] for t, o, n in zip(tokens, offsets, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(np.add.reduceat(known.astype(np.int64), offsets)), pa.array(sums), pa.array(scores), pa.array(rare, pa.list_(pa.int64())), open_],
                ["doc_id", "in_training", "n_tokens", "hot_known", "hot_sum", "hot_score", "rare", "open"],
            )

    schema = "doc_id bigint, in_training boolean, n_tokens bigint, hot_known bigint, hot_sum double, hot_score double, rare array<bigint>, open array<bigint>"
    marked = docs.select("doc_id", mark.alias("in_training"), "text")
    scored = materialize(marked.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    # what isn't among the hot words is looked up by a join; unknown words add nothing
    seldom = scored.select("row", F.explode("rare").alias("key")).groupBy("row", "key").count()
    cold = vocabulary.where(F.col("count") < enough).select("key", F.col("count").alias("c"))
    found = seldom.join(cold, "key").select("row", F.col("count").alias("known"), (F.col("count") * F.log10(F.col("c") + 1)).alias("sum"), F.lit(0.0).alias("cost"))
    if not whole_trie:  # so are the windows that the trie doesn't decide
        asked = materialize(scored.select("row", F.explode("open").alias("window")).groupBy("row", "window").count(), "asked")
        costs = costs_by_join(table, asked.select("window").distinct(), order, rest)
        found = found.union(asked.join(costs, "window").select("row", F.lit(0).cast("bigint"), F.lit(0.0), F.col("count") * F.col("cost")))
    found = found.groupBy("row").agg(F.sum("known").alias("cold_known"), F.sum("sum").alias("cold_sum"), F.sum("cost").alias("cold_score"))
    return scored.drop("rare", "open").join(found, "row", "left").select(
        "doc_id",
        "in_training",
        "n_tokens",
        (F.col("hot_known") + F.coalesce("cold_known", F.lit(0))).alias("n_known"),
        F.lit(total["n"]).cast("bigint").alias("train_tokens"),
        (F.col("hot_sum") + F.coalesce("cold_sum", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(base)))).alias("base_score"),
        (F.col("hot_score") + F.coalesce("cold_score", F.lit(0.0))).alias("score"),
    )
