"""Phrases whose words occur together more often than apart: counts of n-grams over deduplicated pieces of text.

Words are 64-bit hashes of language and word on the way. A window (a word that is frequent enough and the up to three frequent words that
follow it in its piece) goes to the bucket of its first two words, where DuckDB counts it and its beginnings, on disk
where memory ends. Parts of candidates find their counts by a join on the part.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import clean, materialize

LONGEST, LEAST, TOP = 4, 30, 2_000
SCORE, KEPT_BY, KEPT_OF = 2_000_000, 80, 100
#: Bits of the filter that tells frequent words: what is sent to the executors, whatever the corpus. Where it is full, more
#: windows go to the buckets than need to.
FILTER_BITS = 1 << 26
#: Words whose windows are put together before they are dealt out; windows of a bucket, on the average.
FLUSH, BUCKET = 1_000_000, 4_000_000
#: Windows in a row of what is dealt out: their words have numbers below 2^15.
ROW = 8_191
#: What DuckDB may take in a task before it writes to disk.
MEMORY = "256MB"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
IDS = ["i1", "i2", "i3", "i4"]


def pieces(docs: DataFrame) -> DataFrame:
    """lang, piece, m: each piece of the texts once, with the times that it occurs; its words are separated by one space."""
    lower = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    cut = F.explode(F.split(lower, r"[.,;:!?\x0A-\x0D]"))
    plain = clean(docs, "text", "lang").select(F.coalesce("lang", F.lit("und")).alias("lang"), cut.alias("piece"))
    piece = F.trim(F.regexp_replace("piece", r"[\x20\x09]+", " "))
    return plain.select("lang", piece.alias("piece")).where("piece <> ''").groupBy("lang", "piece").agg(F.count("*").alias("m"))


def word_id(word: bytes, lang: bytes) -> int:
    """Spark's xxhash64(lang, word)."""
    h = xxhash.xxh64_intdigest(word, xxhash.xxh64_intdigest(lang, 42))
    return (h - (1 << 64) if h >= 1 << 63 else h) or 1  # 0 is no word


def _split(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray, list[str]]]:
    """For each language of a batch: times and piece number of each word, and the words."""
    langs = batch.column("lang").dictionary_encode()
    codes = np.asarray(langs.indices)
    for k, lang in enumerate(langs.dictionary.to_pylist()):
        some = batch.take(pa.array(np.flatnonzero(codes == k)))
        lists = pc.split_pattern(some.column("piece"), " ")
        sizes = np.asarray(pc.list_value_length(lists))
        yield lang, np.repeat(np.asarray(some.column("m")), sizes), np.repeat(np.arange(len(sizes)), sizes), lists.flatten()


def word_counts(pieces_: DataFrame) -> DataFrame:
    """lang, word, id, f: how often each word occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, dict[str, int]] = {}
        for batch in batches:
            for lang, m, _, words in _split(batch):
                d = words.dictionary_encode()
                sums = np.zeros(len(d.dictionary), np.int64)
                np.add.at(sums, np.asarray(d.indices), m)
                own = seen.setdefault(lang, {})
                for w, n in zip(d.dictionary.to_pylist(), sums.tolist()):
                    own[w] = own.get(w, 0) + n
            if sum(map(len, seen.values())) > FLUSH // 4:
                yield from out(seen)
                seen = {}
        yield from out(seen)

    def out(seen: dict[str, dict[str, int]]) -> Iterator[pa.RecordBatch]:
        for lang, own in seen.items():
            words = list(own)
            yield pa.record_batch([pa.array([lang] * len(words)), pa.array(words, pa.string()), pa.array(list(own.values()), pa.int64())], names=["lang", "word", "f"])

    counted = pieces_.mapInArrow(count, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))
    return counted.withColumn("id", F.when(F.xxhash64("lang", "word") == 0, 1).otherwise(F.xxhash64("lang", "word")))


def word_filter(words: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, as 64-bit integers; set where a word of the table has its place. At most as many rows as integers
    come to the driver."""
    at = F.col("id").bitwiseAND(F.lit(FILTER_BITS - 1).cast("long"))
    bit = F.expr("shiftleft(1L, cast(at & 63 as int))")
    filled = words.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("k")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[np.asarray(filled["k"])] = np.asarray(filled["bits"])
    return out


def _windows(lang: str, m: np.ndarray, piece: np.ndarray, words: pa.Array, bits: np.ndarray, firsts: int) -> np.ndarray:
    """Columns i1 to i4 (0: none) and m of the windows that begin with one of the `firsts` first words and whose first two
    words are frequent."""
    d = words.dictionary_encode()
    head = lang.encode()
    ids = np.fromiter((word_id(w.encode(), head) for w in d.dictionary.to_pylist()), np.int64, len(d.dictionary))
    at = ids & (64 * len(bits) - 1)
    ids[(bits[at >> 6] >> (at & 63)) & 1 == 0] = 0
    ids = ids[np.asarray(d.indices)]
    columns = [ids]
    for k in range(1, LONGEST):
        nxt = np.zeros_like(ids)
        nxt[:-k] = np.where(piece[k:] == piece[:-k], ids[k:], 0)
        columns.append(np.where(columns[-1] != 0, nxt, 0))
    return np.stack([*columns, m])[:, (columns[1] != 0) & (np.arange(len(ids)) < firsts)]


def bucket_of(found: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """By the first two words; by three where both are hot, and by all four where these three are: no pair of words fills a bucket."""
    h = found[0].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + found[1].view(np.uint64)
    deal = np.isin(found[0], hot) & np.isin(found[1], hot)
    for k in (2, 3):
        h = np.where(deal, h * np.uint64(0x9E3779B97F4A7C15) + found[k].view(np.uint64), h)
        deal &= np.isin(found[k], hot)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(32))) % np.uint64(buckets)).astype(np.int32)


DEALT = "bucket int, words array<long>, " + ", ".join(f"w{k} array<smallint>" for k in range(1, 5)) + ", m array<long>"


def _dealt(found: np.ndarray, hot: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """The windows by bucket, like ones summed: rows with a dictionary of their own, in an order that packs well."""
    codes = pd.factorize(found[:4].ravel())[0].astype(np.int64).reshape(4, -1)
    pair = lambda a, b: pd.factorize(a << 32 | b)[0].astype(np.int64)
    key = pair(pair(codes[0], codes[1]), pair(codes[2], codes[3]))
    first, m = np.zeros(key.max() + 1, np.int64), np.zeros(key.max() + 1, np.int64)
    first[key[::-1]] = np.arange(len(key))[::-1]
    np.add.at(m, key, found[4])
    bucket, ahead = bucket_of(found[:, first], hot, buckets), pair(codes[0][first], codes[1][first])
    order = np.lexsort([ahead, bucket])
    first, m, bucket = first[order], m[order], bucket[order]
    ends = np.searchsorted(bucket, np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(ends)):
        for a in range(ends[b], ends[b + 1], ROW):
            part = first[a : min(a + ROW, ends[b + 1])]
            code, own = pd.factorize(found[:4, part].ravel())
            lists = [pa.array([own]), *[pa.array([c]) for c in code.reshape(4, -1).astype(np.int16)], pa.array([m[a : a + len(part)]])]
            yield pa.record_batch([pa.array([b], pa.int32()), *lists], names=["bucket", "words", "w1", "w2", "w3", "w4", "m"])


def _count_bucket(batches: Iterator[pa.RecordBatch], hot: list[int], least: int) -> Iterator[pa.RecordBatch]:
    """i1 to i4 (0: none) and a, for phrases of two to four words: those with `least`, and those of hot words alone, whose
    windows may lie in other buckets, too."""
    import duckdb

    schema = pa.schema([(c, pa.int64()) for c in (*IDS, "m")])

    def windows() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                words = np.asarray(batch.column("words")[k].values)
                columns = [words[np.asarray(batch.column(f"w{j}")[k].values)] for j in range(1, 5)]
                yield pa.record_batch([*map(pa.array, columns), batch.column("m")[k].values], schema=schema)

    with tempfile.TemporaryDirectory() as folder, duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": folder, "preserve_insertion_order": False}) as con:
        con.execute("CREATE TABLE hot (id BIGINT)")
        con.execute("INSERT INTO hot SELECT unnest(?::BIGINT[])", [hot])
        source = pa.RecordBatchReader.from_batches(schema, windows())  # noqa: F841 - named in the SQL
        con.execute("CREATE TABLE w AS SELECT i1, i2, i3, i4, sum(m)::BIGINT AS m FROM source GROUP BY ALL")
        is_hot = lambda *c: " AND ".join(f"{x} IN (FROM hot)" for x in c)
        for n in range(2, 5):
            own, rest = ", ".join(IDS[:n]), "".join(f", 0::BIGINT AS {c}" for c in IDS[n:])
            partial = f" OR ({is_hot(*IDS[:n])})" if n < 4 else ""
            yield from con.sql(f"SELECT {own}{rest}, sum(m)::BIGINT AS a FROM w WHERE {IDS[n - 1]} <> 0 GROUP BY {own} HAVING sum(m) >= {least}{partial}").to_arrow_reader(100_000)


def phrase_counts(spark: SparkSession, pieces_: DataFrame, frequent: DataFrame, total: int, least: int) -> DataFrame:
    """i1 to i4, a: the phrases of two to four words with `least` occurrences. Each of their words is in `frequent`."""
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET))
    # fewer than `buckets` words can be that frequent
    hot = np.array(sorted(r["id"] for r in frequent.where(F.col("f") > total // buckets).select("id").collect()), np.int64)
    sent = spark.sparkContext.broadcast(word_filter(frequent))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for lang, m, piece, words in _split(batch):
                for a in range(0, len(words), FLUSH):  # the words after a part are read with it, but begin no window of it
                    b = a + FLUSH + LONGEST - 1
                    held.append(_windows(lang, m[a:b], piece[a:b], words[a:b], sent.value, FLUSH))
                    n += held[-1].shape[1]
                    if n >= FLUSH:
                        yield from _dealt(np.concatenate(held, 1), hot, buckets)
                        held, n = [], 0
        if n:
            yield from _dealt(np.concatenate(held, 1), hot, buckets)

    dealt = pieces_.mapInArrow(deal, DEALT).repartitionById(buckets, "bucket")
    hot_list = hot.tolist()
    counted = dealt.mapInArrow(lambda batches: _count_bucket(batches, hot_list, least), ", ".join(f"{c} long" for c in (*IDS, "a")))
    return counted.groupBy(*IDS).agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def _cuts() -> Column:
    """k, left (or not) and words of each part of a phrase, for each place where it can be cut."""
    none = F.lit(0).cast("long")

    def part(k: int, left: bool, ids: list[str]) -> Column:
        words = [*[F.col(c) for c in ids], *[none] * (3 - len(ids))]
        return F.struct(F.lit(k).alias("k"), F.lit(left).alias("left"), *[w.alias(f"p{j + 1}") for j, w in enumerate(words)])

    of = lambda n: F.array(*[part(k, left, IDS[:k] if left else IDS[k:n]) for k in range(1, n) for left in (True, False)])
    return F.when(F.col("i4") != 0, of(4)).when(F.col("i3") != 0, of(3)).otherwise(of(2))


def score_cuts(asking: DataFrame, words: DataFrame, counts: DataFrame) -> DataFrame:
    """i1 to i4, a, lang, l, r, score of each phrase, by the cut that scores lowest, the first of equals. Each part asks for its
    count where that lies; what is asked for often is dealt over tasks as any skewed join is."""
    none = F.lit(0).cast("long")
    single = words.select(F.col("id").alias("p1"), none.alias("p2"), none.alias("p3"), "f", "lang")
    several = counts.where("i4 = 0").select(F.col("i1").alias("p1"), F.col("i2").alias("p2"), F.col("i3").alias("p3"), F.col("a").alias("f"), F.lit(None).cast("string").alias("lang"))
    asked = asking.select(*IDS, "a", F.inline(_cuts()))
    told = asked.join(single.unionByName(several), ["p1", "p2", "p3"])
    at = lambda k, left: F.max(F.when((F.col("k") == k) & (F.col("left") == left), F.col("f")))
    back = told.groupBy(*IDS, "a").agg(F.max("lang").alias("lang"), *[at(k, left).alias(f"{'l' if left else 'r'}{k}") for k in (1, 2, 3) for left in (True, False)])
    score = lambda k: F.expr(f"(cast(a as decimal(20,0)) * {SCORE}BD) div (cast(l{k} as decimal(20,0)) + cast(r{k} as decimal(20,0)))")
    cut = lambda k: F.when(F.col(f"l{k}").isNotNull(), F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
    lowest = F.array_min(F.array_compact(F.array(cut(1), cut(2), cut(3))))
    return back.withColumn("_cut", lowest).select(*IDS, "a", "lang", "_cut.l", "_cut.r", "_cut.score")


def without_contained(counts: DataFrame) -> DataFrame:
    """The phrases but for those that lie in a longer one with nearly as many occurrences."""
    none = F.lit(0).cast("long")
    pick = lambda *ids: F.struct(*[(F.col(ids[j]) if j < len(ids) else none).alias(c) for j, c in enumerate(IDS)])
    inner = F.when(F.col("i4") != 0, F.array(pick("i1", "i2"), pick("i2", "i3"), pick("i3", "i4"), pick("i1", "i2", "i3"), pick("i2", "i3", "i4"))).otherwise(F.array(pick("i1", "i2"), pick("i2", "i3")))
    nothing = F.lit(None).cast("long")
    longer = counts.where("i3 <> 0").select(F.col("a").alias("longer"), F.inline(inner)).withColumn("a", nothing)
    both = counts.withColumn("longer", nothing).unionByName(longer).groupBy(*IDS).agg(F.max("a").alias("a"), F.max("longer").alias("longer"))
    much = F.expr(f"cast(longer as decimal(20,0)) * {KEPT_OF}BD >= cast(a as decimal(20,0)) * {KEPT_BY}BD")
    return both.where(~F.coalesce(much, F.lit(False))).select(*IDS, "a")


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """docs (text, lang): lang, rank (from 1), phrase (words joined by spaces), a, l, r, n, score of each language's `top`
    collocations of two to four words.

    A to Z count as lower case; pieces end at .,;:!? and line ends, words are what blanks and tabs part. a: occurrences of the phrase,
    overlaps included, `least` or more; l, r: those of its two parts at the cut with the least score, the first of equals;
    n: words of the language; score: 2,000,000 a / (l + r), rounded down. A phrase that lies in a longer one with 80 % of its
    occurrences goes. Ties by a, then by the phrase's bytes. A null text is empty; a null lang is und, as is the lang of that
    name. Repeated rows and doc_ids count as often as they occur; other columns aren't read; no words give no rows.
    Two words of the corpus with the same 64-bit hash would be counted as one."""
    whole = materialize(pieces(docs), "pieces")
    words_in = F.length("piece") - F.length(F.replace(F.col("piece"), F.lit(" "), F.lit(""))) + 1
    totals = materialize(whole.groupBy("lang").agg(F.sum(F.col("m") * words_in).alias("n")), "totals")
    total = totals.agg(F.sum("n")).first()[0] or 0
    words = materialize(word_counts(whole).where(F.col("f") >= least), "words")
    counts = materialize(phrase_counts(docs.sparkSession, whole, words, total, least), "phrases")
    scored = score_cuts(without_contained(counts), words, counts)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    first = materialize(scored.withColumn("_rank", F.rank().over(order)).where(F.col("_rank") <= top).drop("_rank"), "first")  # and ties
    ids = F.filter(F.array(*IDS), lambda i: i != 0)
    spelled = first.select("*", F.posexplode(ids).alias("_at", "id")).join(words.select("id", "word"), "id")
    phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "word"))), lambda w: w["word"]), " ")
    named = spelled.groupBy(*IDS, "lang", "a", "l", "r", "score").agg(phrase.alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
