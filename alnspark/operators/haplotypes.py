"""Phasing by local haplotypes: the path of alleles that most templates agree with over windows of k sites.

A block is a run of heterozygous sites that templates bridge. Long blocks are cut into pieces that overlap; a piece's path is found by itself
and turned to the one before it by their common sites, so neither a reference nor a block has to be one task. What the
paths are made from are windows of alleles with their counts: like windows of templates are combined before the shuffle.
A record, and then a template, is one row with the numbers of its sites; no base of it is a row of its own.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import cigar as C, flags as FL, ragged as G, tags as T
from ..functions.hashes import x31
from ..sources.scratch import written
from . import columns as L, models as M
from .filters import span

#: Sites of a window; sites of a piece, and how many it has in common with the next.
WINDOW, PIECE, OVERLAP = 13, 1_000, 100
#: Bases of a stretch whose sites are numbered together.
STRETCH = 1 << 20
#: Bases of a chunk of marks; sites of a chunk of paths, and of all paths together up to which they are sent to the executors.
CHUNK, PATH, BROADCAST_SITES = 1_024, 4_096, 16 << 20
# What tells a chimera from errors, and a doubtful region.
FLIP_PENALTY, FLIP_LEAST, FLIP_EACH, MASK_LEAST = 2, 4, 3, 3


def sites(df: DataFrame, least_lod: int = M.HET_LOD, **options) -> DataFrame:
    """chrom, pos, low, high: sites whose best genotype has two bases and is that much better than the next one."""
    c = M.calls(df, **options)
    a, b = F.substr("best", F.lit(1), F.lit(1)), F.substr("best", F.lit(2), F.lit(1))
    return c.where((a != b) & (F.floor(F.col("lod") + 0.499) >= least_lod)).select("chrom", "pos", b.alias("low"), a.alias("high"))


def numbered(sites_: DataFrame) -> DataFrame:
    """sites with n, their number on the reference from 0. Stretches are numbered apart and then shifted by those before them."""
    x = sites_.withColumn("_s", F.floor(F.col("pos") / STRETCH))
    x = x.withColumn("_k", F.row_number().over(Window.partitionBy("chrom", "_s").orderBy("pos")) - 1)
    before = F.sum("n").over(Window.partitionBy("chrom").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))
    shift = x.groupBy("chrom", "_s").agg(F.count("*").alias("n")).select("chrom", "_s", F.coalesce(before, F.lit(0)).alias("_n0"))
    return x.join(shift, ["chrom", "_s"]).select(*sites_.columns, (F.col("_k") + F.col("_n0")).cast("int").alias("n"))


def _marked(df: DataFrame, sites_: DataFrame) -> DataFrame:
    """df (chrom, start0, end0, src, ordinal, ...) with marks, a letter for each base of the span: A to P tells the two bases of a site, a
    dot is none; and n, the number of the first site there. Records without sites go. A record meets the chunk that it begins in, which
    brings the next one along; only records that reach further are put together from all their chunks."""
    dots = F.repeat(F.lit("."), CHUNK)
    letter = F.substr(F.lit("ABCDEFGHIJKLMNOP"), 4 * F.instr(F.lit("ACGT"), F.col("low")) + F.instr(F.lit("ACGT"), F.col("high")) - 4, F.lit(1))
    x = sites_.select("chrom", F.floor((F.col("pos") - 1) / CHUNK).alias("_chunk"), F.pmod(F.col("pos") - 1, F.lit(CHUNK)).cast("int").alias("k"), letter.alias("c"), "n")
    x = x.groupBy("chrom", "_chunk").agg(F.array_sort(F.collect_list(F.struct("k", "c"))).alias("_m"), F.min("n").alias("_n"))
    text = F.aggregate("_m", F.lit(""), lambda t, e: F.concat(t, F.repeat(F.lit("."), e["k"] - F.length(t)), e["c"]))
    own = x.select("chrom", "_chunk", F.rpad(text, CHUNK, ".").alias("_own"), "_n")
    both = own.withColumn("_next", F.lit(None).cast("string")).unionByName(own.select("chrom", (F.col("_chunk") - 1).alias("_chunk"), F.lit(None).cast("string").alias("_own"), "_n", F.col("_own").alias("_next")))
    both = both.groupBy("chrom", "_chunk").agg(F.concat(F.coalesce(F.max("_own"), dots), F.coalesce(F.max("_next"), dots)).alias("_text"), F.min("_n").alias("_n"))

    width = 2 * CHUNK

    def counted(batches):  # _before: how many sites come before each base
        for batch in batches:
            text, at, size = G.text(batch["_text"])
            site = text[G.places(at, size)].reshape(-1, width) != ord(".")
            before = np.cumsum(np.pad(site, ((0, 0), (1, 0))), axis=1).astype(np.int16)
            yield pa.record_batch([batch["chrom"], batch["_chunk"], batch["_text"].cast(pa.binary()), batch["_n"], pa.ListArray.from_arrays(pa.array(np.arange(0, before.size + 1, width + 1, dtype=np.int32)), pa.array(before.reshape(-1)))], names=["chrom", "_chunk", "_text", "_n", "_before"])

    both = both.mapInArrow(counted, "chrom string, _chunk long, _text binary, _n int, _before array<short>")
    first, last = F.floor(F.col("start0") / CHUNK), F.floor((F.col("end0") - 1) / CHUNK)
    ahead = (F.col("start0") - first * CHUNK).cast("int")
    length = (F.col("end0") - F.col("start0")).cast("int")
    before = lambda k: F.element_at("_before", k + 1)
    short = df.where(last - first <= 1).withColumn("_chunk", first).join(both, ["chrom", "_chunk"]).where(before(ahead + length) > before(ahead))
    short = short.withColumns({"marks": F.substr("_text", ahead + 1, length), "n": F.col("_n") + before(ahead)}).drop("_chunk", "_text", "_n", "_before")
    keys, long = ["src", "ordinal", "chrom", "start0", "end0"], df.where(last - first > 1)
    parts = long.select(*keys, F.explode(F.sequence(first, last)).alias("_chunk")).join(own, ["chrom", "_chunk"])
    parts = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_chunk", "_own"))).alias("_m"), F.min("_n").alias("_n"))
    whole = F.aggregate("_m", F.lit(""), lambda t, e: F.concat(t, F.repeat(F.lit("."), ((e["_chunk"] - first) * CHUNK - F.length(t)).cast("int")), e["_own"]))
    count = lambda t: F.length(F.replace(t, F.lit(".")))
    told = {"marks": F.substr("_text", ahead + 1, length), "n": F.col("_n") + count(F.substr("_text", F.lit(1), ahead))}
    long = long.join(parts.withColumn("_text", whole).select(*keys, "_text", "_n"), keys).withColumns(told).where(count(F.col("marks")) > 0)
    return short.unionByName(long.drop("_text", "_n").withColumn("marks", F.col("marks").cast("binary")))


def _merged(batches):
    """chrom, qname, lo, hi, seen of templates, from their records: at a site of several the later record counts."""
    for batch in batches:
        records = batch["r"].flatten()
        of = np.repeat(np.arange(batch.num_rows), np.diff(batch["r"].offsets.to_numpy()))
        src, ordinal = (records.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("src", "ordinal"))
        order = np.lexsort((ordinal, src, of))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        lists = records.field("seen")
        seen = lists.flatten().to_numpy().astype(np.int64)
        record = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        order = np.lexsort((rank[record], seen >> 2, of[record]))
        seen, row = seen[order], of[record][order]
        last = np.append((seen[1:] >> 2 != seen[:-1] >> 2) | (row[1:] != row[:-1]), True) if len(row) else np.zeros(0, bool)
        ends = np.append(0, np.cumsum(np.bincount(row[last], minlength=batch.num_rows)))
        told = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(seen[last].astype(np.int32)))
        yield pa.record_batch([*(batch[c] for c in ("chrom", "qname", "lo", "hi")), told], names=["chrom", "qname", "lo", "hi", "seen"])


def observed(df: DataFrame, sites_: DataFrame, min_mapq: int = 0) -> DataFrame:
    """chrom, qname, lo, hi, seen: of each template that has sites (numbered) the first and last position, and all in order: four times
    the number and 1 (low), 2 (high) or 0 (another base). Records of mapping quality 0 don't count. A record is a row until here, not
    each of its bases."""
    kept = df.where(FL.flag_filter(F.col("flag"), exclude=FL.DEPTH_MASK) & (F.coalesce("mapq", F.lit(0)) >= max(min_mapq, 1))).where("rname is not null and pos is not null and cigar is not null")
    x = kept.select(F.col("rname").alias("chrom"), "qname", "src", "ordinal", "pos", "cigar", "seq", (F.col("pos") - 1).alias("start0"))
    x = x.withColumn("end0", F.col("start0") + F.greatest(C.text_reference_length(F.col("cigar")), F.lit(1)))
    x = _marked(x, sites_).select("chrom", "qname", "src", "ordinal", "pos", "cigar", "seq", "marks", "n").mapInArrow(L.site_codes, L.CODED)
    x = x.groupBy("chrom", "qname").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.collect_list(F.struct("src", "ordinal", "seen")).alias("r"))
    return x.mapInArrow(_merged, "chrom string, qname string, lo long, hi long, seen array<int>")


def blocks(sites_: DataFrame, seen: DataFrame) -> DataFrame:
    """sites with block (its first position), i (from 0 in the block), size. A site begins a block unless a template that was seen at an earlier
    one is seen here or later. Stretches are numbered apart and then shifted by those before them."""
    return blocks_of_ends(sites_, seen.groupBy("chrom", "qname").agg(F.min("pos").alias("first"), F.max("pos").alias("last")))


def blocks_of_ends(sites_: DataFrame, ends: DataFrame) -> DataFrame:
    """blocks, from the first and last position of each template."""
    at = ends.groupBy("chrom", F.col("first").alias("pos")).agg(F.count("*").alias("net"))
    at = at.unionByName(ends.groupBy("chrom", F.col("last").alias("pos")).agg((-F.count("*")).alias("net"))).groupBy("chrom", "pos").agg(F.sum("net").alias("net"))
    x = sites_.join(at, ["chrom", "pos"], "left").withColumn("_s", F.floor(F.col("pos") / STRETCH))
    inside = Window.partitionBy("chrom", "_s").orderBy("pos")
    along = Window.partitionBy("chrom").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    # templates that are open before the site: begun before it, and not ended before it
    x = x.withColumns({"_open": F.coalesce(F.sum("net").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_n": F.row_number().over(inside) - 1})
    sums = x.groupBy("chrom", "_s").agg(F.coalesce(F.sum("net"), F.lit(0)).alias("net"), F.count("*").alias("n"))
    shift = sums.select("chrom", "_s", F.coalesce(F.sum("net").over(along), F.lit(0)).alias("_o0"), F.coalesce(F.sum("n").over(along), F.lit(0)).alias("_n0"))
    x = x.join(shift, ["chrom", "_s"]).withColumn("_n", F.col("_n") + F.col("_n0"))
    start = F.when(F.col("_open") + F.col("_o0") <= 0, F.struct("pos", "_n"))
    x = x.withColumn("_here", F.max(start).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    before = x.groupBy("chrom", "_s").agg(F.max("_here").alias("_last")).select("chrom", "_s", F.max("_last").over(along).alias("_before"))
    x = x.join(before, ["chrom", "_s"]).withColumn("_b", F.coalesce("_here", "_before"))
    x = x.select(*sites_.columns, F.col("_b.pos").alias("block"), (F.col("_n") - F.col("_b._n")).cast("int").alias("i"))
    return x.join(x.groupBy("chrom", "block").agg(F.count("*").cast("int").alias("size")), ["chrom", "block"])


def templates(placed: DataFrame, seen: DataFrame) -> DataFrame:
    """chrom, block, qname, beg, end, known: of each template its known sites of a block in order (i, code, and with a path its bit), and
    the bases from its first to its last site, from 0."""
    x = seen.join(placed, ["chrom", "pos"])
    told = F.struct("i", "code", *(["bit"] if "bit" in placed.columns else []))
    reach = x.groupBy("chrom", "block", "qname").agg(F.min(F.col("pos") - 1).alias("beg"), F.max("pos").alias("end"), F.array_sort(F.collect_list(F.when(F.col("code") > 0, told))).alias("known"))
    return reach.where(F.size("known") > 0)


def fits(known: np.ndarray, value: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """2^k counts: how many templates fit each haplotype of k sites. A template knows the sites of the bits of `known`, and the second
    allele at those of `value`; it fits both at others. Few windows are added one by one, many by halves of the sum over three states a site."""
    if len(known) << k < 4 * 3**k:
        bits, out = np.arange(1 << k), np.zeros(1 << k, np.int64)
        for a, v, m in zip(known.tolist(), value.tolist(), n.tolist()):
            out[(bits & a) == v] += m
        return out
    state = sum(((known >> s & 1) + (value >> s & 1)) * 3**s for s in range(k))
    out = np.zeros(3**k, np.int64)
    np.add.at(out, state, n)
    for _ in range(k):  # the first site that is left becomes the last bit
        either, low, high = out.reshape(3, -1)
        out = np.stack([either + low, either + high], -1)
    return out.reshape(-1)


def window_counts(rows: list[tuple[int, str, int]], size: int, k: int) -> np.ndarray:
    """size x 2^k: at each site how many templates fit each haplotype of the k sites that end there; a site that a template doesn't
    know fits both. rows: first site, codes, how many."""
    out = np.zeros((size, 1 << k), np.int64)
    seen: dict[int, dict[tuple[int, int], int]] = {}
    for first, codes, n in rows:
        for j in range(1, len(codes)):
            window = codes[max(0, j - k + 1) : j + 1].rjust(k, "0")
            if window[-1] != "0" and window.count("0") < k - 1:
                at = int("".join("0" if c == "0" else "1" for c in window), 2), int("".join("1" if c == "2" else "0" for c in window), 2)
                here = seen.setdefault(first + j, {})
                here[at] = here.get(at, 0) + n
    for site, here in seen.items():
        known, value = np.array(list(here), np.int64).T
        out[site] = fits(known, value, np.array(list(here.values()), np.int64), k)
    return out


def opposite_too(weights: np.ndarray) -> np.ndarray:
    """Sums of each haplotype's and its opposite's weights, over the last axis; the first half tells all."""
    half = weights.shape[-1] >> 1
    return weights[..., :half] + weights[..., : half - 1 : -1]


def best_path(weights: np.ndarray) -> np.ndarray:
    """The allele (0 or 1) at each site of the path with the greatest sum; a haplotype and its opposite count together."""
    return path_of_sums(opposite_too(weights))


def path_of_sums(both: np.ndarray) -> np.ndarray:
    """best_path, of the sums of opposites."""
    size, half = both.shape
    mask, x = 2 * half - 1, np.arange(half)
    total, back = np.zeros(half, np.int64), np.zeros((size, half), bool)
    for i in range(size):
        same, other = total[x >> 1], total[(mask & ~x) >> 1]
        back[i] = same <= other
        total = np.where(back[i], other, same) + both[i]
    state, turned, out = half - 1 - int(total[::-1].argmax()), False, np.zeros(size, np.int8)
    for i in range(size - 1, -1, -1):
        out[i] = (~state if turned else state) & 1
        if back[i, state]:
            turned, state = not turned, (mask & ~state) >> 1
        else:
            state >>= 1
    return out


def _known(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all known sites of a batch of templates the row, the number in the block and the code."""
    lists = batch["seen" if "seen" in batch.schema.names else "known"]
    flat = lists.flatten()
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    if "seen" not in batch.schema.names:
        return row, *(flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("i", "code"))
    seen = flat.to_numpy().astype(np.int64)
    k = np.flatnonzero(seen & 3)
    return row[k], (seen[k] >> 2) - batch["start"].to_numpy().astype(np.int64)[row[k]], seen[k] & 3


def _blocks(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """A row of each block of a batch, and each row's block among these."""
    chrom = batch["chrom"].dictionary_encode().indices.to_numpy().astype(np.int64)
    _, first, of = np.unique(np.stack([chrom, batch["block"].to_numpy()]), axis=1, return_index=True, return_inverse=True)
    return first, of.reshape(-1)


def _windows(known: DataFrame, sizes: DataFrame, k: int, piece: int, overlap: int) -> DataFrame:
    """chrom, block, piece, i (in the piece), told, n: how many templates tell these alleles of the k sites that end at a known one. told: the
    bits of the known sites, then those of the second alleles. Like windows are counted before the shuffle."""

    def run(batches):
        for batch in L.gathered(batches):
            row, i, high = _known(batch)
            size, n = (batch[c].to_numpy().astype(np.int64)[row] for c in ("size", "n"))
            high = high == 2
            heads, blocks_ = _blocks(batch)
            last = np.maximum(-((overlap - size) // piece), 1) - 1
            least, most = np.minimum(np.maximum(i - overlap, 0) // piece, last), np.minimum(i // piece, last)
            for more in range(overlap // piece + 2):  # the pieces that a site is in
                here = least + more
                first = here * piece
                told, second = np.ones(len(i), np.int64), high.astype(np.int64)
                for d in range(1, min(k, len(i))):
                    gap = i[d:] - i[:-d]
                    near = (row[d:] == row[:-d]) & (gap < k) & (i[:-d] >= first[d:])
                    bit = np.where(near, 1 << np.clip(gap, 0, k), 0)
                    told[d:] |= bit
                    second[d:] |= np.where(high[:-d], bit, 0)
                kept = np.flatnonzero((here <= most) & (told > 1))
                windows, ones = np.unique(told[kept] << k | second[kept], return_inverse=True)
                # like windows here are one row: by block and piece, site and window
                group, of = np.unique(np.stack([blocks_[row[kept]], here[kept]]), axis=1, return_inverse=True) if len(kept) else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
                place = (i - first)[kept]
                wide = int(place.max()) + 1 if len(kept) else 1
                keys, which = np.unique((of.reshape(-1) * wide + place) * max(len(windows), 1) + ones, return_inverse=True)
                sums = np.bincount(which, weights=n[kept], minlength=len(keys)).astype(np.int64)
                window, keys = keys % max(len(windows), 1), keys // max(len(windows), 1)
                rows = pa.array(heads[group[0][keys // wide]])
                yield pa.record_batch([batch["chrom"].take(rows), batch["block"].take(rows), pa.array(group[1][keys // wide]), pa.array((keys % wide).astype(np.int32)), pa.array(windows[window]), pa.array(sums)], names=["chrom", "block", "piece", "i", "told", "n"])

    seen = "seen" if "seen" in known.columns else "known"
    x = known.where(F.size(seen) > 1)
    x = x.where("size > 1") if "size" in known.columns else x.join(sizes, ["chrom", "block"])
    x = x.select("chrom", "block", "size", *([seen] if seen == "known" else ["seen", "start"]), F.col("n").cast("long").alias("n"))
    x = x.mapInArrow(run, "chrom string, block long, piece long, i int, told long, n long")
    return x.groupBy("chrom", "block", "piece", "i", "told").agg(F.sum("n").alias("n"))


def paths(placed: DataFrame, patterns: DataFrame, k: int = WINDOW, piece: int = PIECE, overlap: int = OVERLAP) -> DataFrame:
    """chrom, block, i, bit: the path of each block of more than one site. patterns: n templates with `known` sites each, or with the
    first of them and the codes from there on, 0 where it has none.

    The windows of each site are summed up apart; a piece's task has one row of sums for each of its sites, whatever the depth."""
    sizes = placed.where("size > 1").select("chrom", "block", "size").distinct()
    last = F.greatest(F.ceil((F.col("size") - overlap) / piece), F.lit(1)) - 1
    every = sizes.select("chrom", "block", "size", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"), F.lit(None).cast("int").alias("i"), F.lit(None).cast("binary").alias("sums"))
    if not {"known", "seen"} & set(patterns.columns):
        at = F.transform(F.split("codes", ""), lambda c, j: F.struct((F.col("first") + j).cast("int").alias("i"), c.cast("int").alias("code")))
        patterns = patterns.withColumn("known", F.filter(at, lambda e: e["code"] > 0))

    def add(key: tuple, group: pa.Table) -> pa.Table:
        told = group["told"].to_numpy()
        sums = opposite_too(fits(told >> k, told & ((1 << k) - 1), group["n"].to_numpy(), k))
        return pa.table({"chrom": [key[0].as_py()], "block": [key[1].as_py()], "piece": [key[2].as_py()], "i": pa.array([key[3].as_py()], "int32"), "sums": [zlib.compress(sums.tobytes(), 1)]})

    def solve(key: tuple, group: pa.Table) -> pa.Table:
        chrom, block, number = (v.as_py() for v in key)
        size = max(v for v in group["size"].to_pylist() if v is not None)
        end = size if number == max(-(-(size - overlap) // piece), 1) - 1 else (number + 1) * piece + overlap
        both = np.zeros((end - number * piece, 1 << (k - 1)), np.int64)
        for i, sums in zip(group["i"].to_pylist(), group["sums"].to_pylist()):
            if i is not None:
                both[i] = np.frombuffer(zlib.decompress(sums), np.int64)
        return pa.table({"chrom": [chrom], "block": [block], "piece": [number], "path": ["".join(map(str, path_of_sums(both)))]})

    summed = _windows(patterns, sizes, k, piece, overlap).groupBy("chrom", "block", "piece", "i").applyInArrow(add, "chrom string, block long, piece long, i int, sums binary")
    found = every.unionByName(summed, allowMissingColumns=True).groupBy("chrom", "block", "piece").applyInArrow(solve, "chrom string, block long, piece long, path string")
    along = Window.partitionBy("chrom", "block").orderBy("piece")
    tail, head = F.substr(F.lag("path").over(along), F.lit(piece + 1), F.lit(overlap)), F.substr("path", F.lit(1), F.lit(overlap))
    same = F.size(F.filter(F.zip_with(F.split(tail, ""), F.split(head, ""), lambda p, q: p == q), lambda e: e))
    turned = F.coalesce((2 * same < F.length(tail)).cast("int"), F.lit(0))
    x = found.withColumn("_turn", turned).withColumn("_turn", F.sum("_turn").over(along) % 2).withColumn("_end", F.max("piece").over(Window.partitionBy("chrom", "block")) == F.col("piece"))
    from_, to = F.when(F.col("piece") > 0, overlap // 2).otherwise(0), F.when(F.col("_end"), F.length("path")).otherwise(piece + overlap // 2)
    x = x.select("*", F.posexplode(F.split("path", "")).alias("_k", "_bit")).where((F.col("_k") >= from_) & (F.col("_k") < to))
    return x.select("chrom", "block", (F.col("piece") * piece + F.col("_k")).cast("int").alias("i"), F.col("_bit").cast("int").bitwiseXOR(F.col("_turn").cast("int")).alias("bit"))


def judge(codes: str, bits: str, fix: bool = True) -> dict:
    """A template's side (phase: against the path), the sites for and against it, and, for a chimera, the codes with one end turned."""
    known = [(k, int(c), int(b)) for k, (c, b) in enumerate(zip(codes, bits)) if c != "0"]
    count = [sum(c == b + 1 for _, c, b in known), sum(c != b + 1 for _, c, b in known)]
    phase = count[0] <= count[1]
    inside, outside = count[phase], count[not phase]
    out = {"phase": phase, "in_count": inside, "out_count": outside, "ambig": bool(inside and outside and outside < 3 and inside <= outside + 1), "flip": False, "fixed": codes}
    if not fix or min(count) < FLIP_EACH:
        return out
    wrong = np.zeros((2, len(codes)), int)  # rows: sites for and against the template's side
    for k, c, b in known:
        wrong[int((2 - c if phase else c - 1) != b), k] = 1
    left, right = wrong.cumsum(1)[:, :-1], wrong[:, ::-1].cumsum(1)[:, ::-1][:, 1:]
    turned = np.stack([left[0] + right[1] - right[0] * FLIP_PENALTY, left[1] + right[0] - right[1] * FLIP_PENALTY])
    best = turned.max(0)
    at = int(best.argmax()) if len(best) else 0
    if len(best) and best[at] > 0 and best[at] - inside >= FLIP_LEAST and best[at] - outside >= FLIP_LEAST:
        swap = codes.translate(str.maketrans("12", "21"))
        out["flip"] = True
        out["fixed"] = codes[: at + 1] + swap[at + 1 :] if turned[0, at] > turned[1, at] else swap[: at + 1] + codes[at + 1 :]
    return out


def masks(counts: list[tuple[int, int, int, int]]) -> list[bool]:
    """Sites of regions where templates disagree with the path: stretches whose scores add up. counts: for and against on either side."""
    masked, score, most, most_at, begin, i = [False] * len(counts), 0, 0, 0, 0, 0
    while i < len(counts):
        a0, a1, b0, b1 = counts[i]
        before = score
        score += (a1 + b1 - 1 if a1 + b1 else -(a0 + b0)) + max(b1 - b0, 0) + max(a1 - a0, 0)
        score = max(score, 0)
        if not before and score:
            begin = i
        if (i == len(counts) - 1 or not score) and most >= MASK_LEAST:
            masked[begin : most_at + 1] = [True] * (most_at + 1 - begin)
            i, score = most_at, 0
        elif score > most:
            most, most_at = score, i
        if not score:
            most = 0
        i += 1
    return masked


def judge_all(row: np.ndarray, code: np.ndarray, bit: np.ndarray, many: int, fix: bool = True) -> dict[str, np.ndarray]:
    """judge, for `many` templates at once: their known sites follow each other. Here fixed is the code of each site."""
    size = np.bincount(row, minlength=many)
    first = G.starts_of(size)
    other = (code - 1) != bit
    against = np.bincount(row, weights=other, minlength=many).astype(np.int64)
    phase = size - against <= against
    inside, outside = np.maximum(size - against, against), np.minimum(size - against, against)
    out = {"phase": phase, "in_count": inside, "out_count": outside, "ambig": (inside > 0) & (outside > 0) & (outside < 3) & (inside <= outside + 1), "flip": np.zeros(many, bool), "fixed": code.copy()}
    if not fix or not len(row):
        return out
    # sites for (0) and against (1) the template's side, up to each site and behind it
    wrong = other ^ phase[row]
    sums = np.append(0, np.cumsum(wrong))
    place = np.arange(len(row)) - first[row]
    left1 = sums[1:] - sums[first[row]]
    right1 = sums[first + size][row] - sums[1:]
    left0, right0 = place + 1 - left1, size[row] - 1 - place - right1
    ahead, behind = left0 + right1 - right0 * FLIP_PENALTY, left1 + right0 - right1 * FLIP_PENALTY
    best = np.where(place < size[row] - 1, np.maximum(ahead, behind), np.iinfo(np.int64).min)
    some = np.flatnonzero(size)
    most = np.full(many, np.iinfo(np.int64).min)
    most[some] = np.maximum.reduceat(best, first[some])
    at = np.zeros(many, np.int64)
    at[some] = np.minimum.reduceat(np.where(best == most[row], place, len(row)), first[some])
    flip = (size > 1) & (outside >= FLIP_EACH) & (most > 0) & (most - inside >= FLIP_LEAST) & (most - outside >= FLIP_LEAST)
    cut = np.where(flip, first + at, 0)
    turn_right = ahead[cut] > behind[cut]
    turned = flip[row] & ((place > at[row]) == turn_right[row])
    out["flip"], out["fixed"] = flip, np.where(turned, 3 - code, code)
    return out


JUDGED = "chrom string, block long, qname string, beg long, end long, known array<int>, phase boolean, in_count int, out_count int, ambig boolean, flip boolean"


def _with_path(members: DataFrame, along: DataFrame) -> DataFrame:
    """Templates with `way`, the path's bits of their sites as text: of all from the first to the last of them if `dense`, otherwise of
    those seen. Paths of up to BROADCAST_SITES in all are sent to the executors, larger ones are joined by site."""
    bit = F.coalesce(F.col("bit").cast("string"), F.lit("0"))
    if along.count() <= BROADCAST_SITES:
        pieces = along.groupBy("chrom", F.floor(F.col("n") / PATH).cast("int").alias("k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", bit.alias("b")))), lambda e: e["b"]), "").alias("p"))
        pieces = pieces.groupBy("chrom").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "p"))), lambda e: e["p"]).alias("_pieces"))
        first, last = F.shiftright(F.get("seen", F.lit(0)), 2), F.shiftright(F.element_at("seen", -1), 2)
        k = F.floor(first / PATH).cast("int")
        text = F.array_join(F.slice("_pieces", k + 1, F.floor(last / PATH).cast("int") - k + 1), "")
        return members.join(F.broadcast(pieces), "chrom").withColumn("way", F.substr(text, first - k * PATH + 1, last - first + 1)).drop("_pieces").withColumn("dense", F.lit(True))
    rest = [c for c in members.columns if c != "seen"]
    each = members.select(*rest, F.explode("seen").alias("v")).withColumn("n", F.shiftright("v", 2)).join(along.select("chrom", "n", bit.alias("b")), ["chrom", "n"])
    whole = each.groupBy(*rest).agg(F.array_sort(F.collect_list(F.struct("v", "b"))).alias("_s"))
    return whole.select(*rest, F.transform("_s", lambda e: e["v"]).alias("seen"), F.array_join(F.transform("_s", lambda e: e["b"]), "").alias("way"), F.lit(False).alias("dense"))


def _judged(members: DataFrame, along: DataFrame, fix: bool) -> DataFrame:
    """JUDGED: templates with their verdicts, null where a block has one site. known: eight times a site's number in the block, and bits
    for the fixed allele, the allele and the path's."""

    def run(batches):
        for batch in L.gathered(batches):
            lists = batch["seen"]
            seen = lists.flatten().to_numpy().astype(np.int64)
            each = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(lists)), each)
            place = np.arange(len(seen)) - G.starts_of(each)[row]
            dense = batch["dense"].to_numpy(zero_copy_only=False)[row]
            way, at, _ = G.text(batch["way"])
            bit = way[at[row] + np.where(dense, (seen >> 2) - (seen >> 2)[G.starts_of(each)[row]], place)].astype(np.int64) - ord("0") if len(seen) else seen
            k = np.flatnonzero(seen & 3)
            told = judge_all(row[k], seen[k] & 3, bit[k], len(lists), fix)
            i = (seen[k] >> 2) - batch["start"].to_numpy().astype(np.int64)[row[k]]
            known = i << 3 | told["fixed"] - 1 << 2 | (seen[k] & 3) - 1 << 1 | bit[k]
            size = np.bincount(row[k], minlength=len(lists))
            alone = batch["size"].to_numpy() == 1
            some = pa.array(np.flatnonzero(size))
            ends = pa.array(np.append(0, np.cumsum(size)).astype(np.int32))
            small = lambda c: pa.array(told[c].astype(np.int32), mask=alone)
            true = lambda c: pa.array(told[c], mask=alone)
            made = [batch["chrom"], batch["block"], batch["qname"], batch["beg"], batch["end"], pa.ListArray.from_arrays(ends, pa.array(known.astype(np.int32))), true("phase"), small("in_count"), small("out_count"), true("ambig"), true("flip")]
            yield pa.record_batch(made, names=["chrom", "block", "qname", "beg", "end", "known", "phase", "in_count", "out_count", "ambig", "flip"]).take(some)

    x = members.select("chrom", "qname", "block", "size", "start", (F.col("lo") - 1).alias("beg"), F.col("hi").alias("end"), "seen")
    return _with_path(x, along).select("chrom", "block", "qname", "beg", "end", "size", "start", "seen", "way", "dense").mapInArrow(run, JUDGED)


def _support(judged: DataFrame) -> DataFrame:
    """chrom, block, i, c0 to c3: how many templates are for and against the path's allele, on either side; f0 to f3: of the fixed ones. Those
    of one site don't count. A task tells each site once for a batch."""
    names = [f"{p}{c}" for p in "cf" for c in range(4)]

    def run(batches):
        for batch in L.gathered(batches):
            lists = batch["known"]
            known = lists.flatten().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            phase = batch["phase"].to_numpy(zero_copy_only=False).astype(np.int64)[row]
            heads, of = _blocks(batch)
            i = known >> 3
            wide = int(i.max()) + 1 if len(i) else 1
            keys, which = np.unique(of[row] * wide + i, return_inverse=True)
            kinds = [2 * phase + ((known >> shift & 1 ^ phase) != (known & 1)) for shift in (1, 2)]
            counts = [np.bincount(4 * which + kind, minlength=4 * len(keys)).reshape(-1, 4) for kind in kinds]
            rows = pa.array(heads[keys // wide])
            yield pa.record_batch([batch["chrom"].take(rows), batch["block"].take(rows), pa.array((keys % wide).astype(np.int32)), *(pa.array(np.ascontiguousarray(n[:, c])) for n in counts for c in range(4))], names=["chrom", "block", "i", *names])

    x = judged.where((F.size("known") > 1) & F.col("phase").isNotNull()).select("chrom", "block", "known", "phase").mapInArrow(run, "chrom string, block long, i int, " + ", ".join(f"{n} long" for n in names))
    return x.groupBy("chrom", "block", "i").agg(*[F.sum(n).alias(n) for n in names])


class Phased:
    """Sites and templates of a set of reads, from one pass over them. fix: chimeras are found and turned."""

    def __init__(self, df: DataFrame, least_lod: int = M.HET_LOD, k: int = WINDOW, fix: bool = True, piece: int = PIECE, overlap: int = OVERLAP, min_base_quality: int = 13, min_mapq: int = 0, **options):
        self.reads = df
        found = written(numbered(sites(df, least_lod, min_base_quality=min_base_quality, min_mapq=min_mapq, **options)), "sites")
        seen = written(observed(df, found, min_mapq), "seen")
        self.placed = written(blocks_of_ends(found, seen.select("chrom", F.col("lo").alias("first"), F.col("hi").alias("last"))), "blocks")
        # a template's sites are all of the block of its first one; start: the number of the block's first site
        of = self.placed.select("chrom", F.col("n").alias("_n"), "block", "size", (F.col("n") - F.col("i")).alias("start"))
        members = seen.withColumn("_n", F.shiftright(F.get("seen", F.lit(0)), 2)).join(of, ["chrom", "_n"]).drop("_n")
        self.path = written(paths(self.placed, members.withColumn("n", F.lit(1)), k, piece, overlap), "paths")
        along = self.placed.join(self.path, ["chrom", "block", "i"], "left").select("chrom", "n", "bit")
        self.members, self.along = members, along
        self.judged = written(_judged(members, along, fix), "judged")

    def sites(self) -> DataFrame:
        """chrom, block, pos, kind (0 a block of one site, 1, 2 masked), first, second, support0, errors0, support1, errors1."""
        support = _support(self.judged)
        per_block = self.placed.where("size > 1").select("chrom", "block", "i").join(support, ["chrom", "block", "i"], "left").fillna(0, [f"{p}{c}" for p in "cf" for c in range(4)])

        def told(key: tuple, group: pa.Table) -> pa.Table:
            group = group.sort_by("i")
            hidden = masks(list(zip(*(group[f"c{c}"].to_pylist() for c in range(4)))))
            return pa.table({"chrom": [key[0].as_py()] * len(hidden), "block": [key[1].as_py()] * len(hidden), "i": group["i"], "masked": hidden, **{f"f{c}": group[f"f{c}"] for c in range(4)}})

        masked = per_block.groupBy("chrom", "block").applyInArrow(told, "chrom string, block long, i int, masked boolean, f0 long, f1 long, f2 long, f3 long")
        x = self.placed.join(self.path, ["chrom", "block", "i"], "left").join(masked, ["chrom", "block", "i"], "left")
        bit = F.coalesce("bit", F.lit(0))
        kind = F.when(F.col("size") == 1, 0).when(F.col("masked"), 2).otherwise(1)
        n = lambda c: F.when(F.col("size") > 1, F.coalesce(f"f{c}", F.lit(0))).otherwise(0).cast("long")
        return x.select("chrom", "block", "pos", kind.alias("kind"), F.when(bit == 0, F.col("low")).otherwise(F.col("high")).alias("first"), F.when(bit == 0, F.col("high")).otherwise(F.col("low")).alias("second"), n(0).alias("support0"), n(1).alias("errors0"), n(2).alias("support1"), n(3).alias("errors1"))

    def templates(self) -> DataFrame:
        """chrom, qname, block, beg, end, phase, phased, flip, ambig, in_count, out_count."""
        x = self.judged
        single = F.col("phase").isNull()  # the only site of its block
        told = lambda c, alone: F.when(single, alone).otherwise(F.col(c)).alias(c)
        phased = single | (F.col("in_count") != F.col("out_count"))
        return x.select("chrom", "qname", "block", "beg", "end", told("phase", F.get("known", F.lit(0)).bitwiseAND(2) > 0), phased.alias("phased"), told("flip", F.lit(False)), told("ambig", F.lit(False)), told("in_count", F.lit(0)), told("out_count", F.lit(0)))

    def routed(self, drop_ambiguous: bool = False) -> DataFrame:
        """reads with part (0, 1, or 2 for chimeras and, with drop_ambiguous, for doubtful ones) and phased, the tag ZP:A:Y of those that
        are. Reads of no phased template are dealt by a hash of their names; so are unmapped, secondary, failed and duplicate ones."""
        t = self.templates().select(F.col("chrom").alias("_c"), F.col("qname").alias("_q"), "beg", "end", "phase", F.col("phased").alias("_p"), "flip", "ambig")
        meets = (F.col("rname") == F.col("_c")) & (F.col("qname") == F.col("_q")) & (F.col("end0") > F.col("beg")) & (F.col("start0") < F.col("end"))
        x = span(self.reads).join(t, meets, "left")
        usable = F.col("flag").bitwiseAND(FL.DEPTH_MASK) == 0
        by_name = x31(F.col("qname")).bitwiseAND(1).cast("int")
        side = F.when(F.col("ambig") & F.lit(drop_ambiguous), 2).when(F.col("_p") & F.col("flip"), 2).when(F.col("_p"), F.col("phase").cast("int"))
        part = F.coalesce(F.when(usable, side), by_name)
        marked = F.coalesce(usable & F.col("_p") & ~F.col("flip") & ~(F.col("ambig") & F.lit(drop_ambiguous)), F.lit(False))
        x = x.withColumns({"part": part, "phased": marked})
        return T.set_tag(x, "ZP", "A", F.when(F.col("phased"), "Y")).select(*self.reads.columns, "part", "phased")
