"""Operators with a model along the reference: genotype calls, target segments, phasing.

What can be counted is counted by DataFrame aggregates; what runs along a reference reads compact columns (one row for
each position) in order, a reference at a time, in Arrow batches.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import flags as FL
from . import columns as L, pileup as P

# What a position without a call, with a doubtful and with a good one adds to a target, and what a target's
# beginning costs; threshold of the phaser; how like errors depend on each other.
EMISSION, SWITCH = (-4.0, 1.0, 6.0), -14000.0
HET_LOD = 37
DEPENDENCE, ETA, MOST_READS = 0.83, 0.03, 255
#: Positions whose costs are made together: with MOST_READS records each, what a task holds.
COLUMNS_AT_ONCE = 512


@lru_cache(maxsize=2)
def error_model(dependence: float = DEPENDENCE):
    """The MAQ error model: how much each further error of one base and strand counts, the tail of the binomial for
    errors, and the binomial for two alleles, as tables by quality, reads and errors, for up to 255 reads."""
    import numpy as np
    from math import lgamma

    n = np.arange(256)
    weight = dependence**n * (1 - ETA) + ETA
    lf = np.array([lgamma(k + 1) for k in range(256)])
    choose = lf[:, None] - lf[None, :] - np.array([[lgamma(a - b + 1) if a >= b else 0 for b in range(256)] for a in range(256)])
    choose[0, :] = 0
    beta = np.zeros((64, 256, 256))
    for q in range(1, 64):
        e = 10 ** (-q / 10)
        for m in range(1, 256):
            k = np.arange(m + 1)
            terms = choose[m, k] + k * np.log(e) + (m - k) * np.log1p(-e)
            tail = np.logaddexp.accumulate(terms[::-1])[::-1]  # log of at least k errors
            beta[q, m, :m] = -10 / np.log(10) * (tail[1:] - tail[:-1])
            beta[q, m, m] = np.inf
    het = choose - np.log(2) * n[:, None]
    return weight, beta, het


@lru_cache(maxsize=4096)
def tail_costs(q: int, reads: int):
    """Phred of one error more, by the errors so far, as the table has it for up to 255 reads: for any number."""
    import numpy as np
    from math import lgamma

    lf = np.array([lgamma(k + 1) for k in range(reads + 1)])
    k, e = np.arange(reads + 1), 10 ** (-q / 10)
    terms = lf[reads] - lf - lf[::-1] + k * np.log(e) + (reads - k) * np.log1p(-e)
    tail = np.logaddexp.accumulate(terms[::-1])[::-1]
    return np.append(-10 / np.log(10) * (tail[1:] - tail[:-1]), np.inf)


def _error_costs(q, reads, errors):
    """The costs of observations by quality, records of their column and like bases before them."""
    import numpy as np

    _, beta, _ = error_model()
    out = beta[q, np.minimum(reads, 255), np.minimum(errors, 255)]
    for k in np.unique(np.stack([q, reads])[:, reads > 255], axis=1).T:
        at = (q == k[0]) & (reads == k[1])
        out[at] = tail_costs(int(k[0]), int(k[1]))[errors[at]]
    return out


def _pair_costs(both, one):
    """log of the binomial of `one` of `both` for two alleles, for any number."""
    import numpy as np
    from math import lgamma

    _, _, het = error_model()
    out = het[np.minimum(both, 255), np.minimum(one, 255)]
    for at in np.argwhere(both > 255):
        n, k = int(both[tuple(at)]), int(one[tuple(at)])
        out[tuple(at)] = lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - np.log(2) * n
    return out


def _rank(*keys):
    """The place of each row among those with the same keys, in the rows' order."""
    import numpy as np

    order = np.lexsort(keys[::-1])
    new = np.any([np.r_[True, k[order][1:] != k[order][:-1]] for k in keys], axis=0)
    first = np.flatnonzero(new)
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    return out


def genotype_costs(column, base, reverse, quality, count, most_reads: int | None = MOST_READS):
    """Phred costs, columns by 4 by 4 bases, from counts of (base 0-3, strand, quality) of numbered columns.

    Within a column the best qualities count first, and each further record of one base and strand counts for less. Of a
    column with more than most_reads records so many are taken, evenly over the order of qualities, as the published model
    does; with None all are.
    """
    import numpy as np

    weight = error_model()[0]
    size = np.bincount(column, weights=count).astype(np.int64)
    limit = size if most_reads is None else np.minimum(size, most_reads)
    order = np.lexsort((base, reverse, -quality, column))
    of, n = column[order], count[order].astype(np.int64)
    end = np.cumsum(n) - (np.cumsum(size) - size)[of]  # places of each count's records within their column
    # record k of n stays if it is the first in its share of most_reads equal ones: so many do of those before a place
    before = lambda place: np.where(place > 0, (place - 1) * limit[of] // np.maximum(size[of], 1) + 1, 0)
    at = np.repeat(order, before(end) - before(end - n))
    c, b, r, q = column[at], base[at], reverse[at], np.clip(quality[at], 4, 63)
    of_base = _rank(c, b)
    cost = _error_costs(q, limit[c], of_base)
    cost = np.where(np.isfinite(cost), cost, 0.0) * weight[np.minimum(_rank(c, b, r), 255)]  # from there on it is the least
    total = np.bincount(4 * c + b, weights=cost, minlength=4 * len(size)).reshape(-1, 4)
    n = np.bincount(4 * c + b, minlength=4 * len(size)).reshape(-1, 4)
    others = total.sum(1)[:, None, None] - total[:, :, None] - total[:, None, :]
    pair = np.maximum(0.0, others - 10 / np.log(10) * _pair_costs(n[:, :, None] + n[:, None, :], np.broadcast_to(n[:, None, :], (len(n), 4, 4))))
    pair[:, np.arange(4), np.arange(4)] = total.sum(1)[:, None] - total
    upper = np.triu(np.ones((4, 4), bool))
    return np.where(upper, pair, np.swapaxes(pair, 1, 2))


def columns(df: DataFrame, min_base_quality: int = 13, min_mapq: int = 0) -> DataFrame:
    """chrom, pos and seen: of each position how many records have a base (0-3) on a strand in a quality. The counts
    are made by task from whole records and combine before the shuffle, and a position has 512 of them at most, however deep it is."""
    mapq = F.coalesce("mapq", F.lit(0))
    kept = df.where(FL.flag_filter(F.col("flag"), exclude=FL.DEPTH_MASK) & (mapq >= min_mapq)).where("rname is not null and pos is not null and cigar is not null")
    few = kept.select("rname", "pos", "cigar", "seq", "qual", mapq.alias("mapq"), FL.bit(F.col("flag"), FL.REVERSE).alias("reverse"))
    x = few.mapInArrow(lambda batches: L.base_counts(batches, min_base_quality), L.COUNTED)
    return x.groupBy("chrom", "pos", "base", "reverse", "q").agg(F.sum("n").alias("n")).groupBy("chrom", "pos").agg(F.collect_list(F.struct("base", "reverse", "q", "n")).alias("seen"))


def _costs(batches, more, most_reads: int | None = MOST_READS):
    """more(chrom, pos, depth, costs) for each batch of `columns`, whose counts are flat arrays beside their sizes."""
    import numpy as np

    for batch in batches:
        for start in range(0, batch.num_rows, COLUMNS_AT_ONCE):
            part = batch.slice(start, COLUMNS_AT_ONCE)
            seen = part.column(2)
            flat = seen.flatten()
            column = np.repeat(np.arange(len(seen)), np.diff(seen.offsets.to_numpy()))
            base, reverse, q, n = (flat.field(k).to_numpy().astype(np.int64) for k in ("base", "reverse", "q", "n"))
            yield more(part.column(0), part.column(1), np.bincount(column, weights=n).astype(np.int32), genotype_costs(column, base, reverse, q, n, most_reads))


def calls(df: DataFrame, most_reads: int | None = MOST_READS, **options) -> DataFrame:
    """chrom, pos, depth, best, second (genotypes as pairs of letters), lod: between the best genotype and the next; hom,
    hom_quality: the best single base and what is between it and the next, 63 at most. Of a position with more than
    most_reads records the costs are of so many, evenly over the order of qualities; None: of all."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        i, j = np.triu_indices(4)
        names = np.array([f"{a}{b}" for a, b in zip(np.array(list("ACGT"))[i], np.array(list("ACGT"))[j], strict=True)])

        def made(chrom, pos, depth, cost):
            rows = np.arange(len(cost))
            ten = cost[:, i, j]
            order = np.argsort(ten, axis=1, kind="stable")
            one = (cost[:, np.arange(4), np.arange(4)] + 0.499).astype(np.int64)
            homs = np.argsort(one, axis=1, kind="stable")
            between = np.minimum(one[rows, homs[:, 1]] - one[rows, homs[:, 0]], 63)
            lod = np.round(ten[rows, order[:, 1]] - ten[rows, order[:, 0]], 4)
            out = [chrom, pos, pa.array(depth), pa.array(names[order[:, 0]]), pa.array(names[order[:, 1]]), pa.array(lod), pa.array(np.array(list("ACGT"))[homs[:, 0]]), pa.array(between.astype(np.int32))]
            return pa.RecordBatch.from_arrays(out, ["chrom", "pos", "depth", "best", "second", "lod", "hom", "hom_quality"])

        yield from _costs(batches, made, most_reads)

    return columns(df, **options).mapInArrow(run, "chrom string, pos bigint, depth int, best string, second string, lod double, hom string, hom_quality int")


def target_segments(df: DataFrame, header_sq: DataFrame, **options) -> DataFrame:
    """chrom, start (1-based), end, seq: stretches that a two-state Viterbi pass over the consensus takes for targets.

    To begin one costs as much as a few thousand good positions bring; to end one is free. The consensus is that of `calls`,
    with most_reads records of a position unless that option is None.
    """
    c = calls(df, **options)
    doubtful = (F.col("hom_quality") == 0) & (F.col("hom") == "A")  # the format can't tell these from one another
    emission = F.when(doubtful, EMISSION[1]).otherwise(EMISSION[2])
    known = header_sq.select(F.col("name").alias("chrom"))
    rows = c.join(known, "chrom", "left_semi").select("chrom", "pos", F.col("hom").alias("base"), emission.alias("e")).repartition("chrom").sortWithinPartitions("chrom", "pos")

    def run(batches):
        import pandas as pd

        def segments(chrom, positions, emissions, bases):
            """A run of uncalled positions takes one step, so memory follows the calls, not the reference."""
            outside, inside, back, at = 0.0, 0.0, [], 0
            for p, e in zip(positions, emissions, strict=True):
                best, on, anew = max(outside, inside), inside + (p - at - 1) * EMISSION[0], max(outside, inside) + SWITCH
                # of the state outside: was it inside before? of the state inside: did it go on through the gap?
                back.append((inside >= outside, on >= anew))
                outside, inside, at = best, max(on, anew) + e, p
            state, out, end = inside >= outside, [], None
            for k in range(len(positions) - 1, -1, -1):
                was_inside, goes_on = back[k]
                if state and end is None:
                    end = k
                if state and not (goes_on and k):
                    out.append((k, end))
                    end = None
                    state = was_inside
                elif not state:
                    state = was_inside
            for a, b in reversed(out):
                letters = ["N"] * (positions[b] - positions[a] + 1)
                for j in range(a, b + 1):
                    letters[positions[j] - positions[a]] = bases[j]
                yield chrom, positions[a], positions[b], "".join(letters)

        chrom, pos, em, base = None, [], [], []
        for b in batches:
            out = []
            for name, p, letter, e in zip(b["chrom"], b["pos"], b["base"], b["e"], strict=True):
                if name != chrom:
                    out += segments(chrom, pos, em, base)
                    chrom, pos, em, base = name, [], [], []
                pos.append(int(p))
                em.append(e)
                base.append(letter)
            yield pd.DataFrame(out, columns=["chrom", "start", "end", "seq"])
        yield pd.DataFrame(list(segments(chrom, pos, em, base)), columns=["chrom", "start", "end", "seq"])

    return rows.mapInPandas(run, "chrom string, start bigint, end bigint, seq string")


def heterozygous(df: DataFrame, least_lod: float = HET_LOD, most_reads: int | None = MOST_READS, **options) -> DataFrame:
    """chrom, pos, a, b: sites whose best pair of bases beats each single base by least_lod, over most_reads records of a
    position, or all with None."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        i, j = np.triu_indices(4, 1)
        letters = np.array(list("ACGT"))

        def made(chrom, pos, depth, cost):
            pairs = cost[:, i, j]
            best = pairs.argmin(1)
            take = cost[:, np.arange(4), np.arange(4)].min(1) - pairs.min(1) >= least_lod
            mask = pa.array(take)
            return pa.RecordBatch.from_arrays([chrom.filter(mask), pos.filter(mask), pa.array(letters[i[best]][take]), pa.array(letters[j[best]][take])], ["chrom", "pos", "a", "b"])

        yield from _costs(batches, made, most_reads)

    return columns(df, **options).mapInArrow(run, "chrom string, pos bigint, a string, b string")


def phase(df: DataFrame, least_lod: float = HET_LOD, min_base_quality: int = 13, min_mapq: int = 0) -> DataFrame:
    """chrom, block, pos, first, second, support, against: heterozygous sites in phase blocks.

    Sites are called in parallel. Along a reference a template keeps the side that it had at its last site, whatever it has
    at sites in between, and a further site's phase is what most of the templates known so far say, of the block that most of
    them belong to. A site without a known template begins a block. What is kept is the side of each site; templates are counted by the two sites that they bridge.
    """
    sites = heterozygous(df, least_lod, min_base_quality=min_base_quality, min_mapq=min_mapq)
    at = P.bases(df, min_base_quality=min_base_quality, min_mapq=min_mapq).where("base in ('A','C','G','T')").join(sites, ["chrom", "pos"])
    sides = at.select("chrom", "pos", "a", "b", "qname", F.when(F.col("base") == F.col("a"), 0).when(F.col("base") == F.col("b"), 1).alias("allele"), "src", "ordinal").where("allele is not null")
    # of a template that covers a site twice the later record counts
    once = sides.groupBy("chrom", "qname", "pos").agg(F.max_by("allele", F.struct("src", "ordinal")).alias("allele"))
    # what a template says of a site follows from its last site before: templates that have the same one there count together
    along = Window.partitionBy("chrom", "qname").orderBy("pos")
    steps = once.select("chrom", "pos", F.lag("pos").over(along).alias("before"), F.lag("allele").over(along).bitwiseXOR(F.col("allele")).alias("crossed"))
    votes = steps.groupBy("chrom", "pos", "before", "crossed").agg(F.count("*").alias("n"))
    rows = votes.join(sites, ["chrom", "pos"]).select("chrom", "pos", "a", "b", "before", "crossed", "n")

    def join(batches):
        import pandas as pd

        chrom, side = None, {}  # block and side of each site so far
        site, found = None, {}

        def told():
            name, pos, a, b = site
            votes: dict[int, list[int]] = {}
            for (before, crossed), n in found.items():
                block, flip = side[before]
                votes.setdefault(block, [0, 0])[crossed ^ flip] += n
            block = max(votes, key=lambda v: (sum(votes[v]), -v), default=pos)
            same, against = votes.get(block, (0, 0))
            flip = int(against > same)
            side[pos] = block, flip
            return name, block, pos, b if flip else a, a if flip else b, max(same, against), min(same, against)

        names = ["chrom", "block", "pos", "first", "second", "support", "against"]
        for rows_ in batches:
            out = []
            for name, pos, a, b, before, crossed, n in zip(*(rows_[c] for c in ("chrom", "pos", "a", "b", "before", "crossed", "n")), strict=True):
                if site is None or (name, pos) != site[:2]:
                    if site is not None:
                        out.append(told())
                    if name != chrom:
                        chrom, side = name, {}
                    site, found = (name, int(pos), a, b), {}
                if before == before and before is not None:
                    found[int(before), int(crossed)] = int(n)
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame([told()] if site is not None else [], columns=names)

    return rows.repartition("chrom").sortWithinPartitions("chrom", "pos").mapInPandas(join, "chrom string, block bigint, pos bigint, first string, second string, support int, against int")


def depad(df: DataFrame, padded: DataFrame) -> DataFrame:
    """reads on a padded reference (name, seq with '*' or '-' for pads) on the one without: POS and CIGAR follow."""

    @F.pandas_udf("pos bigint, cigar string")
    def cut(pos, cigar, ref):
        import pandas as pd

        return pd.DataFrame([_depad(p, c, r) if c and r and p == p else (p if p == p else None, c) for p, c, r in zip(pos, cigar, ref, strict=True)], columns=["pos", "cigar"]).astype({"pos": "Int64"})

    x = df.join(F.broadcast(padded.select(F.col("name").alias("_n"), F.col("seq").alias("_ref"))), F.col("rname") == F.col("_n"), "left")
    x = x.withColumn("_c", cut("pos", "cigar", "_ref"))
    return x.withColumns({"pos": F.when(F.col("_ref").isNotNull(), F.col("_c.pos")).otherwise(F.col("pos")), "cigar": F.when(F.col("_ref").isNotNull(), F.col("_c.cigar")).otherwise(F.col("cigar"))}).select(*df.columns)


def _depad(pos: float, cigar: str, ref: str) -> tuple[int, str]:
    import re

    at, out = int(pos) - 1, []
    for n, k in ((int(n), k) for n, k in re.findall(r"(\d+)([MIDNSHP=X])", cigar)):
        if k in "SHI":
            out.append((n, k))
            continue
        for _ in range(n):
            pad = at < len(ref) and ref[at] in "*-"
            if k != "P":
                at += 1
            out.append((1, {"M": "I", "=": "I", "X": "I"}.get(k, "P" if k == "D" else k) if pad and k != "P" else k))
    joined: list[tuple[int, str]] = []
    for n, k in out:
        if joined and joined[-1][1] == k:
            joined[-1] = (joined[-1][0] + n, k)
        else:
            joined.append((n, k))
    while joined and joined[0][1] == "P":
        joined.pop(0)
    while joined and joined[-1][1] == "P":
        joined.pop()
    before = ref[: int(pos) - 1]
    return int(pos) - before.count("*") - before.count("-"), "".join(f"{n}{k}" for n, k in joined)
