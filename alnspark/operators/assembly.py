"""Consensus with insertions: columns between positions, simple and Bayesian calls, the assembled sequence.

A column is (chrom, pos, nth): nth 0 is the position itself, nth 1 and on the bases that records insert behind it; a record with
fewer inserted bases has a gap there. Like observations of a column are counted before the shuffle.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import cigar as C, flags as FL, tags as T
from ..sources.scratch import written
from . import columns as L, pileup as P

# The genotypes as pairs of A, C, G, T and a gap (4) with their letters; priors of two bases and of a base
# beside a gap; the quality of a base without one; bounds of the mapping quality; what a homopolymer takes from a quality;
# bases around a mismatch that count it; the depth up to which a mapping quality counts for more; the least quality of a call.
PAIRS = [(x, y) for x in range(5) for y in range(x, 5)]
LETTERS = "AMRWaCSYcGKgTt*"
HET_PRIOR, INDEL_PRIOR, NO_QUALITY = 1e-3, 2e-4, 10
LOW_MAPQ, HIGH_MAPQ, HOMOPOLYMER, HALO, SHALLOW, CUTOFF = 1.0, 60.0, 0.01, 50, 30, 10
#: Phred of a power of two, as the published qualities have it.
PHRED_OF_TWO = 3.0103


def _mismatches(md: Column) -> Column:
    """0-based places, from the record's start on the reference, where MD tells another base."""
    parts = F.regexp_extract_all(md, F.lit(r"([0-9]+|\^[A-Za-z]+|[A-Za-z])"), F.lit(1))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("seen"))

    def step(a: Column, p: Column) -> Column:
        wide = F.when(p.rlike("^[0-9]"), p.try_cast("int")).when(p.startswith("^"), F.length(p) - 1).otherwise(1)
        seen = F.when(p.rlike("^[A-Za-z]"), F.concat(a["seen"], F.array(a["at"]))).otherwise(a["seen"])
        return F.struct((a["at"] + wide).cast("int").alias("at"), seen.alias("seen"))

    return F.aggregate(parts, start, step, lambda a: a["seen"])


def _runs(seq: Column) -> Column:
    """For each base the length of the run of equal ones that it is in."""
    runs = F.regexp_extract_all(seq, F.lit(r"((.)\2*)"), F.lit(1))
    return F.flatten(F.transform(runs, lambda r: F.array_repeat(F.length(r), F.length(r))))


def columns(df: DataFrame, insertions: bool = True, min_mapq: int = 0, halo: int = HALO, model: bool = True, qualities: bool = True) -> DataFrame:
    """chrom, pos, nth, depth, seen: for each column how many records (n) have a base ('*': none) with q (255: unknown), mapq
    (255: unknown), nm (mismatches by MD within `halo` bases) and poly (length of the homopolymer). Without `model` mapq, nm and
    poly, without `qualities` q too, are null and tell no observations apart, as the simple calls need it."""
    span = C.reference_length(C.ops(F.col("cigar"))).cast("int")
    near = F.transform(F.sequence(F.lit(0), F.greatest(span, F.lit(1)) - 1), lambda o: F.size(F.filter("_mm", lambda m: F.abs(m - o) <= halo)))
    x = df.withColumn("_mm", _mismatches(T.value("MD"))).withColumns({"_near": F.when(F.size("_mm") > 0, near), "_runs": _runs(F.col("seq")), "_place": F.coalesce("mapq", F.lit(255))}) if model else df

    def beside(query: Column, offset: Column) -> dict[str, Column]:
        return {"raw_mapq": F.col("_place"), "nm": F.coalesce(F.get("_near", offset), F.lit(0)), "poly": F.coalesce(F.get("_runs", query), F.lit(1))}

    x = P.bases(x, min_base_quality=0, min_mapq=min_mapq, beside=beside if model else None).where("base <> '>'")
    kinds = ["ins", "base", "q", "raw_mapq", "nm", "poly"]
    apart = kinds if model else kinds[:3] if qualities else kinds[:2]
    counted = x.withColumns({"base": F.upper("base"), "ins": F.upper("ins") if insertions else F.lit(None).cast("string")}).groupBy("chrom", "pos", *apart).agg(F.count("*").alias("n"))
    counted = counted.withColumns({k: F.lit(None).cast("int") for k in kinds if k not in apart})
    return _by_column(counted, kinds)


def levels(q: np.ndarray, mapq: np.ndarray, nm: np.ndarray, poly: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole qualities of observations: as they are, and lowered by homopolymers."""
    quality = qualities(np.where(q == 255, NO_QUALITY, q), mapq, nm, depth)
    return np.minimum(quality, 100).astype(int), np.clip(np.maximum(quality - (poly - 2.0) * HOMOPOLYMER, 1), 0, 100).astype(int)


def weighed(df: DataFrame, insertions: bool = True, min_mapq: int = 0, halo: int = HALO) -> DataFrame:
    """As `columns`, for the Bayesian calls: beyond SHALLOW records of a column depth changes no quality any more, so there
    observations are told apart by their whole qualities only (plain, low), with q, mapq, nm and poly null."""
    kept = df.where(FL.flag_filter(F.col("flag"), exclude=FL.DEPTH_MASK) & (F.coalesce("mapq", F.lit(0)) >= min_mapq)).where("rname is not null and pos is not null and cigar is not null")
    x = kept.select("rname", "pos", "cigar", "seq", "qual", F.coalesce("mapq", F.lit(255)).alias("place"), F.coalesce(_mismatches(T.value("MD")), F.array().cast("array<int>")).alias("_mm"))

    def run(batches):
        return L.observed(batches, lambda q, mapq, nm, poly: levels(q, mapq, nm, poly, np.full(len(q), SHALLOW)), SHALLOW, halo)

    told = x.mapInArrow(run, L.OBSERVED).withColumnRenamed("mapq", "raw_mapq")
    told = told if insertions else told.withColumn("ins", F.lit(None).cast("string"))
    kinds = ["ins", "base", "q", "raw_mapq", "nm", "poly", "plain", "low"]
    return _by_column(told.groupBy("chrom", "pos", *kinds).agg(F.sum("n").alias("n")), kinds)


def _by_column(counted: DataFrame, kinds: list[str]) -> DataFrame:
    at = counted.groupBy("chrom", "pos").agg(F.sum("n").alias("depth"), F.coalesce(F.max(F.length("ins")), F.lit(0)).alias("_most"), F.collect_list(F.struct(*kinds, "n")).alias("_all"))
    each = at.select("chrom", "pos", "depth", "_all", F.explode(F.sequence(F.lit(0), F.col("_most"))).alias("nth"))
    letter = lambda e: F.when(F.col("nth") == 0, e["base"]).when(F.length(e["ins"]) >= F.col("nth"), F.substr(e["ins"], F.col("nth"), F.lit(1))).otherwise("*")
    seen = F.transform("_all", lambda e: F.struct(letter(e).alias("base"), *[e[k].alias({"raw_mapq": "mapq"}.get(k, k)) for k in [*kinds[2:], "n"]]))
    return each.select("chrom", "pos", "nth", "depth", seen.alias("seen"))


def simple(cols: DataFrame, call_fraction: float = 0.75, het_fraction: float = 0.5, min_depth: int = 1, ambiguous: bool = False, use_quality: bool = False, min_base_quality: int = 0) -> DataFrame:
    """chrom, pos, nth, depth, call, quality: as pileup.consensus, of each column."""
    kept = F.filter("seen", lambda e: e["q"] >= min_base_quality) if min_base_quality > 0 else F.col("seen")
    codes = {1: "A", 2: "C", 4: "G", 8: "T", 16: "*"}
    weight = lambda e: e["n"] * (e["q"] if use_quality else F.lit(1))
    add = lambda what: F.aggregate(kept, F.lit(0).cast("long"), lambda a, e: a + what(e))
    share = lambda c, b: lambda e: F.when(e["base"] == b, 8 * weight(e)).when(~e["base"].isin(*codes.values()) & F.lit(c < 16), weight(e)).otherwise(0)
    sums = cols.select("chrom", "pos", "nth", add(lambda e: e["n"]).alias("depth"), *[add(share(c, b)).alias(f"s{c}") for c, b in codes.items()])
    return P.call_sums(sums.where("nth > 0 or depth > 0"), call_fraction, het_fraction, min_depth, ambiguous)


@lru_cache(maxsize=4)
def tables(het_prior: float = HET_PRIOR, indel_prior: float = INDEL_PRIOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What an observation adds to the log-likelihoods of the 15 genotypes against a mismatch: by base (A, C, G, T, gap, other) and
    quality, and by base and the quality that homopolymers lower; and the genotypes' log-priors."""
    q = np.maximum(np.arange(101), 1)
    match, miss = np.log(1 - 10 ** (-q / 10)), np.log(10 ** (-q / 10) / 3)
    mean = lambda a, b: np.logaddexp(a, b) - np.log(2)
    half = mean(match, miss)
    extra = np.minimum(miss, match - 0.5)  # a base where there is none, or none where there is one
    own, lowered = np.zeros((6, 101, 15)), np.zeros((6, 101, 15))
    for g, (x, y) in enumerate(PAIRS):
        for base in range(6):
            if base == 4:
                lowered[base, :, g] = match if x == 4 else mean(extra, match) if y == 4 else extra
            elif y == 4:
                fits = base in (x, 5)
                lowered[base, :, g] = extra if x == 4 else np.minimum(mean(extra, match), half + 0.5) if fits else mean(extra, miss)
            else:
                own[base, :, g] = match if base == 5 or x == y == base else half if base in (x, y) else miss
    prior = np.log([1.0 if x == y else (indel_prior if y == 4 else het_prior) / 6 for x, y in PAIRS])
    return own - miss[:, None], lowered, prior


def log2(x: np.ndarray) -> np.ndarray:
    """The published approximation: a parabola over the mantissa."""
    mantissa, exponent = np.frexp(x)
    d = 2 * mantissa
    return exponent - 2 + (2 - d / 3) * d - 2 / 3


def exp(x: np.ndarray) -> np.ndarray:
    """The published approximation: steps of a tenth near 0, of one beyond 50, none beyond 500."""
    return np.where(np.abs(x) <= 50, np.exp(np.trunc(x * 10) / 10), np.exp(np.trunc(np.clip(x, -500, 500))))


def phred(x: np.ndarray) -> np.ndarray:
    return -PHRED_OF_TWO * log2(x)


def qualities(q: np.ndarray, mapq: np.ndarray, nm: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Phred of an error of the base or of the place; the place counts for less with mismatches near by, for more in a shallow column."""
    place = mapq / (nm + 1) * (2 - np.minimum(depth, SHALLOW) / SHALLOW)
    place = np.trunc(np.clip(place, LOW_MAPQ, HIGH_MAPQ))
    error, wrong = 10 ** (-np.minimum(q, 100) / 10), 10 ** (-0.09 * place)
    return np.maximum(phred(error + 0.75 * wrong - error * wrong), 1)


def call_columns(column: np.ndarray, base: np.ndarray, q: np.ndarray, mapq: np.ndarray, nm: np.ndarray, poly: np.ndarray, n: np.ndarray, depth: np.ndarray, het_prior: float = HET_PRIOR, folded: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
    """Of numbered columns: the best single base (4: none), its Phred, the best pair as a place in PAIRS, its log-odds, and the
    observations. depth: records of each column, whatever their quality. folded: whole qualities where they are
    told already, -1 elsewhere."""
    own, lowered, prior = tables(het_prior)
    size = len(depth)
    plain, low = levels(q, mapq, nm, poly, depth[column])
    if folded is not None:
        plain, low = (np.where(f < 0, v, f) for f, v in zip(folded, (plain, low), strict=True))
    gap = np.array([y == 4 for _, y in PAIRS])
    # genotypes without a gap go by the plain quality, those with one and missing bases by the lowered one; all against a mismatch
    miss = np.log(10 ** (-np.maximum(np.arange(101), 1) / 10) / 3)
    by_low = gap | (base == 4)[:, None]
    told = np.where(by_low, lowered[base, low] - miss[plain][:, None], own[base, plain])
    s = np.zeros((size, len(PAIRS)))
    np.add.at(s, column, told * n[:, None])
    s = np.round(s + prior, 9)  # equal whatever the order of the sum: of equals the first counts
    known = np.bincount(column, weights=n * (base < 5), minlength=size)
    observed = np.bincount(column, weights=n, minlength=size)
    two = np.array([x != y for x, y in PAIRS])
    one, het = np.where(two, -np.inf, s).argmax(1), np.where(two, s, -np.inf).argmax(1)
    p = np.maximum(exp(s - s.max(1, keepdims=True)), np.finfo(float).tiny)
    rows = np.arange(size)
    ahead, behind = np.zeros_like(p), np.zeros_like(p)
    ahead[:, 1:], behind[:, :-1] = np.cumsum(p, 1)[:, :-1], np.cumsum(p[:, ::-1], 1)[:, -2::-1]
    rest = np.maximum(ahead + behind, np.finfo(float).tiny)
    of_one, rest_one = p[rows, one], rest[rows, one]
    sure = (of_one == 1) & (rest_one < 0.01)
    value = np.where(sure, phred(rest_one), phred(np.maximum(1 - of_one / (rest_one + of_one), np.finfo(float).tiny))) + 0.5
    odds = np.trunc(PHRED_OF_TWO * (log2(p[rows, het]) - log2(rest[rows, het])) + 0.5)
    none = known == 0
    single = np.array([x for x, _ in PAIRS])[one]
    return np.where(none, 4, single), np.where(none, 0, np.maximum(np.trunc(value), 0)).astype(int), np.where(none, 0, het), np.where(none, 0, odds).astype(int), np.where(none, 0, observed).astype(int)


def bayesian(cols: DataFrame, ambiguous: bool = False, het_prior: float = HET_PRIOR, cutoff: int = CUTOFF, min_depth: int = 1, min_base_quality: int = 0) -> DataFrame:
    """chrom, pos, nth, depth, call, quality: the base ('*': none) of the best posterior of each column, N below the cutoff;
    `ambiguous`: of two bases their IUPAC letter, of a base and none the small letter, where these are likelier."""

    is_weighed = "plain" in cols.schema["seen"].dataType.elementType.names
    if is_weighed and min_base_quality > 0:
        raise ValueError("a least quality needs observations with theirs: take columns, not weighed")

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            seen, depth = batch.column("seen"), np.asarray(batch.column("depth"))
            flat = seen.flatten()
            column = np.repeat(np.arange(len(seen)), np.diff(seen.offsets.to_numpy()))
            letters = flat.field("base").dictionary_encode()
            codes = np.array(["ACGT*".find(x) for x in letters.dictionary.to_pylist()] or [0])
            base = np.where(codes < 0, 5, codes)[letters.indices.to_numpy()]
            whole = lambda k, null: pc.fill_null(flat.field(k), null).to_numpy().astype(int)
            q, mapq, nm, poly, n = (whole(k, 0) for k in ("q", "mapq", "nm", "poly", "n"))
            told = tuple(whole(k, -1) for k in ("plain", "low")) if is_weighed else None
            k = q >= min_base_quality
            one, score, het, odds, observed = call_columns(column[k], base[k], q[k], mapq[k], nm[k], poly[k], n[k], depth, het_prior, told and tuple(x[k] for x in told))
            pair = (odds > 0) & ambiguous
            call = np.where(pair, np.array(list(LETTERS))[het], np.array(list("ACGT*"))[one])
            score = np.where(pair, odds, score)
            few = (observed < min_depth) & (one != 4)
            beside_gap = np.array([y == 4 for _, y in PAIRS])[het]
            low = few | ((score < cutoff) & (call != "*") & ~beside_gap)
            call, score = np.where(low, "N", call), np.where(low, 0, np.maximum(score, 0))
            yield pa.record_batch([batch.column("chrom"), batch.column("pos"), batch.column("nth"), batch.column("depth"), pa.array(call), pa.array(score.astype(np.int32))], names=["chrom", "pos", "nth", "depth", "call", "quality"])

    return cols.mapInArrow(run, "chrom string, pos long, nth int, depth long, call string, quality int")


def assemble(calls: DataFrame, header_sq: DataFrame | None = None, every: bool = False, reference: DataFrame | None = None, reference_quality: int = 0, show_deleted: bool = False, line: int = 70, chunk: int = 7_000) -> DataFrame:
    """chrom, line (from 0), seq, qual: lines of the sequence that the calls tell, from each reference's first to its last column, or
    with `every` of all of the header's references from end to end. Positions without a column are N of quality 0, or the
    reference's base with reference_quality. Deleted positions go, and the insertions behind them too, unless show_deleted.

    Chunks of positions are put together apart; the lengths of those before tell where a chunk's first line begins."""
    calls = written(calls, "calls")  # its columns, lines and gaps are read apart
    at = F.col("pos")
    shown = calls if show_deleted else calls.join(calls.where("nth = 0 and call = '*'").select("chrom", "pos"), ["chrom", "pos"], "left_anti").where("call <> '*'")
    # an insertion's column without a base tells nothing, whatever is shown
    shown = shown.where("nth = 0 or call <> '*'").select("chrom", "pos", "nth", "call", F.char(F.when(F.col("quality") > 93, 126).otherwise(F.col("quality") + 33)).alias("q"))
    first, last = F.lit(1).cast("long"), F.col("length")
    if every:
        bounds = header_sq.select(F.col("name").alias("chrom"), first.alias("lo"), last.alias("hi"))
    else:
        bounds = calls.where("nth = 0").groupBy("chrom").agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    bins = bounds.where("hi >= lo").select("chrom", "lo", "hi", F.explode(F.sequence(F.floor((F.col("lo") - 1) / chunk), F.floor((F.col("hi") - 1) / chunk))).alias("_c"))
    places = bins.select("chrom", "_c", F.explode(F.sequence(F.greatest("lo", F.col("_c") * chunk + 1), F.least("hi", (F.col("_c") + 1) * chunk))).alias("pos"))
    known = calls.where("nth = 0").select("chrom", "pos")
    empty = places.join(known, ["chrom", "pos"], "left_anti")
    filler, quality = F.lit("N"), F.lit("!")
    if reference is not None:
        pieces = reference.select(F.col("name").alias("chrom"), F.posexplode(F.regexp_extract_all(F.upper("seq"), F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))).alias("_c", "_piece"))
        empty = empty.join(pieces.withColumn("_c", F.col("_c").cast("long")), ["chrom", "_c"], "left")
        base = F.nullif(F.substr("_piece", (at - F.col("_c") * chunk).cast("int"), F.lit(1)), F.lit(""))
        filler, quality = F.coalesce(base, filler), F.when(base.isNotNull(), chr(min(reference_quality, 93) + 33)).otherwise("!")
    rows = shown.unionByName(empty.select("chrom", "pos", F.lit(0).alias("nth"), filler.alias("call"), quality.alias("q")))
    parts = rows.groupBy("chrom", F.floor((at - 1) / chunk).alias("_c")).agg(F.sort_array(F.collect_list(F.struct("pos", "nth", "call", "q"))).alias("_p"))
    text = lambda part: F.array_join(F.transform("_p", lambda e: e[part]), "")
    parts = parts.select("chrom", "_c", text("call").alias("s"), text("q").alias("t")).withColumn("n", F.length("s"))
    lengths = parts.select("chrom", "_c", F.coalesce(F.sum("n").over(Window.partitionBy("chrom").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    placed = parts.join(lengths, ["chrom", "_c"]).where("n > 0")
    lines = F.sequence(F.floor(F.col("_off") / line), F.floor((F.col("_off") + F.col("n") - 1) / line))
    cut = placed.select("*", F.explode(lines).alias("line"))
    a = F.greatest(F.col("line") * line - F.col("_off"), F.lit(0))
    size = F.least((F.col("line") + 1) * line - F.col("_off"), F.col("n")) - a
    piece = lambda c: F.substr(F.col(c), (a + 1).cast("int"), size.cast("int"))
    whole = cut.select("chrom", "line", "_c", piece("s").alias("s"), piece("t").alias("t")).groupBy("chrom", "line").agg(F.sort_array(F.collect_list(F.struct("_c", "s", "t"))).alias("_l"))
    join = lambda part: F.array_join(F.transform("_l", lambda e: e[part]), "")
    return whole.select("chrom", "line", join("s").alias("seq"), join("t").alias("qual"))
