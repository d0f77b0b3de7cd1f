"""Headers, read groups, splitting and resetting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import flags as FL, sequence as Q, tags as T


def merge_headers(headers: list[DataFrame]) -> DataFrame:
    """name, length, tid of the union by name, in order of first appearance; a name with two lengths is an error."""
    union = headers[0].select(F.lit(0).alias("k"), "tid", "name", "length")
    for k, h in enumerate(headers[1:], 1):
        union = union.union(h.select(F.lit(k), "tid", "name", "length"))
    by = union.groupBy("name").agg(F.min(F.struct("k", "tid")).alias("at"), F.min("length").alias("length"), F.max("length").alias("_most"))
    checked = by.withColumn("length", F.when(F.col("length") == F.col("_most"), F.col("length")).otherwise(F.raise_error(F.concat(F.lit("references differ in length: "), "name")).cast("bigint")))
    # a dictionary is small: one row for each reference
    from pyspark.sql import Window

    return checked.select("name", "length", (F.row_number().over(Window.orderBy("at")) - 1).alias("tid"))


def remap(df: DataFrame, header_sq: DataFrame) -> DataFrame:
    """tid and mtid by name in another dictionary."""
    own = F.broadcast(header_sq.select(F.col("name").alias("_n1"), F.col("tid").alias("_t1")))
    mate = F.broadcast(header_sq.select(F.col("name").alias("_n2"), F.col("tid").alias("_t2")))
    x = df.join(own, F.col("rname") == F.col("_n1"), "left").join(mate, F.col("rnext") == F.col("_n2"), "left")
    return x.withColumns({"tid": F.col("_t1"), "mtid": F.col("_t2")}).select(*df.columns)


def add_read_group(df: DataFrame, group: str, overwrite: bool = True) -> DataFrame:
    """RG on all records, or only on those without one."""
    wanted = F.lit(group) if overwrite else F.when(T.value("RG").isNull(), F.lit(group))
    return T.set_tag(df, "RG", "Z", wanted)


def split_key(df: DataFrame, tag: str = "RG", most: int | None = None) -> DataFrame:
    """df with split_key: the tag's value, or null; with `most`, values beyond the first so many (by first record) count
    as null. Write with partitionBy('split_key')."""
    x = df.withColumn("split_key", T.value(tag))
    if most is None:
        return x
    first = x.where("split_key is not null").groupBy("split_key").agg(F.min(F.struct("src", "ordinal")).alias("at"))
    kept = first.orderBy("at").limit(most).select(F.col("split_key").alias("_k"))
    return x.join(F.broadcast(kept), F.col("split_key") == F.col("_k"), "left").withColumn("split_key", F.col("_k")).drop("_k")


# Tags that describe an alignment.
ALIGNMENT_TAGS = ["NM", "MD", "AS", "XS", "SA", "MC", "MQ", "NH", "HI", "ms"]


def reset(df: DataFrame, keep_dup: bool = False, keep_group: bool = True, keep: list[str] | None = None, remove: list[str] | None = None) -> DataFrame:
    """Reads as sequenced: primary records only, unmapped, back on their strand, without what an aligner added."""
    x = df.where(~FL.bit(F.col("flag"), FL.SECONDARY | FL.SUPP))
    rev = FL.bit(F.col("flag"), FL.REVERSE)
    paired = FL.bit(F.col("flag"), FL.PAIRED)
    left = FL.PAIRED | FL.READ1 | FL.READ2 | FL.QCFAIL | (FL.DUP if keep_dup else 0)
    null = lambda kind: F.lit(None).cast(kind)
    x = x.withColumns({
        "seq": F.when(rev, Q.reverse_complement(F.col("seq"))).otherwise(F.col("seq")), "qual": F.when(rev, F.reverse("qual")).otherwise(F.col("qual")),
        "flag": F.col("flag").bitwiseAND(left).bitwiseOR(FL.UNMAP).bitwiseOR(F.when(paired, FL.MUNMAP).otherwise(0)), "tid": null("int"), "rname": null("string"), "pos": null("bigint"), "mapq": F.lit(0), "cigar": null("string"),
        "mtid": null("int"), "rnext": null("string"), "pnext": null("bigint"), "tlen": F.lit(0).cast("bigint"),
    })
    gone = [*ALIGNMENT_TAGS, *([] if keep_group else ["RG"]), *(remove or [])]
    return T.keep_tags(x, keep=keep, remove=gone)


def reheader(df: DataFrame, header_sq: DataFrame) -> DataFrame:
    """Names of references by tid from another dictionary; the records stay as they are."""
    own = F.broadcast(header_sq.select(F.col("tid").alias("_t1"), F.col("name").alias("_n1")))
    mate = F.broadcast(header_sq.select(F.col("tid").alias("_t2"), F.col("name").alias("_n2")))
    x = df.join(own, F.col("tid") == F.col("_t1"), "left").join(mate, F.col("mtid") == F.col("_t2"), "left")
    return x.withColumns({"rname": F.col("_n1"), "rnext": F.col("_n2")}).select(*df.columns)


def program_chain(programs: list[dict[str, str]], name: str, command: str) -> list[dict[str, str]]:
    """@PG lines with one more for each end of a chain (one that no other names as its predecessor)."""
    named = {p.get("PP") for p in programs}
    ends = [p["ID"] for p in programs if p["ID"] not in named] or [None]
    out, used = list(programs), {p["ID"] for p in programs}
    for end in ends:
        k, new = 0, name
        while new in used:
            k += 1
            new = f"{name}.{k}"
        used.add(new)
        out.append({"ID": new, "PN": name, **({"PP": end} if end else {}), "CL": command})
    return out


def barcode(tag: Column) -> Column:
    """Barcode of a FASTQ comment: capitals, '+' between parts, '0' if it begins with no letter."""
    return F.when(~tag.rlike("^[A-Za-z]"), "0").otherwise(F.regexp_replace(F.upper(tag), "[^A-Z]", "+"))


def rename_ids(used: set[str], ids: list[str], seed: int = 1) -> dict[str, str]:
    """New names for ids of a further input that are used already: '-' and eight hexadecimal digits of a 48-bit linear
    congruential generator (the constants are those of the C library)."""
    state, out, taken = (seed << 16) | 0x330E, {}, set(used)
    for name in ids:
        new = name
        while new in taken:
            state = (state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
            new = f"{name}-{state >> 17:08X}"
        out[name] = new
        taken.add(new)
    return out


def rename_groups(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """reads with RG by a mapping of names."""
    mapping = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return T.set_tag(df, "RG", "Z", F.try_element_at(mapping, T.value("RG")))


def kept_groups(header_rg: DataFrame, groups: list[str] | None = None, library: str | None = None) -> DataFrame:
    """The header's read groups after a filter by groups: those named, and of the library if one is given. A library alone
    takes none away."""
    if not groups:
        return header_rg
    named = header_rg.where(F.col("id").isin(*groups))
    return named if library is None else named.where(F.col("lb") == library)


def with_references(header_sq: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The header's references or, where it has none, those of a dictionary (name, length), numbered in its order of tid."""
    return header_sq if not header_sq.isEmpty() else dictionary.select(*[F.col(c).cast(t) for c, t in header_sq.dtypes])


def matching_references(header_sq: DataFrame, dictionaries: DataFrame) -> DataFrame:
    """source, matches for each source of `dictionaries` (source, tid, name, length): whether it has the header's references
    in number, order, name and length. A header without references matches none."""
    own = header_sq.select("tid", "name", F.col("length").alias("_own"))
    total = header_sq.count()
    found = dictionaries.join(F.broadcast(own), ["tid", "name"], "left")
    by = found.groupBy("source").agg(F.count("*").alias("_n"), F.count_if(F.col("length") == F.col("_own")).alias("_same"))
    return by.select("source", ((F.col("_n") == total) & (F.col("_same") == total) & F.lit(total > 0)).alias("matches"))


def merge_inputs(inputs: list[tuple[DataFrame, DataFrame, DataFrame]], by: str = "coordinate", combine_groups: bool = False, seed: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """reads, header_sq, header_rg of several inputs (each of these three), as one: references by name in one dictionary,
    records numbered by it and sorted. A read group's id that an earlier input uses is renamed, in the header and on the
    records, or with `combine_groups` stands for both, as the earlier input tells it."""
    from .sorts import merge

    sq = merge_headers([h for _, h, _ in inputs])
    records, groups, used = [], None, set()
    for df, _, rg in inputs:
        ids = sorted(r["id"] for r in rg.select("id").distinct().collect())  # a header's read groups are few
        clash = [i for i in ids if i in used]
        df = remap(df, sq)
        if clash and combine_groups:
            rg = rg.where(~F.col("id").isin(*clash))
        elif clash:
            names = rename_ids(used | (set(ids) - set(clash)), clash, seed)
            df = rename_groups(df, names)
            mapping = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
            rg, ids = rg.withColumn("id", F.coalesce(F.try_element_at(mapping, F.col("id")), "id")), [names.get(i, i) for i in ids]
        used |= set(ids)
        records.append(df)
        groups = rg if groups is None else groups.unionByName(rg)
    return merge(records, by), sq, groups
