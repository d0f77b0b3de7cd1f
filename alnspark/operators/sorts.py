"""Orders as lists of key columns; a sort is orderBy over them, by range partitions, with spill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import cigar as C, flags as FL, tags as T
from ..sources.scratch import written


def coordinate_keys() -> list[Column]:
    return [F.col("tid").asc_nulls_last(), F.coalesce("pos", F.lit(0)), F.col("flag").bitwiseAND(FL.REVERSE), F.col("src"), F.col("ordinal")]


def name_tie() -> Column:
    """First, second, primary, supplementary, secondary."""
    flag = F.col("flag")
    return F.shiftleft(flag.bitwiseAND(0xC0), 8).bitwiseOR(F.shiftleft(flag.bitwiseAND(0x100), 3)).bitwiseOR(F.shiftright(flag.bitwiseAND(0x800), 3))


def natural_key(name: Column) -> Column:
    """A string whose byte order is the natural order: digit runs count as numbers (leading zeros don't), the rest by bytes."""
    runs = F.regexp_extract_all(name, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))

    def coded(run: Column) -> Column:
        digits = F.regexp_replace(run, "^0+", "")
        return F.when(run.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad(F.length(digits).cast("string"), 4, "0"), digits)).otherwise(run)

    return F.array_join(F.transform(runs, coded), "")


def name_keys(natural: bool = True) -> list[Column]:
    return [natural_key(F.col("qname")) if natural else F.col("qname"), name_tie(), F.col("src"), F.col("ordinal")]


def tag_keys(tag: str, then_name: bool = False) -> list[Column]:
    """Records without the tag first; numbers by value, then by kind; texts by bytes; then coordinates or names."""
    kind, v = F.try_element_at("tags", F.lit(tag))["t"], T.value(tag)
    number = kind.isin("i", "f", "c", "C", "s", "S", "I")
    rank = F.when(v.isNull(), 0).when(number, 1).otherwise(2)
    keys = [rank, F.when(number, v.try_cast("double")), F.when(~number, v), kind]
    return [*keys, *(name_keys() if then_name else [F.col("tid").isNull(), F.col("tid"), *coordinate_keys()[1:3], *name_keys()])]


def template_keys(df: DataFrame, header_rg: DataFrame) -> DataFrame:
    """df with the columns of the template-coordinate order: both ends' places, the smaller first."""
    ops, mate = C.ops(F.col("cigar")), C.ops(T.value("MC"))
    big = F.lit(2**31 - 1)
    far = F.lit(2**62)
    mapped = ~FL.bit(F.col("flag"), FL.UNMAP)
    has_mate = FL.bit(F.col("flag"), FL.PAIRED) & ~FL.bit(F.col("flag"), FL.MUNMAP)
    rev, mrev = FL.bit(F.col("flag"), FL.REVERSE), FL.bit(F.col("flag"), FL.MREVERSE)
    # with a mate, its CIGAR is needed: without the tag the order isn't defined
    known = F.when(has_mate & T.value("MC").isNull(), F.raise_error(F.lit("no MC tag: fix mates first")).cast("bigint"))
    other = F.when(mrev, C.unclipped_end(F.col("pnext"), mate)).otherwise(C.unclipped_start(F.col("pnext"), mate))
    libraries = F.broadcast(header_rg.select(F.col("id").alias("_rg"), F.coalesce("lb", F.lit("")).alias("_lb")))
    out = df.withColumns({
        "_t1": F.when(mapped, F.coalesce("tid", F.lit(-1))).otherwise(big), "_p1": F.when(mapped, F.when(rev, C.unclipped_end(F.col("pos"), ops)).otherwise(C.unclipped_start(F.col("pos"), ops))).otherwise(far), "_n1": mapped & rev,
        "_t2": F.when(has_mate, F.coalesce("mtid", F.lit(-1))).otherwise(big), "_p2": F.when(has_mate, F.coalesce(known, other)).otherwise(far), "_n2": has_mate & mrev,
    }).join(libraries, T.value("RG") == F.col("_rg"), "left")
    lower = (F.col("_t1") < F.col("_t2")) | ((F.col("_t1") == F.col("_t2")) & ((F.col("_p1") < F.col("_p2")) | ((F.col("_p1") == F.col("_p2")) & ~F.col("_n1"))))
    out = out.withColumn("upper", ~lower)
    both = {k: (F.when(F.col("upper"), F.col(f"_{k[0]}{3 - int(k[1])}")).otherwise(F.col(f"_{k}"))).alias(k) for k in ("t1", "t2", "p1", "p2", "n1", "n2")}
    return out.select(*df.columns, *both.values(), F.coalesce("_lb", F.lit("")).alias("lib"), F.coalesce(F.regexp_replace(T.value("MI"), "/.$", ""), F.lit("")).alias("mid"), "upper")


def template_order() -> list[Column]:
    return [F.col("t1"), F.col("t2"), F.col("p1"), F.col("p2"), ~F.col("n1"), ~F.col("n2"), F.col("lib"), F.col("mid"), F.col("qname"), F.col("upper")]


def sort(df: DataFrame, by: str = "coordinate", tag: str | None = None) -> DataFrame:
    keys = tag_keys(tag, by == "name") if tag else {"coordinate": coordinate_keys, "name": name_keys, "ascii": lambda: name_keys(False)}[by]()
    return df.orderBy(*keys)


def merge(inputs: list[DataFrame], by: str = "coordinate") -> DataFrame:
    """Union of the inputs, src by their order, sorted."""
    return sort(cat(inputs), by)


def cat(inputs: list[DataFrame]) -> DataFrame:
    """Union of the inputs in their order; src tells them apart."""
    out = inputs[0].withColumn("src", F.lit(0))
    for k, df in enumerate(inputs[1:], 1):
        out = out.unionByName(df.withColumn("src", F.lit(k)))
    return out


def collate(df: DataFrame) -> DataFrame:
    """Records of a name together, first before second, in no order of names."""
    return df.repartition("qname").sortWithinPartitions("qname", F.shiftright("flag", 6).bitwiseAND(3), "ordinal")


def minimizer(df: DataFrame, k: int = 8) -> DataFrame:
    """df with minhash, the smallest hash of the k-mers of the read and of its reverse complement: like sequences of
    unmapped reads come together when sorted by it."""
    from ..functions.sequence import reverse_complement

    def least(seq: Column) -> Column:
        squashed = F.regexp_replace(seq, r"(.)\1+", "$1")
        starts = F.sequence(F.lit(1), F.greatest(F.length(squashed) - k + 1, F.lit(1)))
        return F.array_min(F.transform(starts, lambda i: F.xxhash64(F.substr(squashed, i, F.lit(k)))))

    return df.withColumn("minhash", F.least(least(F.col("seq")), least(reverse_complement(F.col("seq")))))


def rank_within(df: DataFrame, group: list[str], keys: list[Column], name: str = "rank", keep: list[str | Column] | None = None, small: bool = False) -> DataFrame:
    """df (or of it the columns in `keep`) with the place of each record in its group, for results that show an order.

    keys are columns in ascending order. Records are sorted by group and keys in range partitions and written; a record's place is the one in its partition, and
    the group's records in the partitions before. So a large group isn't one task. small: groups of a few records each, in one window."""
    if small:
        x = df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*keys)))
        return x.select(*keep, name) if keep else x
    named, places = [f"_g{k}" for k in range(len(group))], [f"_k{k}" for k in range(len(keys))]
    # the keys are made once: the ranges are found by a sample of this table
    x = written(df.select(*(keep or ["*"]), *(F.col(g).alias(n) for g, n in zip(group, named)), *(k.alias(n) for k, n in zip(keys, places))), "keys")
    x = x.repartitionByRange(*named, *places).sortWithinPartitions(*named, *places).drop(*places).withColumn("_at", F.monotonically_increasing_id())
    x = written(x, "ranked").withColumn("_part", F.shiftright("_at", 33))
    before = Window.partitionBy(*named).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    heads = x.groupBy(*named, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    heads = heads.select(*(F.col(g).alias(f"{g}h") for g in named), F.col("_part").alias("_parth"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    meets = F.col("_part") == F.col("_parth")
    for g in named:
        meets = meets & F.col(g).eqNullSafe(F.col(f"{g}h"))
    gone = [*named, *(f"{g}h" for g in named), "_part", "_parth", "_at", "_shift"]
    return x.join(heads, meets).withColumn(name, (F.col("_at") + F.col("_shift")).cast("int")).drop(*gone)


def order_fields(by: str = "coordinate", tag: str | None = None) -> dict[str, str]:
    """SO, GO and SS of a header after sort(by, tag); 'template' and 'minimizer' are the other two orders."""
    names = {"name": "queryname:natural", "ascii": "queryname:lexicographical"}
    if tag:
        return {"SO": "unsorted", "SS": f"unsorted:{tag}:{names.get(by, 'coordinate')}"}
    if by == "template":
        return {"SO": "unsorted", "GO": "query", "SS": "unsorted:template-coordinate"}
    if by == "minimizer":
        return {"SO": "unsorted", "SS": "unsorted:minhash"}
    return {"SO": "queryname", "SS": names[by]} if by in names else {"SO": "coordinate"}


def header_line(line: str | None, by: str = "coordinate", tag: str | None = None) -> str:
    """The @HD line with the order's fields in place of its old ones; the others stay. Without a line, a new one."""
    fields = [f.split(":", 1) for f in line.split("\t")[1:]] if line else [["VN", "1.6"]]
    told = {k: v for k, v in fields if k not in ("SO", "GO", "SS")} | order_fields(by, tag)
    return "\t".join(["@HD", *(f"{k}:{v}" for k, v in told.items())])
