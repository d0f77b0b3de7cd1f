"""Content checksums: products that don't depend on the order of records, or do on demand by their numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import cigar as C, flags as FL, sequence as Q, tags as T
from ..sources.scratch import written

#: Fixed value: the modulus of the product.
PRIME = (1 << 31) - 1
#: Records, or products, that one row folds, about.
FOLD = 10_000


def _factor(crc: Column) -> Column:
    c = crc.bitwiseAND(PRIME)
    return F.when((c == 0) | (c == PRIME), 1).otherwise(c).cast("bigint")


def _product(values: Column) -> Column:
    return F.aggregate(values, F.lit(1).cast("bigint"), lambda a, c: (a * c) % PRIME)


def _bytes(v: Column, size: int) -> Column:
    """Hexadecimal digits of an integer in bytes, the least first."""
    digits = F.lpad(F.hex(v.cast("bigint").bitwiseAND(F.lit((1 << 32) - 1)) if size == 4 else v.cast("bigint")), 2 * size, "0")
    return F.concat(*[F.substr(digits, F.lit(2 * k + 1), F.lit(2)) for k in reversed(range(size))])


def _place(tid: str, pos: str) -> Column:
    return F.unhex(F.concat(_bytes(F.coalesce(F.col(tid), F.lit(-1)), 4), _bytes(F.coalesce(F.col(pos), F.lit(0)) - 1, 8)))


def record_factors(
    df: DataFrame, exclude: int = FL.SECONDARY | FL.SUPP, require: int = 0, tags: tuple[str, ...] = ("BC", "FI", "QT", "RT", "TC"), position: bool = False, cigar: bool = False, mate: bool = False, crcs: bool = False,
) -> DataFrame:
    """group, failed and the factors of each record for seq, name, qual and aux, on the sequenced strand; on demand also for
    pos (reference and position), cigar (mapping quality and operations) and mate (its reference and position). crcs: the CRC32 in place
    of the factors, beside src and ordinal."""
    x = df.where(FL.flag_filter(F.col("flag"), require, exclude))
    rev = FL.bit(F.col("flag"), FL.REVERSE)
    seq = F.when(rev, Q.reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    quals = Q.qualities(F.when(rev, F.reverse("qual")).otherwise(F.col("qual")))
    mask = F.unhex(F.lpad(F.hex(F.col("flag").bitwiseAND(FL.PAIRED | FL.READ1 | FL.READ2).cast("bigint")), 2, "0"))
    qual = F.coalesce(F.unhex(F.array_join(F.transform(quals, lambda q: F.lpad(F.hex(q.cast("bigint")), 2, "0")), "")), F.unhex(F.repeat(F.lit("FF"), F.length("seq"))))
    head = F.concat(mask, seq.cast("binary"))
    aux = F.concat(head, *[F.coalesce(F.concat(F.lit(t), F.try_element_at("tags", F.lit(t))["t"], T.value(t), F.lit("\0")).cast("binary"), F.lit("").cast("binary")) for t in tags])
    name = F.concat(F.col("qname").cast("binary"), F.unhex(F.lit("00")), head)
    told = {"seq": head, "name": name, "qual": F.concat(head, qual), "aux": aux}
    if position:
        told["pos"] = F.concat(head, _place("tid", "pos"))
    if cigar:
        words = F.transform(C.ops(F.col("cigar")), lambda o: _bytes(F.shiftleft(o["len"].cast("bigint"), 4) + F.instr(F.lit("MIDNSHP=X"), o["op"]) - 1, 4))
        told["cigar"] = F.concat(head, F.unhex(F.concat(_bytes(F.coalesce("mapq", F.lit(255)), 4), F.array_join(words, ""))))
    if mate:
        told["mate"] = F.concat(head, _place("mtid", "pnext"))
    made = (lambda c: F.crc32(c)) if crcs else (lambda c: _factor(F.crc32(c)))
    return x.select(*(["src", "ordinal"] if crcs else []), T.value("RG").alias("group"), FL.bit(F.col("flag"), FL.QCFAIL).alias("failed"), *[made(c).alias(k) for k, c in told.items()])


FIELDS = ["seq", "name", "qual", "aux"]
#: Fields on demand.
MORE = ["pos", "cigar", "mate"]


def _fields(rows: DataFrame) -> list[str]:
    return [f for f in FIELDS + MORE if f in rows.columns]


def _folded(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n and the products of rows with n and factors, over levels of FOLD rows each, as many as the number of rows
    asks for: no list grows with the data."""
    fields, parts, deals = _fields(rows), rows, max(1, -(-rows.count() // FOLD))
    deal = F.pmod(F.xxhash64(*rows.columns, F.monotonically_increasing_id()), F.lit(deals))  # equal rows are dealt apart
    parts = parts.withColumn("deal", deal)
    while True:
        parts = parts.groupBy(*keys, "deal").agg(F.sum("n").alias("n"), *[_product(F.collect_list(f)).alias(f) for f in fields])
        if deals == 1:
            return parts.drop("deal")
        deals = -(-deals // FOLD)
        parts = parts.withColumn("deal", F.pmod("deal", F.lit(deals)))


def numbered(rows: DataFrame, keys: list[str], group: str) -> DataFrame:
    """rows with number and group_number, from 0 in the order of the keys: each range of the sorted rows is numbered by itself, and the sizes
    of those before it, for each group, are added."""
    x = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id()), "numbered")
    x = x.withColumn("_part", F.shiftright("_id", 33))
    sizes = x.groupBy("_part", group).agg(F.count("*").alias("_n"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    all_ = sizes.groupBy("_part").agg(F.sum("_n").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    mine = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    own = sizes.select(F.col("_part").alias("_p"), F.col(group).alias("_g"), F.coalesce(F.sum("_n").over(mine), F.lit(0)).alias("_own"))
    x = x.withColumn("_in", F.row_number().over(Window.partitionBy("_part", group).orderBy("_id")) - 1)
    x = x.join(all_, "_part").join(own, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    number = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before")
    return x.select(*rows.columns, number.alias("number"), (F.col("_in") + F.col("_own")).alias("group_number"))


def checksum(df: DataFrame, in_order: int = 0, **options) -> DataFrame:
    """scope, group, n, seq, name, qual, aux (and pos, cigar, mate on demand): products modulo a prime, in any order. Scopes: 'group' (one row for each read
    group, null for records without one), 'all', and of all records 'pass' and 'fail' by the quality flag.

    in_order 1: each record's number in its group, by src and ordinal, goes into its factors; 2: into those of all records the
    number among all. The result then tells whether records were moved, and is the same for any partitions."""
    if not in_order:
        return _scopes(record_factors(df, **options))
    rows = written(numbered(record_factors(df, crcs=True, **options), ["src", "ordinal"], "group"), "crcs")

    def with_numbers(number: str) -> DataFrame:
        count = F.crc32(F.unhex(_bytes(F.col(number), 8)))
        return rows.select("group", "failed", *[_factor(F.col(f).bitwiseXOR(count)).alias(f) for f in _fields(rows)])

    by_group = _scopes(with_numbers("group_number"))
    return by_group if in_order == 1 else by_group.where("scope = 'group'").unionByName(_scopes(with_numbers("number")).where("scope <> 'group'"))


def _scopes(factors: DataFrame) -> DataFrame:
    parts = _folded(factors.withColumn("n", F.lit(1).cast("bigint")), ["group", "failed"])
    scopes = F.array(*[F.struct(F.lit(k).alias("scope"), g.alias("group")) for k, g in (("group", F.col("group")), ("all", F.lit(None).cast("string")))], F.struct(F.when(F.col("failed"), "fail").otherwise("pass").alias("scope"), F.lit(None).cast("string").alias("group")))
    fields = _fields(parts)
    each = parts.select(F.explode(scopes).alias("s"), "n", *fields).select("s.scope", "s.group", "n", *fields)
    return each.groupBy("scope", "group").agg(F.sum("n").alias("n"), *[_product(F.collect_list(f)).alias(f) for f in fields])  # two rows for each group


def combined(sums: DataFrame) -> DataFrame:
    """group and the combined checksum. The sequences' product goes in twice and the qualities' not at all: the format's
    published values are made so."""
    parts = F.array(F.shiftright("n", 32), F.col("n").bitwiseAND((1 << 32) - 1), "seq", "name", "seq", "aux", *[f for f in MORE if f in sums.columns])
    return sums.select("scope", "group", F.aggregate(parts, F.lit(1).cast("bigint"), lambda a, c: (a * _factor(c)) % PRIME).alias("combined"))


def merge_checksums(parts: DataFrame) -> DataFrame:
    """Checksums of several sets as one: products by scope and group."""
    return parts.groupBy("scope", "group").agg(F.sum("n").alias("n"), *[_product(F.collect_list(f)).alias(f) for f in _fields(parts)])
