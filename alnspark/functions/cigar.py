"""CIGAR strings as Column functions: all built-in expressions, no UDF."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

QUERY, REFERENCE, ALIGNED = "MIS=X", "MDN=X", "M=X"


def ops(cigar: Column) -> Column:
    """array<struct<len int, op string>>; empty for null or '*'."""
    text = F.when(cigar.isNull() | (cigar == "*"), F.lit("")).otherwise(cigar)
    lengths = F.transform(F.regexp_extract_all(text, F.lit("([0-9]+)"), F.lit(1)), lambda x: x.cast("int"))
    kinds = F.regexp_extract_all(text, F.lit("([MIDNSHP=XB])"), F.lit(1))
    return F.zip_with(lengths, kinds, lambda n, k: F.struct(n.alias("len"), k.alias("op")))


def total(cigar_ops: Column, kinds: str) -> Column:
    """Sum of the lengths of the operations in `kinds`."""
    return F.aggregate(F.filter(cigar_ops, lambda o: o["op"].isin(*kinds)), F.lit(0).cast("long"), lambda a, o: a + o["len"])


def query_length(cigar_ops: Column) -> Column:
    return total(cigar_ops, QUERY)


def reference_length(cigar_ops: Column) -> Column:
    return total(cigar_ops, REFERENCE)


def _clip_at(cigar_ops: Column, first: bool, kind: str, past: str = "") -> Column:
    """Length of the clip of `kind` at one end, looking past one operation of `past`."""
    at = (lambda k: F.get(cigar_ops, F.lit(k))) if first else (lambda k: F.get(cigar_ops, F.size(cigar_ops) - 1 - k))
    near = F.when(at(0)["op"] == kind, at(0)["len"])
    if past:
        near = near.when((at(0)["op"] == past) & (at(1)["op"] == kind), at(1)["len"])
    return near.otherwise(0).cast("long")


def soft_clipped(cigar_ops: Column) -> Column:
    """Soft-clipped bases at both ends; an operation alone counts once."""
    left, right = _clip_at(cigar_ops, True, "S", "H"), _clip_at(cigar_ops, False, "S", "H")
    return left + F.when(F.size(F.filter(cigar_ops, lambda o: o["op"] == "S")) > 1, right).when(left == 0, right).otherwise(0)


def soft_ends(cigar_ops: Column) -> tuple[Column, Column]:
    """Soft-clipped bases at the left and at the right; a single operation counts as left."""
    left, right = _clip_at(cigar_ops, True, "S", "H"), _clip_at(cigar_ops, False, "S", "H")
    return left, F.when((left == 0) | (F.size(F.filter(cigar_ops, lambda o: o["op"] == "S")) > 1), right).otherwise(0)


def hard_clipped(cigar_ops: Column) -> Column:
    left, right = _clip_at(cigar_ops, True, "H"), _clip_at(cigar_ops, False, "H")
    return left + F.when(F.size(cigar_ops) > 1, right).otherwise(0)


def left_clip(cigar_ops: Column) -> Column:
    """Soft and hard clips before the first other operation."""
    return _clip_at(cigar_ops, True, "H") + _clip_at(cigar_ops, True, "S", "H")


def right_clip(cigar_ops: Column) -> Column:
    return _clip_at(cigar_ops, False, "H") + _clip_at(cigar_ops, False, "S", "H")


def end_position(pos: Column, cigar_ops: Column) -> Column:
    """1-based last reference base; the position itself for a record that spans nothing."""
    return pos + F.greatest(reference_length(cigar_ops), F.lit(1)) - 1


def unclipped_start(pos: Column, cigar_ops: Column) -> Column:
    return pos - left_clip(cigar_ops)


def unclipped_end(pos: Column, cigar_ops: Column) -> Column:
    return pos + reference_length(cigar_ops) - 1 + right_clip(cigar_ops)


def text_reference_length(cigar: Column) -> Column:
    """reference_length of a CIGAR that isn't parsed; 0 for null or '*'."""
    lengths = F.regexp_extract_all(cigar, F.lit("([0-9]+)[MDN=X]"), F.lit(1))
    return F.coalesce(F.aggregate(lengths, F.lit(0).cast("long"), lambda a, n: a + n.cast("long")), F.lit(0).cast("long"))


def _text_clip(cigar: Column, pattern: str) -> Column:
    """Sum of the two groups of a pattern; most records have no clip, which a search for the letters tells."""
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(cigar, pattern, k), F.lit("")).cast("long"), F.lit(0).cast("long"))
    return F.when((F.instr(cigar, "S") > 0) | (F.instr(cigar, "H") > 0), part(1) + part(2)).otherwise(0).cast("long")


def text_left_clip(cigar: Column) -> Column:
    return _text_clip(cigar, "^(?:([0-9]+)H)?(?:([0-9]+)S)?")


def text_right_clip(cigar: Column) -> Column:
    return _text_clip(cigar, "(?:([0-9]+)S)?(?:([0-9]+)H)?$")


def format_ops(cigar_ops: Column) -> Column:
    return F.when(F.size(cigar_ops) == 0, F.lit("*")).otherwise(F.array_join(F.transform(cigar_ops, lambda o: F.concat(o["len"].cast("string"), o["op"])), ""))


def merge_adjacent(cigar_ops: Column) -> Column:
    """Neighbours of one kind as one operation; operations of length 0 go."""
    kind = "array<struct<len:int,op:string>>"
    live = F.filter(cigar_ops, lambda o: o["len"] > 0)

    def step(acc: Column, o: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct((last["len"] + o["len"]).alias("len"), o["op"].alias("op"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["op"] == o["op"]), joined.cast(kind)).otherwise(F.concat(acc, F.array(o)).cast(kind))

    return F.aggregate(live, F.array().cast(kind), lambda acc, o: F.when(F.size(acc) == 0, F.array(o).cast(kind)).otherwise(step(acc, o)))


def blocks(pos: Column, cigar_ops: Column) -> Column:
    """array<struct<op, len, ref0, query0>>: each operation with its 0-based start on the reference and in the read."""
    start = F.struct(
        F.array().cast("array<struct<op:string,len:int,ref0:bigint,query0:bigint>>").alias("out"),
        (pos - 1).cast("bigint").alias("r"),
        F.lit(0).cast("bigint").alias("q"),
    )

    def step(acc: Column, o: Column) -> Column:
        block = F.struct(o["op"].alias("op"), o["len"].alias("len"), acc["r"].alias("ref0"), acc["q"].alias("query0"))
        return F.struct(
            F.concat(acc["out"], F.array(block)).alias("out"),
            (acc["r"] + F.when(o["op"].isin(*REFERENCE), o["len"]).otherwise(0)).cast("bigint").alias("r"),
            (acc["q"] + F.when(o["op"].isin(*QUERY), o["len"]).otherwise(0)).cast("bigint").alias("q"),
        )

    return F.aggregate(cigar_ops, start, step, lambda acc: acc["out"])
