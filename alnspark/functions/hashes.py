"""Hashes of names in 32 bits, as Column expressions: both are published and depend on the bytes alone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WORD = 0xFFFFFFFF


def x31(name: Column) -> Column:
    """31 * h + byte over the bytes of a name, modulo 2^32, as bigint; 0 for an empty name, null for null."""
    bytes_ = F.transform(F.regexp_extract_all(F.hex(name.cast("binary")), F.lit("(..)"), F.lit(1)), lambda b: F.conv(b, 16, 10).cast("bigint"))
    return F.aggregate(bytes_, F.lit(0).cast("bigint"), lambda h, b: (h * 31 + b).bitwiseAND(WORD))


def wang(key: Column) -> Column:
    """Thomas Wang's mix of 32 bits: every bit of the key changes about half of the result's."""
    word = lambda c: c.bitwiseAND(WORD)

    def steps(k: Column, step) -> Column:  # a name for what is between, so that no step is written out twice
        return F.transform(F.array(k), step)[0]

    k = steps(key, lambda k: word(k + F.bitwise_not(F.shiftleft(k, 15))))
    k = steps(k, lambda k: k.bitwiseXOR(F.shiftright(k, 10)))
    k = steps(k, lambda k: word(k + F.shiftleft(k, 3)))
    k = steps(k, lambda k: k.bitwiseXOR(F.shiftright(k, 6)))
    k = steps(k, lambda k: word(k + F.bitwise_not(F.shiftleft(k, 11))))
    return steps(k, lambda k: k.bitwiseXOR(F.shiftright(k, 16)))


def name_hash(name: Column) -> Column:
    """The mixed hash of a name: bigint from 0 to 2^32 - 1."""
    return wang(x31(name))


# The offset and the prime of FNV-1a in 64 bits, and shifts and factors of the mix behind it.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
MIX = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, None))


def _halves(hi: Column, lo: Column) -> Column:
    return F.struct(hi.bitwiseAND(WORD).alias("hi"), lo.bitwiseAND(WORD).alias("lo"))


def _product(a: Column, b: int) -> Column:
    """hi and lo of a 32-bit number times a constant of 32 bits; no step passes 63 bits, which ANSI mode would refuse."""
    low, high = a * (b & 0xFFFF), a * (b >> 16)
    total = low + F.shiftleft(high.bitwiseAND(0xFFFF), 16)
    return _halves(F.shiftright(total, 32) + F.shiftright(high, 16), total)


def _times(h: Column, factor: int) -> Column:
    """A number in halves times a constant, modulo 2^64."""
    low, high = factor & WORD, factor >> 32
    named = F.transform(F.array(F.struct(_product(h["lo"], low).alias("a"), _product(h["lo"], high).alias("b"), _product(h["hi"], low).alias("c"))), lambda p: _halves(p["a"]["hi"] + p["b"]["lo"] + p["c"]["lo"], p["a"]["lo"]))
    return named[0]


def _fold_down(h: Column, shift: int) -> Column:
    """h xor (h shifted right)."""
    low = F.shiftleft(h["hi"], 32 - shift).bitwiseOR(F.shiftright(h["lo"], shift))
    return _halves(h["hi"].bitwiseXOR(F.shiftright(h["hi"], shift)), h["lo"].bitwiseXOR(low))


def fnv1a(name: Column, seed: int = 0) -> Column:
    """struct<hi, lo>: FNV-1a of the bytes of a name in 64 bits, from an offset that the seed changes, and mixed; null for null."""
    start = FNV_OFFSET ^ seed
    bytes_ = F.transform(F.regexp_extract_all(F.hex(name.cast("binary")), F.lit("(..)"), F.lit(1)), lambda b: F.conv(b, 16, 10).cast("bigint"))
    first = _halves(F.lit(start >> 32).cast("bigint"), F.lit(start & WORD).cast("bigint"))
    h = F.aggregate(bytes_, first, lambda h, b: _times(F.struct(h["hi"].alias("hi"), h["lo"].bitwiseXOR(b).alias("lo")), FNV_PRIME))
    for shift, factor in MIX:
        h = _mixed(h, shift, factor)
    return h


def _mixed(h: Column, shift: int, factor: int | None) -> Column:
    folded = F.transform(F.array(h), lambda x: _fold_down(x, shift))
    return (F.transform(folded, lambda x: _times(x, factor)) if factor else folded)[0]
