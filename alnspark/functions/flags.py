"""The 16-bit FLAG field as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The bits of the SAM specification, in canonical order.
FLAGS = {
    "PAIRED": 1, "PROPER_PAIR": 2, "UNMAP": 4, "MUNMAP": 8, "REVERSE": 16, "MREVERSE": 32,
    "READ1": 64, "READ2": 128, "SECONDARY": 256, "QCFAIL": 512, "DUP": 1024, "SUPPLEMENTARY": 2048,
}
PAIRED, PROPER, UNMAP, MUNMAP, REVERSE, MREVERSE, READ1, READ2, SECONDARY, QCFAIL, DUP, SUPP = FLAGS.values()
DEPTH_MASK = UNMAP | SECONDARY | QCFAIL | DUP


def bit(flag: Column, mask: int) -> Column:
    """Whether any of the mask's bits is set."""
    return flag.bitwiseAND(mask) != 0


def flag_filter(flag: Column, require: int = 0, exclude: int = 0, include: int = 0, exclude_all: int = 0) -> Column:
    """require: all these bits; exclude: none of them; include: at least one; exclude_all: not all of them together."""
    keep = F.lit(True)
    if require:
        keep = keep & (flag.bitwiseAND(require) == require)
    if exclude:
        keep = keep & (flag.bitwiseAND(exclude) == 0)
    if include:
        keep = keep & (flag.bitwiseAND(include) != 0)
    if exclude_all:
        keep = keep & (flag.bitwiseAND(exclude_all) != exclude_all)
    return keep


def flag_names(flag: Column) -> Column:
    """Names of the set bits, separated by commas, in canonical order."""
    return F.array_join(F.array_compact(F.array(*[F.when(bit(flag, m), F.lit(n)) for n, m in FLAGS.items()])), ",")


def parse_flags(text: str) -> int:
    """A number (decimal, 0x hexadecimal, leading 0 octal) or a list of names in any case."""
    text = text.strip()
    if text[:1].isdigit():
        if text[:2].lower() == "0x":
            return int(text, 16)
        return int(text, 8) if text[0] == "0" and len(text) > 1 else int(text)
    total = 0
    for name in text.split(","):
        if name.strip().upper() not in FLAGS:
            raise ValueError(f"no flag is called {name!r}")
        total |= FLAGS[name.strip().upper()]
    return total


def flags_report(flag: Column) -> Column:
    """The line of the flags tool: hexadecimal, decimal, names, with tabs between."""
    return F.concat_ws("\t", F.concat(F.lit("0x"), F.lower(F.hex(flag.cast("long")))), flag.cast("string"), flag_names(flag))
