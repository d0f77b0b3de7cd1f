"""Filter expressions, compiled to a Column: numbers, strings, record symbols, [TAG], C-like operators.

A comparison with something undefined is false, and so is an undefined result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from . import cigar as C, flags as FL, tags as T

_TOKEN = re.compile(r'\s*(?:(\d+\.?\d*(?:[eE][-+]?\d+)?|0x[0-9a-fA-F]+)|"((?:[^"\\]|\\.)*)"|(\[[A-Za-z][A-Za-z0-9]\])|([A-Za-z_][\w.]*)|(&&|\|\||==|!=|<=|>=|=~|!~|[-+*/%<>!&|^~(),]))')
# Fixed precedence of the binary operators, loosest first: bitwise ones bind tighter than comparisons, unlike in C.
_LEVELS = [["||"], ["&&"], ["==", "!=", "=~", "!~"], ["<", "<=", ">", ">="], ["|"], ["^"], ["&"], ["+", "-"], ["*", "/", "%"]]
_FUNCTIONS = {"length": F.length, "sqrt": F.sqrt, "abs": F.abs, "log": F.log, "exp": F.exp, "exists": lambda c: c.isNotNull()}


def _symbols(of_group: dict[str, str]) -> dict[str, Column]:
    """`of_group`: the library of each read group."""
    pairs = [F.lit(x) for pair in of_group.items() for x in pair]
    libraries = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    ops = C.ops(F.col("cigar"))
    return {
        "qname": F.col("qname"), "flag": F.col("flag"), "rname": F.coalesce("rname", F.lit("*")), "pos": F.coalesce("pos", F.lit(0)), "mapq": F.coalesce("mapq", F.lit(0)),
        "cigar": F.coalesce("cigar", F.lit("*")), "rnext": F.coalesce("rnext", F.lit("*")), "mrname": F.coalesce("rnext", F.lit("*")), "pnext": F.coalesce("pnext", F.lit(0)), "mpos": F.coalesce("pnext", F.lit(0)),
        "tlen": F.col("tlen"), "seq": F.col("seq"), "qual": F.col("qual"), "qlen": F.length("seq"), "rlen": C.reference_length(ops), "sclen": C.soft_clipped(ops), "hclen": C.hard_clipped(ops),
        "ncigar": F.size(ops), "endpos": F.when(F.col("pos") > 0, F.col("pos") + C.reference_length(ops) - 1), "refid": F.coalesce("tid", F.lit(-1)), "mrefid": F.coalesce("mtid", F.lit(-1)), "library": F.coalesce(F.try_element_at(libraries, T.value("RG")), F.lit("")),
    }


class _Value:
    """A Column with what is known of its type: 'b'oolean, 'n'umber, 's'tring, 't'ag (a string that may be a number)."""

    def __init__(self, column: Column, kind: str):
        self.column, self.kind = column, kind

    def truth(self) -> Column:
        if self.kind == "b":
            return F.coalesce(self.column, F.lit(False))
        if self.kind == "n":
            return F.coalesce(self.column != 0, F.lit(False))
        return self.column.isNotNull()

    def number(self) -> Column:
        return self.column.cast("int") if self.kind == "b" else self.column.try_cast("double") if self.kind in "st" else self.column


class _Parser:
    def __init__(self, text: str, libraries: dict[str, str]):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"can't read the filter at {text[at:]!r}")
            kind = next(k for k in range(1, 6) if m[k] is not None)
            self.tokens.append(("nsTio"[kind - 1], m[kind]))
            at = m.end()
        self.at, self.symbols = 0, _symbols(libraries)

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("", "")

    def take(self, *texts: str) -> str | None:
        kind, text = self.peek()
        if kind == "o" and text in texts:
            self.at += 1
            return text
        return None

    def binary(self, level: int = 0) -> _Value:
        if level == len(_LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while op := self.take(*_LEVELS[level]):
            left = self.apply(op, left, self.binary(level + 1))
        return left

    def apply(self, op: str, a: _Value, b: _Value) -> _Value:
        if op in ("&&", "||"):
            return _Value(a.truth() & b.truth() if op == "&&" else a.truth() | b.truth(), "b")
        if op in ("=~", "!~"):
            hit = F.regexp_like(a.column.cast("string"), b.column)
            return _Value(hit if op == "=~" else ~hit, "b")
        if op in ("==", "!=", "<", "<=", ">", ">="):
            text = a.kind == "s" or b.kind == "s" or (a.kind == b.kind == "t")
            x, y = (a.column.cast("string"), b.column.cast("string")) if text else (a.number(), b.number())
            return _Value({"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], "b")
        x, y = a.number(), b.number()
        if op in "&|^":
            x, y = x.cast("bigint"), y.cast("bigint")
            return _Value({"&": x.bitwiseAND(y), "|": x.bitwiseOR(y), "^": x.bitwiseXOR(y)}[op], "n")
        return _Value({"+": x + y, "-": x - y, "*": x * y, "/": F.try_divide(x, y), "%": F.try_mod(x, y)}[op], "n")

    def unary(self) -> _Value:
        if self.take("!"):
            return _Value(~self.unary().truth(), "b")
        if self.take("-"):
            return _Value(-self.unary().number(), "n")
        if self.take("+"):
            return self.unary()
        if self.take("~"):
            return _Value(F.bitwise_not(self.unary().number().cast("bigint")), "n")
        if self.take("("):
            inner = self.binary()
            self.need(")")
            return inner
        kind, text = self.peek()
        self.at += 1
        if kind == "n":
            return _Value(F.lit(int(text, 16) if text.startswith("0x") else float(text) if re.search(r"[.eE]", text) else int(text)), "n")
        if kind == "s":
            return _Value(F.lit(re.sub(r"\\(.)", r"\1", text) if "\\\\" in text or '\\"' in text else text), "s")
        if kind == "T":
            return _Value(T.value(text[1:3]), "t")
        if kind == "i":
            return self.name(text)
        raise ValueError(f"something is missing at {text!r}")

    def name(self, text: str) -> _Value:
        if text.startswith("flag."):
            name = text[5:].upper()
            aliases = {"PROPER": "PROPER_PAIR", "DUPLICATE": "DUP"}
            return _Value(FL.bit(F.col("flag"), FL.FLAGS[aliases.get(name, name)]), "b")
        if self.take("("):
            args = [self.binary()]
            while self.take(","):
                args.append(self.binary())
            self.need(")")
            if text in ("min", "max", "avg"):
                q = F.when(args[0].column.isNotNull(), F.transform(F.split(args[0].column, ""), lambda c: F.ascii(c) - 33))
                return _Value({"min": F.array_min(q), "max": F.array_max(q), "avg": F.aggregate(q, F.lit(0.0), lambda s, v: s + v) / F.size(q)}[text], "n")
            if text == "pow":
                return _Value(F.pow(args[0].number(), args[1].number()), "n")
            if text not in _FUNCTIONS:
                raise ValueError(f"no function is called {text!r}")
            plain = text in ("length", "exists")
            return _Value(_FUNCTIONS[text](args[0].column if plain else args[0].number()), "b" if text == "exists" else "n")
        if text not in self.symbols:
            raise ValueError(f"no symbol is called {text!r}")
        return _Value(self.symbols[text], "s" if text in ("qname", "rname", "cigar", "rnext", "mrname", "seq", "qual", "library") else "n")

    def need(self, text: str) -> None:
        if not self.take(text):
            raise ValueError(f"{text!r} is missing")


def compile_filter(text: str, libraries: dict[str, str] | None = None) -> Column:
    """A condition for DataFrame.where. `libraries`: the header's library (LB) of each read group, for the symbol library,
    which is empty for records of other groups and of none."""
    p = _Parser(text, libraries or {})
    value = p.binary()
    if p.at < len(p.tokens):
        raise ValueError(f"can't read the filter from {p.tokens[p.at][1]!r}")
    return value.truth()
