"""Records of a batch laid out by position with numpy, and what is told of each position before the shuffle.

Spark partitions and orders the records and puts the parts of each position together; a task lays out at most BASES bases at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions import ragged as G

#: Bases that are laid out at once (a longer record goes alone), and bytes of records that are put together for it.
BASES, BYTES = 1 << 19, 8 << 20
#: Kinds of a base: aligned, deleted, skipped; kinds of what follows a block: neither, an insertion, a deletion.
ALIGNED, DELETED, SKIPPED = 0, 1, 2
UPPER, LOWER = (np.array([ord(f(chr(k))) if k < 128 else k for k in range(256)], np.uint8) for f in (str.upper, str.lower))


def gathered(batches: Iterator[pa.RecordBatch], most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Batches put together up to `most` bytes, in their order."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class Layout:
    """Each base of records on the reference: record, off (from the record's start), kind, query (its place in the read; of a
    deleted or skipped base that of the next), new (an operation's first), and where a block ends `after` (1: an insertion follows, 2: a deletion), with
    its length and place in the read."""

    def __init__(self, ops: list[list[tuple[int, str]]], which: np.ndarray):
        used, row = np.unique(which, return_inverse=True)
        kind, query, after, long, place, size, new = [], [], [], [], [], [], []
        for text in (ops[k] for k in used.tolist()):
            q = total = 0
            for i, (n, op) in enumerate(text):
                if n and op in "M=XDN":
                    kind.append(np.full(n, ALIGNED if op in "M=X" else DELETED if op == "D" else SKIPPED, np.int8))
                    query.append(np.arange(q, q + n) if op in "M=X" else np.full(n, q))
                    ends = np.zeros((3, n), np.int64)
                    if i + 1 < len(text) and text[i + 1][1] in "ID":
                        ends[:, -1] = 1 if text[i + 1][1] == "I" else 2, text[i + 1][0], q + (n if op in "M=X" else 0)
                    new.append(np.arange(n) == 0)
                    after.append(ends[0])
                    long.append(ends[1])
                    place.append(ends[2])
                    total += n
                if op in "MIS=X":
                    q += n
            size.append(total)
        whole = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        size_ = np.array(size or [0])
        self.span = size_[row]
        at = G.places(G.starts_of(size_)[row], self.span)
        self.record = np.repeat(np.arange(len(which)), self.span)
        self.off = G.places(np.zeros(len(which), np.int64), self.span)
        self.kind, self.query, self.after, self.long, self.place, self.new = (whole(p)[at] for p in (kind, query, after, long, place, new))


def layouts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Layout]]:
    """Slices of a batch with their layouts."""
    coded = pc.fill_null(batch.column("cigar"), "").dictionary_encode()
    ops = [[(int(n), k) for n, k in re.findall(r"(\d+)([MIDNSHP=XB])", text)] for text in coded.dictionary.to_pylist()]
    which = coded.indices.to_numpy()
    ends = np.cumsum(np.array([sum(n for n, k in o if k in "MDN=X") for o in ops] or [0])[which])
    k = 0
    while k < len(which):
        j = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + BASES, "right")))
        yield batch.slice(k, j - k), Layout(ops, which[k:j])
        k = j


class Texts:
    """A string column, read at places of its rows: 0 where a row ends before. wide: by code points, as qualities that are merged may
    lie beyond ASCII."""

    def __init__(self, column: pa.Array, wide: bool = False):
        self.data, self.at, self.size = G.signs(column) if wide else G.text(column)
        self.valid = column.is_valid().to_numpy(zero_copy_only=False)

    def letters(self, record: np.ndarray, place: np.ndarray) -> np.ndarray:
        at = np.where(place < self.size[record], self.at[record] + place, len(self.data))
        return np.append(self.data, np.uint8(0))[at]

    def cut(self, record: np.ndarray, place: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where stretches of rows begin in data, and how much of each there is."""
        return self.at[record] + place, np.clip(self.size[record] - place, 0, size)


def _column(batch: pa.RecordBatch, name: str, null: int = 0) -> np.ndarray:
    return pc.fill_null(batch.column(name), null).to_numpy(zero_copy_only=False).astype(np.int64)


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by the keys (the last one first), and where each group begins in it."""
    order = np.lexsort(keys) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= np.diff(k[order]) != 0
    return order, np.flatnonzero(new)


PARTS = "chrom string, pos long, ref string, n long, src int, ordinal long, t string, q string"


def pileup_parts(batches: Iterator[pa.RecordBatch], min_base_quality: int) -> Iterator[pa.RecordBatch]:
    """PARTS: of records in file order, for each position and input the texts of the records that follow each other here, and the
    first one's ordinal. Records come with rname, pos, cigar, seq, qual, mapq, reverse and _stretch, the reference's bases there."""
    for batch in gathered(batches):
        for some, b in layouts(batch):
            yield _pileup(some, b, min_base_quality)


def _pileup(batch: pa.RecordBatch, b: Layout, min_base_quality: int) -> pa.RecordBatch:
    seq, qual, stretch = (Texts(batch.column(c), c == "qual") for c in ("seq", "qual", "_stretch"))
    star = (qual.size == 1) & (qual.letters(np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)) == ord("*"))
    code = qual.letters(b.record, b.query)
    q = np.where((code == 0) | star[b.record], 255, code.astype(np.int64) - 33)
    chrom, src = batch.column("rname").dictionary_encode(), _column(batch, "src")
    inputs, src_code = np.unique(src, return_inverse=True)
    where = _column(batch, "pos") - 1
    k = np.flatnonzero(q >= min_base_quality) if min_base_quality > 0 else np.arange(len(q))
    group = (chrom.indices.to_numpy().astype(np.int64) * len(inputs) + src_code)[b.record[k]]
    pos = where[b.record[k]] + b.off[k] + 1
    if len(pos) and (low := int(pos.min())) >= -(1 << 40) and (width := int(pos.max()) - low + 1) * (int(group.max()) + 1) < 1 << 62:
        order, first = _groups(group * width + pos - low)
    else:
        order, first = _groups(pos, group)
    k, pos, group = k[order], pos[order], group[order]
    r, off, kind, query = b.record[k], b.off[k], b.kind[k], b.query[k]
    q = q[k]
    reverse = batch.column("reverse").to_numpy(zero_copy_only=False)[r]
    ref = UPPER[stretch.letters(r, off)]
    base = seq.letters(r, query)
    symbol = np.where(UPPER[base] == ref, np.where(reverse, ord(","), ord(".")), np.where(reverse, LOWER[base], UPPER[base]))
    symbol = np.where(kind == DELETED, ord("*"), np.where(kind == SKIPPED, np.where(reverse, ord("<"), ord(">")), symbol)).astype(np.uint8)
    told = (kind != ALIGNED) | seq.valid[r]  # an aligned base of a record without bases has no text
    begins, ends = (off == 0) & told, (off == b.span[r] - 1) & told
    after = np.where((b.after[k] == 1) & seq.valid[r] & told | (b.after[k] == 2) & (kind == ALIGNED) & told, b.after[k], 0)
    i = np.flatnonzero(after)
    is_ins, many = after[i] == 1, b.long[k[i]]
    ins_at, ins_size = seq.cut(r[i], b.place[k[i]], many)
    del_at, del_size = stretch.cut(r[i], off[i] + 1, many)
    shown, letters = np.where(is_ins, ins_size, many), np.where(is_ins, ins_size, del_size)
    number, digits_of = np.unique(shown, return_inverse=True)
    digits = [str(x).encode() for x in number.tolist()]
    wide = np.array([len(d) for d in digits] or [0])
    figures, figures_at = np.frombuffer(b"".join(digits), np.uint8), G.starts_of(wide)
    indel = np.zeros(len(k), np.int64)
    indel[i] = 1 + wide[digits_of] + letters if len(i) else 0
    has = told & (symbol != 0)
    length = 2 * begins + has + indel + ends
    at = G.starts_of(length)
    out = np.zeros(int(length.sum()), np.uint8)
    out[at[begins]] = ord("^")
    out[at[begins] + 1] = (np.minimum(_column(batch, "mapq")[r[begins]], 93) + 33).astype(np.uint8)
    to = at + 2 * begins
    out[to[has]] = symbol[has]
    if len(i):
        to_i = (to + has)[i]
        out[to_i] = np.where(is_ins, ord("+"), ord("-"))
        out[G.places(to_i + 1, wide[digits_of])] = figures[G.places(figures_at[digits_of], wide[digits_of])]
        to_i = to_i + 1 + wide[digits_of]
        for mine, data, starts in ((is_ins, seq.data, ins_at), (~is_ins, stretch.data, del_at)):
            text, back = data[G.places(starts[mine], letters[mine])], np.repeat(reverse[i[mine]], letters[mine])
            out[G.places(to_i[mine], letters[mine])] = np.where(back, LOWER[text], UPPER[text])
    out[at[ends] + length[ends] - 1] = ord("$")
    each = np.diff(np.append(first, len(k)))
    sizes = np.add.reduceat(length, first) if len(first) else np.zeros(0, np.int64)
    lead = ref[first]
    return pa.record_batch([
        chrom.dictionary.take(pa.array(group[first] // len(inputs) if len(inputs) else group[first])), pa.array(pos[first]), G.strings(lead[lead != 0], (lead != 0).astype(np.int64)), pa.array(each), pa.array(src[r[first]].astype(np.int32)),
        pa.array(_column(batch, "ordinal")[r[first]]), G.strings(out, sizes), G.strings((np.minimum(q, 93) + 33).astype(np.uint8), each),
    ], names=["chrom", "pos", "ref", "n", "src", "ordinal", "t", "q"])


def _figures(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of distinct numbers in figures, and where each row's are and how many."""
    some, which = np.unique(numbers, return_inverse=True)
    told = [str(x).encode() for x in some.tolist()]
    size = np.array([len(d) for d in told] or [0])
    return np.frombuffer(b"".join(told), np.uint8), G.starts_of(size)[which], size[which]


def mismatches(cigar: pa.Array, seq: pa.Array, stretch: pa.Array) -> pa.Array:
    """md and nm of records beside the reference's bases there; null without these."""
    batch = pa.record_batch([cigar, seq, stretch], names=["cigar", "seq", "stretch"])
    parts = [_mismatches(some, b) for some, b in layouts(batch)]
    kind = pa.struct([("md", pa.string()), ("nm", pa.int32())])
    whole = pa.concat_arrays([p.cast(kind) for p in parts]) if parts else pa.array([], kind)
    return pc.if_else(stretch.is_valid(), whole, pa.scalar(None, kind))


def _mismatches(batch: pa.RecordBatch, b: Layout) -> pa.Array:
    seq, ref = Texts(batch.column("seq")), Texts(batch.column("stretch"))
    n, r, aligned = batch.num_rows, b.record, b.kind == ALIGNED
    x, y = seq.letters(r, b.query), UPPER[ref.letters(r, b.off)]
    both = aligned & (x != 0) & (y != 0)
    same = both & ((x == ord("=")) | ((x != ord("N")) & (UPPER[x] == y)))
    other, deleted = both & ~same, b.kind == DELETED
    # an event begins with the number of bases like the reference since the one before, and each record ends with one
    e = np.flatnonzero(other | deleted)
    number = other[e] | b.new[e]
    seen = np.cumsum(same)
    ends = np.cumsum(b.span)
    before = np.append(0, seen)[ends - b.span]  # like bases before each record
    owner = np.append(r[e], np.arange(n))
    at = np.append(e, ends)  # the end of a record comes behind its events
    order = np.lexsort((at, owner))
    owner, count = owner[order], np.append(np.append(0, seen)[e], np.append(0, seen)[ends])[order]
    counted = np.append(number, np.ones(n, bool))[order]
    first = np.append(True, owner[1:] != owner[:-1])
    run = count - np.where(first, before[owner], np.append(0, count[:-1]))
    hat = np.append(number & deleted[e], np.zeros(n, bool))[order]
    letter = np.append(y[e], np.zeros(n, np.uint8))[order]
    figures, figures_at, wide = _figures(run)
    wide = np.where(counted, wide, 0)
    size = wide + hat + (letter != 0)
    to = G.starts_of(size)
    out = np.zeros(int(size.sum()), np.uint8)
    out[G.places(to, wide)] = figures[G.places(figures_at, wide)]
    out[(to + wide)[hat]] = ord("^")
    out[(to + wide + hat)[letter != 0]] = letter[letter != 0]
    md = G.strings(out, np.bincount(owner, weights=size, minlength=n).astype(np.int64))
    coded = pc.fill_null(batch.column("cigar"), "").dictionary_encode()
    inserted = np.array([sum(int(k) for k in re.findall(r"(\d+)I", text)) for text in coded.dictionary.to_pylist()] or [0])[coded.indices.to_numpy()]
    nm = np.bincount(r[e], minlength=n) + inserted
    return pa.StructArray.from_arrays([md, pa.array(nm.astype(np.int32))], names=["md", "nm"])


TOLD = "chrom string, pos long, src int, ordinal long, base string"


def reference_told(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """TOLD: the reference's base at each position by the last record here whose MD tells it. A task holds `most` positions and what
    a slice adds, and gives them on when there are more."""
    names: dict[str, int] = {}
    held: list[np.ndarray] = []

    def last(rows: np.ndarray) -> np.ndarray:
        chrom, pos, src, ordinal, _ = rows
        order = np.lexsort((ordinal, src, pos, chrom))
        rows = rows[:, order]
        return rows[:, np.append((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0), True)] if rows.shape[1] else rows

    def given(rows: np.ndarray) -> pa.RecordBatch:
        chrom, pos, src, ordinal, base = rows
        return pa.record_batch([pa.array(list(names), pa.string()).take(pa.array(chrom)), pa.array(pos), pa.array(src.astype(np.int32)), pa.array(ordinal), G.strings(base.astype(np.uint8), np.ones(len(base), np.int64))], names=["chrom", "pos", "src", "ordinal", "base"])

    for batch in gathered(batches):
        for some, b in layouts(batch):
            coded = some.column("rname").dictionary_encode()
            code = np.array([names.setdefault(x, len(names)) for x in coded.dictionary.to_pylist()] or [0])[coded.indices.to_numpy()]
            base = _told(some, b)
            k = np.flatnonzero(base)
            r = b.record[k]
            held.append(last(np.stack([code[r], _column(some, "pos")[r] + b.off[k], _column(some, "src")[r], _column(some, "ordinal")[r], base[k].astype(np.int64)])))
            if sum(x.shape[1] for x in held) > most:
                held = [last(np.concatenate(held, 1))]
                if held[0].shape[1] > most // 2:
                    yield given(held.pop())
    if held:
        yield given(last(np.concatenate(held, 1)))


def _told(batch: pa.RecordBatch, b: Layout) -> np.ndarray:
    """The reference's letter at each base of the layout; 0 where it is left open."""
    md, seq, n = Texts(batch.column("md")), Texts(batch.column("seq")), batch.num_rows
    data = md.data[G.places(md.at, md.size)]
    owner = np.repeat(np.arange(n), md.size)
    digit = (data >= ord("0")) & (data <= ord("9"))
    letter = (LOWER[data] >= ord("a")) & (LOWER[data] <= ord("z"))
    # figures by their place in the number: those of a number follow each other in one record
    same = digit[1:] & digit[:-1] & (owner[1:] == owner[:-1])
    last = digit & ~np.append(same, False) if len(data) else digit
    ends = np.flatnonzero(last)
    d = np.flatnonzero(digit)
    power = np.minimum(ends[np.searchsorted(ends, d)] - d, 18) if len(d) else d
    width = np.zeros(len(data), np.int64)
    width[d] = (data[d].astype(np.int64) - ord("0")) * 10**power
    width[letter] = 1
    before = np.cumsum(width) - width  # bases that are told before each sign, in all records
    first = np.append(before, width.sum())[G.starts_of(md.size)]
    k = np.flatnonzero(letter)
    place, of = before[k] - first[owner[k]], owner[k]
    kept = b.kind != SKIPPED
    each = np.bincount(b.record[kept], minlength=n)
    k, place, of = k[place < each[of]], place[place < each[of]], of[place < each[of]]
    by_md = np.zeros(int(each.sum()), np.uint8)
    by_md[G.starts_of(each)[of] + place] = data[k]
    out = np.zeros(len(b.record), np.uint8)
    out[kept] = by_md
    aligned = b.kind == ALIGNED
    out = np.where(aligned, UPPER[np.where(out == 0, seq.letters(b.record, b.query), out)], np.where((b.kind == DELETED) & (out == 0), ord("N"), out))
    return np.where(md.valid[b.record] & kept, out, 0).astype(np.uint8)


OBSERVED = "chrom string, pos long, ins string, base string, q int, mapq int, nm int, poly int, plain int, low int, n long"
LETTERS = "ACGT*N"
_FOLDED, _POS = 1 << 62, (1 << 40) - 1


def observed(batches: Iterator[pa.RecordBatch], fold, shallow: int, halo: int, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """OBSERVED: like observations of a position, counted. From the `shallow`-th record of a position in this task on only what
    `fold` makes of them (plain, low) tells them apart, otherwise q, mapq, nm and poly do. Records come with rname, pos, cigar, seq,
    qual, place (mapq, 255 for none) and _mm (places where MD tells another base). A task holds up to `most` counts and what a
    slice adds."""
    names: dict[str, int] = {}
    places: dict[int, int] = {}
    kinds: dict[tuple[int, str | None], int] = {}
    totals = np.zeros(1 << 16, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def counted() -> tuple[np.ndarray, np.ndarray]:
        keys, which = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return keys, np.bincount(which, weights=np.concatenate([n for _, n in held]), minlength=len(keys)).astype(np.int64)

    def given(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        where, names_ = np.array(list(places)), pa.array(list(names), pa.string())
        key, ins = np.array([k for k, _ in kinds]), pa.array([i for _, i in kinds], pa.string())
        letters = pa.array(list(LETTERS))
        for k in range(0, len(keys), 50_000):
            at, code = where[keys[k : k + 50_000] >> 32], keys[k : k + 50_000] & 0xFFFFFFFF
            raw = key[code]
            folded = raw >= _FOLDED
            some = lambda v, there: pa.array(v.astype(np.int32), mask=~there)
            yield pa.record_batch([
                names_.take(pa.array(at >> 40)), pa.array(at & _POS), ins.take(pa.array(code)), letters.take(pa.array(raw & 7)), some(raw >> 3 & 255, ~folded), some(raw >> 11 & 255, ~folded), some(raw >> 19 & 0xFFFF, ~folded), some(raw >> 35 & 0xFFFFFF, ~folded),
                some(raw >> 3 & 255, folded), some(raw >> 11 & 255, folded), pa.array(n[k : k + 50_000]),
            ], names=["chrom", "pos", "ins", "base", "q", "mapq", "nm", "poly", "plain", "low", "n"])

    for batch in gathered(batches):
        for some, b in layouts(batch):
            k = np.flatnonzero(b.kind != SKIPPED)
            if not len(k):
                continue
            packed, ins_of, ins = _observations(some, b, k, halo)
            coded = some.column("rname").dictionary_encode()
            chrom = np.array([names.setdefault(x, len(names)) for x in coded.dictionary.to_pylist()])[coded.indices.to_numpy()]
            r = b.record[k]
            at, at_of = np.unique(chrom[r] << 40 | (_column(some, "pos")[r] + b.off[k]), return_inverse=True)
            ids = np.array([places.setdefault(x, len(places)) for x in at.tolist()])
            if len(places) > len(totals):
                totals = np.append(totals, np.zeros(len(places), np.int64))
            totals[ids] += np.bincount(at_of)
            deep = (totals[ids] >= shallow)[at_of]
            raw, raw_of = np.unique(packed, return_inverse=True)
            plain, low = fold(raw >> 3 & 255, raw >> 11 & 255, raw >> 19 & 0xFFFF, raw >> 35 & 0xFFFFFF)
            keys = np.append(raw, _FOLDED | low << 11 | plain << 3 | raw & 7)
            which = raw_of + np.where(deep, len(raw), 0)
            pair, pair_of = np.unique(which * (len(ins) + 1) + ins_of, return_inverse=True)  # ins_of: 0 for none
            told = [None, *ins]
            codes = np.array([kinds.setdefault((x, told[i]), len(kinds)) for x, i in zip(keys[pair // (len(ins) + 1)].tolist(), (pair % (len(ins) + 1)).tolist(), strict=True)])
            found, n = np.unique(ids[at_of] << 32 | codes[pair_of], return_counts=True)
            held.append((found, n))
            if sum(len(x) for x, _ in held) > most:
                held = [counted()]
                if len(held[0][0]) > most // 2:
                    yield from given(*held.pop())
                    places.clear()
                    kinds.clear()
                    totals[:] = 0
    if held:
        yield from given(*counted())


def _observations(batch: pa.RecordBatch, b: Layout, k: np.ndarray, halo: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Of the bases k of a layout: base, q, mapq, nm and poly in one number; the number (from 1) of what is inserted behind, 0 for
    nothing; and the insertions."""
    seq, qual = Texts(batch.column("seq")), Texts(batch.column("qual"), True)
    r, off, query = b.record[k], b.off[k], b.query[k]
    star = (qual.size == 1) & (qual.letters(np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)) == ord("*"))
    code = qual.letters(r, query)
    q = np.where((code == 0) | star[r], 255, np.maximum(code.astype(np.int64) - 33, 0))
    letters = np.full(256, 5)
    for x, c in enumerate("ACGT"):
        letters[[ord(c), ord(c.lower())]] = x
    base = np.where(b.kind[k] == DELETED, 4, letters[seq.letters(r, query)])
    # homopolymers: runs of equal letters within a read
    data, owner = seq.data[G.places(seq.at, seq.size)], np.repeat(np.arange(batch.num_rows), seq.size)
    run = np.cumsum(np.append(True, (data[1:] != data[:-1]) | (owner[1:] != owner[:-1]))) - 1 if len(data) else np.zeros(0, np.int64)
    long = np.bincount(run)[run] if len(run) else run
    inside = query < seq.size[r]
    poly = np.append(long, 1)[np.where(inside, G.starts_of(seq.size)[r] + query, len(long))]
    seen = batch.column("_mm")
    at = seen.offsets.to_numpy().astype(np.int64)
    many = np.diff(at)
    if many.any():
        wide = 1 << 32
        marks = np.sort(np.repeat(np.arange(batch.num_rows), many) * wide + seen.values.to_numpy(zero_copy_only=False)[G.places(at[:-1], many)].astype(np.int64))
        nm = np.searchsorted(marks, r * wide + off + halo, "right") - np.searchsorted(marks, r * wide + np.maximum(off - halo, 0), "left")
    else:
        nm = np.zeros(len(k), np.int64)
    # beyond these bounds nothing changes any more
    packed = base | q << 3 | np.clip(_column(batch, "place", 255)[r], 0, 255) << 11 | np.minimum(nm, 0xFFFF) << 19 | np.minimum(poly, 1 << 20) << 35
    i = np.flatnonzero((b.after[k] == 1) & seq.valid[r])
    first, size = seq.cut(r[i], b.place[k[i]], b.long[k[i]])
    coded = G.strings(UPPER[seq.data[G.places(first, size)]], size).dictionary_encode()
    ins_of = np.zeros(len(k), np.int64)
    ins_of[i] = coded.indices.to_numpy() + 1
    return packed, ins_of, coded.dictionary.to_pylist()


COUNTED = "chrom string, pos long, base int, reverse int, q int, n long"


def base_counts(batches: Iterator[pa.RecordBatch], min_base_quality: int, most: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """COUNTED: how many aligned A, C, G, T (0-3) a position has on a strand in a quality (4 to 63, at most the mapping quality). Records
    come with rname, pos, cigar, seq, qual, mapq, reverse. A task holds the 512 counts of up to `most` positions, and gives them on when
    there are more."""
    names: dict[str, int] = {}
    places: dict[int, int] = {}
    counts = np.zeros(0, np.int64)
    letters = np.full(256, 4)
    letters[[ord(c) for c in "ACGT"]] = np.arange(4)

    def given(at: np.ndarray, cell: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        small = lambda v: pa.array(v.astype(np.int32))
        return pa.record_batch([pa.array(list(names), pa.string()).take(pa.array(at >> 40)), pa.array(at & _POS), small(cell & 3), small(cell >> 2 & 1), small(cell >> 3), pa.array(n)], names=["chrom", "pos", "base", "reverse", "q", "n"])

    def all_given() -> Iterator[pa.RecordBatch]:
        where, found = np.array(list(places)), np.flatnonzero(counts)
        for k in range(0, len(found), 50_000):
            some = found[k : k + 50_000]
            yield given(where[some >> 9], some & 511, counts[some])

    for batch in gathered(batches):
        for some, b in layouts(batch):
            seq, qual = Texts(some.column("seq")), Texts(some.column("qual"), True)
            k = np.flatnonzero(b.kind == ALIGNED)
            base = letters[seq.letters(b.record[k], b.query[k])]
            star = (qual.size == 1) & (qual.letters(np.arange(some.num_rows), np.zeros(some.num_rows, np.int64)) == ord("*"))
            code = qual.letters(b.record[k], b.query[k])
            q = np.where((code == 0) | star[b.record[k]], 255, code.astype(np.int64) - 33)
            kept = (base < 4) & ((q >= min_base_quality) | (min_base_quality <= 0))
            r, off, base, q = b.record[k][kept], b.off[k][kept], base[kept], q[kept]
            if not len(r):
                continue
            mapq = _column(some, "mapq")
            q = np.maximum(np.minimum(np.minimum(q, np.where(mapq > 0, mapq, 255)[r]), 63), 4)
            coded = some.column("rname").dictionary_encode()
            chrom = np.array([names.setdefault(x, len(names)) for x in coded.dictionary.to_pylist()])[coded.indices.to_numpy()]
            cell = base | some.column("reverse").to_numpy(zero_copy_only=False).astype(np.int64)[r] << 2 | q << 3
            at, of = np.unique(chrom[r] << 40 | (_column(some, "pos")[r] + off), return_inverse=True)
            if len(at) > most:
                key, n = np.unique(of << 9 | cell, return_counts=True)
                yield given(at[key >> 9], key & 511, n)
                continue
            told = at.tolist()
            if len(places) + sum(x not in places for x in told) > most:
                yield from all_given()
                places.clear()
                counts[:] = 0
            ids = np.array([places.setdefault(x, len(places)) for x in told])
            if len(places) << 9 > len(counts):
                counts = np.append(counts, np.zeros(max((len(places) << 9) - len(counts), len(counts)), np.int64))
            added = np.bincount(ids[of] << 9 | cell)
            counts[: len(added)] += added
    yield from all_given()


CODED = "chrom string, qname string, src int, ordinal long, lo long, hi long, seen array<int>"


def site_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """CODED: of each record with an aligned base at a site those bases, in order: four times the site's number and 1 (low), 2 (high) or 0
    (another base); lo and hi are the first and last one's positions. Records come with pos, cigar, seq, marks (a letter for each base of
    the reference that they span: A to P tells a site's low and high, a dot none) and n, the number of the first site there."""
    for batch in gathered(batches):
        for some, b in layouts(batch):
            seq, marks = Texts(some.column("seq")), Texts(some.column("marks"))
            r = b.record
            mark = marks.letters(r, b.off)
            site = (mark != 0) & (mark != ord("."))
            at = np.append(0, np.cumsum(site))
            number = _column(some, "n")[r] + at[:-1] - at[(np.cumsum(b.span) - b.span)[r]]
            base = UPPER[seq.letters(r, b.query)]
            k = np.flatnonzero(site & (b.kind == ALIGNED) & seq.valid[r] & (base != ord("*")) & (base != ord(">")))
            pair = mark[k].astype(np.int64) - ord("A")
            acgt = np.frombuffer(b"ACGT", np.uint8)
            code = np.where(base[k] == acgt[pair >> 2], 1, np.where(base[k] == acgt[pair & 3], 2, 0))
            each = np.bincount(r[k], minlength=some.num_rows)
            rows = np.flatnonzero(each)
            ends = np.cumsum(each[rows])
            where = _column(some, "pos")[r[k]] + b.off[k]
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array((number[k] << 2 | code).astype(np.int32)))
            of = some.take(pa.array(rows))
            yield pa.record_batch([of["chrom"], of["qname"], of["src"], of["ordinal"], pa.array(where[ends - each[rows]] if len(rows) else np.zeros(0, np.int64)), pa.array(where[ends - 1] if len(rows) else np.zeros(0, np.int64)), lists], names=["chrom", "qname", "src", "ordinal", "lo", "hi", "seen"])
