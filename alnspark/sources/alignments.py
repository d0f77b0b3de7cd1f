"""SAM text in byte ranges, BAM in ranges of blocks or by its index, as read records; headers on the driver.

ordinal is the record's place in the file: its byte offset for SAM, its virtual offset (block and place in it) for BAM.
src numbers the files.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..functions import ragged as G
from ..operators.intervals import parse_region
from ..schema import READS
from . import bai
from .bam_write import BamWriter
from .files import _Raw, file_system, open_file, open_text, paths_of

#: Bytes of SAM text, or of packed blocks, in a partition.
SPLIT = 64 << 20
#: Records that are read as one Arrow batch.
BATCH = 8_192
#: Records in a row that tell where a range of blocks has its first one.
CHAIN = 8
# Fixed values of the format: operations, bases, sizes of a block and its head, tag types.
OPS, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
BLOCK_HEAD, MOST_BLOCK = 18, 1 << 16
KINDS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


def parse_header(text: str) -> dict[str, list[dict[str, str]]]:
    """Lines of a header by kind; each as its fields. @CO lines have one field, text."""
    out: dict[str, list[dict[str, str]]] = {"HD": [], "SQ": [], "RG": [], "PG": [], "CO": []}
    for line in text.splitlines():
        kind, _, rest = line[1:].partition("\t")
        if kind == "CO":
            out["CO"].append({"text": rest})
        elif kind in out:
            out[kind].append(dict(f.split(":", 1) for f in rest.split("\t") if ":" in f))
    return out


def sam_header(path: str) -> str:
    f = open_text(path)
    lines = []
    for line in f:
        if not line.startswith(b"@"):
            break
        lines.append(line.decode())
    return "".join(lines)


def references(path: str) -> list[tuple[int, str, int]]:
    """tid, name, length of a SAM file's @SQ lines."""
    return [(k, s["SN"], int(s["LN"])) for k, s in enumerate(parse_header(sam_header(path))["SQ"])]


def parse_record(line: str, ordinal: int, src: int, tids: dict[str, int]) -> tuple:
    f = line.rstrip("\r\n").split("\t")
    if len(f) < 11:
        raise ValueError(f"a record of {len(f)} fields: {line[:80]!r}")
    star = lambda x: None if x == "*" else x
    rname = star(f[2])
    rnext = rname if f[6] == "=" else star(f[6])
    tags: dict[str, tuple[str, str]] = {}
    order = []
    for t in f[11:]:
        name, kind, value = t.split(":", 2)
        if name not in tags:
            order.append(name)
        tags[name] = (kind, value)
    mapq = int(f[4])
    return (
        ordinal, src, f[0], int(f[1]), tids.get(rname) if rname else None, rname, int(f[3]) or None, None if mapq == 255 else mapq, star(f[5]),
        tids.get(rnext) if rnext else None, rnext, int(f[7]) or None, int(f[8]), star(f[9]), star(f[10]), tags, order,
    )


class _Range(InputPartition):
    """Bytes of a file; or, with an index, chunks: where the wanted records begin."""

    def __init__(self, path: str, src: int, start: int, end: int, chunks: list[tuple[int, int]] | None = None):
        self.path, self.src, self.start, self.end, self.chunks = path, src, start, end, chunks


class SamReader(DataSourceReader):
    def __init__(self, options):
        self.paths = paths_of(options)
        self.split = int(options.get("splitbytes", SPLIT))

    def partitions(self) -> list[InputPartition]:
        out = []
        for k, p in enumerate(self.paths):
            f, size = open_file(p)
            packed = f.read(2) == b"\x1f\x8b"
            step = size if packed else self.split
            out += [_Range(p, k, a, min(a + step, size)) for a in range(0, size, max(1, step))]
        return out or [_Range(self.paths[0], 0, 0, 0)]

    def read(self, part: _Range) -> Iterator[tuple]:
        if part.end == part.start:
            return
        tids = {name: k for k, name, _ in references(part.path)}
        f, size = open_file(part.path)
        if f.read(2) == b"\x1f\x8b":
            at = 0
            for line in open_text(part.path):
                if not line.startswith(b"@"):
                    yield parse_record(line.decode(), at, part.src, tids)
                at += len(line)
            return
        # a line belongs to the range that its first byte is in
        at = part.start
        if at:
            f.seek(at - 1)
            at = part.start - 1
            skip, buffered = True, b""
        else:
            f.seek(0)
            skip, buffered = False, b""
        while True:
            chunk = f.read(1 << 20)
            buffered += chunk
            lines = buffered.split(b"\n")
            buffered = lines.pop() if chunk else b""
            for line in lines:
                here, at = at, at + len(line) + 1
                if skip:
                    skip = False
                    continue
                if here >= part.end:
                    return
                if line and not line.startswith(b"@"):
                    yield parse_record(line.decode(), here, part.src, tids)
            if not chunk:
                return


class SamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sam"

    def schema(self) -> str:
        return READS

    def reader(self, schema) -> SamReader:
        return SamReader(self.options)


def _aux(data: bytes) -> tuple[dict[str, tuple[str, str]], list[str]]:
    tags, order, at = {}, [], 0
    while at < len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in KINDS:
            size = struct.calcsize(KINDS[kind])
            value = struct.unpack_from("<" + KINDS[kind], data, at)[0]
            at += size
            tags[name] = ("f", f"{value:g}") if kind == "f" else ("i", str(value))
        elif kind == "A":
            tags[name] = ("A", chr(data[at]))
            at += 1
        elif kind in "ZH":
            end = data.index(0, at)
            tags[name] = (kind, data[at:end].decode())
            at = end + 1
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            values = struct.unpack_from(f"<{n}{KINDS[sub]}", data, at + 5)
            at += 5 + struct.calcsize(f"<{n}{KINDS[sub]}")
            tags[name] = ("B", ",".join([sub, *(f"{v:g}" if sub == "f" else str(v) for v in values)]))
        else:
            raise ValueError(f"a tag of unknown type {kind!r}")
        order.append(name)
    return tags, order


def bam_header_text(path: str) -> str:
    f = open_text(path)
    if f.read(4) != b"BAM\1":
        raise ValueError(f"{path} is no BAM file")
    return f.read(struct.unpack("<i", f.read(4))[0]).rstrip(b"\0").decode()


def _bam_header(path: str) -> tuple[list[str], int]:
    """The references' names and the header's size before packing."""
    f = open_text(path)
    if f.read(4) != b"BAM\1":
        raise ValueError(f"{path} is no BAM file")
    text = struct.unpack("<i", f.read(4))[0]
    f.read(text)
    size, names = 12 + text, []
    for _ in range(struct.unpack("<i", f.read(4))[0]):
        n = struct.unpack("<i", f.read(4))[0]
        names.append(f.read(n)[:-1].decode())
        f.read(4)
        size += 8 + n
    return names, size


def _block_size(head: bytes) -> int:
    """The size of the BGZF block that begins with these bytes; 0 if none does."""
    packed = len(head) >= BLOCK_HEAD and head[:4] == b"\x1f\x8b\x08\x04" and head[12:16] == b"BC\x02\0"
    return struct.unpack_from("<H", head, 16)[0] + 1 if packed else 0


def _blocks(f, at: int, size: int) -> Iterator[tuple[int, bytes]]:
    """Place in the file and content of each block from `at` on."""
    f.seek(at)
    stream = io.BufferedReader(_Raw(f), 1 << 20)
    while at < size:
        head = stream.read(BLOCK_HEAD)
        if not (n := _block_size(head)):
            raise ValueError(f"no BGZF block at byte {at}")
        yield at, zlib.decompress(stream.read(n - BLOCK_HEAD), -15)
        at += n


def _first_block(f, size: int, at: int) -> int | None:
    """The first block that begins at `at` or later: one that another, or the end of the file, follows."""
    while at < size:
        f.seek(at)
        data = f.read(2 * MOST_BLOCK + BLOCK_HEAD)
        for k in range(min(MOST_BLOCK, len(data))):
            if n := _block_size(data[k : k + BLOCK_HEAD]):
                after = k + n
                if at + after == size or _block_size(data[after : after + BLOCK_HEAD]):
                    return at + k
        at += MOST_BLOCK
    return None


def _records(blocks: Iterator[tuple[int, bytes]], skip: int) -> Iterator[tuple[int, int, bytes]]:
    """The block that each record begins in, the place there, and the record, from `skip` bytes after the first block's
    start on. A record that begins where a block ends begins in the next."""
    data, base, marks = b"", 0, deque()
    for at, content in blocks:
        marks.append((base + len(data), at))
        data += content
        k = max(0, skip - base)
        while len(data) - k >= 4:
            n = struct.unpack_from("<i", data, k)[0]
            if len(data) - k < 4 + n:
                break
            while len(marks) > 1 and marks[1][0] <= base + k:
                marks.popleft()
            yield marks[0][1], base + k - marks[0][0], data[k + 4 : k + 4 + n]
            k += 4 + n
        k = min(k, len(data))
        data, base = data[k:], base + k
    if data:
        raise ValueError("the last record is cut")


def _plausible(data: bytes, k: int, references_: int) -> int | None:
    """The size of the record that may begin at k; 0 if none does; None if that takes more data."""
    if len(data) - k < 36:
        return None
    n, tid, pos, name_size, _, _, ops, _, size, mtid, mpos, _ = struct.unpack_from("<iiiBBHHHiiii", data, k)
    low, high = min(tid, mtid, pos, mpos), max(tid, mtid)
    if low < -1 or high >= references_ or not name_size or size < 0 or n < 32 + name_size + 4 * ops + (size + 1) // 2 + size:
        return 0
    name = data[k + 36 : k + 36 + name_size]
    if len(name) < name_size:
        return None
    return 4 + n if name[-1] == 0 and all(33 <= c <= 126 for c in name[:-1]) else 0


def _first_record(blocks: Iterator[tuple[int, bytes]], references_: int) -> int | None:
    """Bytes from the first block's start to the first record: where CHAIN records, or all up to the file's end, follow
    each other. None if no record begins there."""
    data, k, ended = b"", 0, False
    while True:
        while k < len(data):
            at, seen = k, 0
            while seen < CHAIN and at < len(data):
                n = _plausible(data, at, references_)
                if not n:
                    break
                at, seen = at + n, seen + 1
            else:
                if seen == CHAIN or at == len(data) and ended:
                    return k
                n = None  # beyond what was read
            if n is None and not ended:
                break
            k += 1
        if ended:
            return None
        more = next(blocks, None)
        ended = more is None
        data += b"" if ended else more[1]


def _bam_record(data: bytes, ordinal: int, src: int, names: list[str]) -> tuple:
    tid, pos, name_size, mapq, _, ops, flag, size, mtid, mpos, tlen = struct.unpack_from("<iiBBHHHiiii", data)
    at = 32
    qname = data[at : at + name_size - 1].decode()
    at += name_size
    cigar = "".join(f"{c >> 4}{OPS[c & 15]}" for c in struct.unpack_from(f"<{ops}I", data, at))
    at += 4 * ops
    packed = data[at : at + (size + 1) // 2]
    at += len(packed)
    seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:size]
    raw = data[at : at + size]
    at += size
    qual = None if not raw or raw[0] == 255 else "".join(chr(b + 33) for b in raw)
    tags, order = _aux(data[at:])
    if ops == 2 and cigar.startswith(f"{size}S") and cigar.endswith("N") and tags.get("CG", ("", ""))[1].startswith("I,"):  # operations beyond 65,535
        cigar = "".join(f"{int(c) >> 4}{OPS[int(c) & 15]}" for c in tags.pop("CG")[1].split(",")[1:])
        order.remove("CG")
    name = lambda t: names[t] if t >= 0 else None
    return (
        ordinal, src, qname, flag, tid if tid >= 0 else None, name(tid), pos + 1 or None, None if mapq == 255 else mapq, cigar or None,
        mtid if mtid >= 0 else None, name(mtid), mpos + 1 or None, tlen, seq or None, qual, tags, order,
    )


#: A record before its name, without its size.
FIXED = np.dtype([("tid", "<i4"), ("pos", "<i4"), ("name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("ops", "<u2"), ("flag", "<u2"), ("seq", "<i4"), ("mtid", "<i4"), ("mpos", "<i4"), ("tlen", "<i4")])
PAIR = pa.struct([("t", pa.string()), ("v", pa.string())])
ARROW = pa.schema([
    ("ordinal", pa.int64()), ("src", pa.int32()), ("qname", pa.string()), ("flag", pa.int32()), ("tid", pa.int32()), ("rname", pa.string()), ("pos", pa.int64()), ("mapq", pa.int32()), ("cigar", pa.string()),
    ("mtid", pa.int32()), ("rnext", pa.string()), ("pnext", pa.int64()), ("tlen", pa.int64()), ("seq", pa.string()), ("qual", pa.string()), ("tags", pa.map_(pa.string(), PAIR)), ("tag_order", pa.list_(pa.string())),
])


def _one_by_one(items: list[tuple[int, bytes]], src: int, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*(_bam_record(data, ordinal, src, names) for ordinal, data in items), strict=True))
    columns[15] = [[(k, {"t": t, "v": v}) for k, (t, v) in tags.items()] for tags in columns[15]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)


def _tag_rounds(data: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """Each tag's record, name (two bytes as a number), type and value, in the order of records: the first tags of all records
    together, then the second ones, and so on."""
    record, zeros = np.arange(len(at)), np.flatnonzero(data == 0)
    parts: list[tuple] = []
    while True:
        live = at < end
        record, at, end = record[live], at[live].copy(), end[live]
        if not len(record):
            break
        name, kinds = data[at].astype(np.int64) << 8 | data[at + 1], data[at + 2]
        for code in np.unique(kinds):
            k, kind = kinds == code, chr(code)
            first = at[k] + 3
            if kind in "cCsSiI":
                width = struct.calcsize(KINDS[kind])
                value = pc.cast(pa.array(np.ascontiguousarray(data[first[:, None] + np.arange(width)]).view(f"<{np.dtype(KINDS[kind].replace('i', 'i4').replace('I', 'u4')).str[1:]}")[:, 0]), pa.string())
                told, size = "i", width
            elif kind == "A":
                value, told, size = G.strings(data[first], np.ones(len(first), np.int64)), "A", 1
            elif kind in "ZH":
                long = zeros[np.searchsorted(zeros, first)] - first
                value, told, size = G.strings(data[G.places(first, long)], long), kind, long + 1
            else:  # numbers with a fraction and arrays, by the plain way
                sizes, values = [], []
                for a, e in zip(first.tolist(), end[k].tolist(), strict=True):
                    n = 4 if kind == "f" else 5 + struct.unpack_from("<i", data, a + 1)[0] * struct.calcsize(KINDS[chr(data[a])]) if kind == "B" else e - a
                    values.append(next(iter(_aux(data[a - 3 : a + n].tobytes())[0].values()))[1])
                    sizes.append(n)
                value, told, size = pa.array(values, pa.string()), kind, np.array(sizes)
            parts.append((record[k], name[k], told, value))
            at[k] = first + size
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.string()), pa.array([], pa.string())
    records = np.concatenate([p[0] for p in parts])
    order = np.argsort(records, kind="stable")
    kinds_ = pa.concat_arrays([pa.repeat(p[2], len(p[0])) for p in parts])
    values_ = pa.concat_arrays([p[3] for p in parts])
    return records[order], np.concatenate([p[1] for p in parts])[order], kinds_.take(pa.array(order)), values_.take(pa.array(order))


def _bam_batch(items: list[tuple[int, bytes]], src: int, names: list[str]) -> pa.RecordBatch:
    """As `_bam_record`, of many records at once."""
    n = len(items)
    data = np.frombuffer(b"".join(d for _, d in items), np.uint8)
    sizes = np.array([len(d) for _, d in items])
    start = G.starts_of(sizes)
    head = np.ascontiguousarray(data[start[:, None] + np.arange(FIXED.itemsize)]).view(FIXED)[:, 0]
    field = {k: head[k].astype(np.int64) for k in FIXED.names}
    at = start + FIXED.itemsize
    qname = G.strings(data[G.places(at, field["name"] - 1)], field["name"] - 1)
    at = at + field["name"]
    cigars = G.strings(data[G.places(at, 4 * field["ops"])], 4 * field["ops"], binary=True).dictionary_encode()
    texts = pa.array(["".join(f"{c >> 4}{OPS[c & 15]}" for c in np.frombuffer(x, "<u4").tolist()) or None for x in cigars.dictionary.to_pylist()], pa.string())
    at = at + 4 * field["ops"]
    size = field["seq"]
    k = G.places(np.zeros(n, np.int64), size)
    byte = data[np.repeat(at, size) + k // 2]
    seq = G.strings(np.frombuffer(BASES.encode(), np.uint8)[np.where(k % 2, byte & 15, byte >> 4)], size)
    at = at + (size + 1) // 2
    known = size > 0
    known[known] = data[at[known]] != 255
    raw = data[G.places(at, size * known)]
    record, name, kind, value = _tag_rounds(data, at + size, start + sizes)
    tag = np.unique(record << 16 | name)
    if len(tag) < len(record) or (name == ord("C") << 8 | ord("G")).any() or (raw > 94).any() or (data[start + FIXED.itemsize] > 127).any():
        return _one_by_one(items, src, names)  # repeated tags, operations in a tag, qualities beyond ASCII
    qual = G.strings(raw + np.uint8(33), size * known)
    codes, which = np.unique(name, return_inverse=True)
    keys = pa.array([bytes((c >> 8, c & 255)).decode() for c in codes.tolist()], pa.string()).take(pa.array(which))
    offsets = pa.array(np.append(0, np.cumsum(np.bincount(record, minlength=n))).astype(np.int32))
    null = lambda v, bad: pa.array(v, mask=bad)
    some = lambda column, there: pc.if_else(pa.array(there), column, pa.scalar(None, column.type))
    refs = pa.array(names, pa.string())
    number = lambda v: null(v.astype(np.int32), v < 0)
    columns = [
        pa.array(np.array([o for o, _ in items], np.int64)), pa.array(np.full(n, src, np.int32)), qname, pa.array(field["flag"].astype(np.int32)), number(field["tid"]), refs.take(number(field["tid"])), null(field["pos"] + 1, field["pos"] == -1),
        null(field["mapq"].astype(np.int32), field["mapq"] == 255), texts.take(cigars.indices), number(field["mtid"]), refs.take(number(field["mtid"])), null(field["mpos"] + 1, field["mpos"] == -1), pa.array(field["tlen"]),
        some(seq, size > 0), some(qual, known), pa.MapArray.from_arrays(offsets, keys, pa.StructArray.from_arrays([kind, value], fields=list(PAIR))), pa.ListArray.from_arrays(offsets, keys),
    ]
    return pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)


class BamReader(DataSourceReader):
    """Ranges of blocks. Where the first record of a range begins is told from the records that follow it; the range
    before, which knows for certain where its last one ends, fails if that was wrong. A file that isn't packed in BGZF
    blocks is one partition.

    A file with an index beside it (.bai) is read in part if that does: the option `regions` (region strings with blanks between
    them) or conditions on rname and pos (with spark.sql.python.filterPushdown.enabled) name the places. What is read holds all records there, and others too."""

    def __init__(self, options):
        self.paths = paths_of(options, ".bam")
        self.split = int(options.get("splitbytes", SPLIT))
        self.regions = [parse_region(r) for r in options["regions"].split()] if "regions" in options else None
        self.names: set[str] | None = None
        self.low, self.high = 1, None

    def pushFilters(self, filters):
        """The first and last wanted start on a set of references; Spark holds all records against the conditions again."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("rname",) and isinstance(f, (EqualTo, In)):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = names if self.names is None else self.names & names
            elif column == ("pos",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            if column == ("pos",) and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                high = f.value - isinstance(f, LessThan)
                self.high = high if self.high is None else min(self.high, high)
        return filters

    def _wanted(self) -> list[tuple[str, int, int | None]] | None:
        """Places by reference; None: all records."""
        if self.names is None:
            return self.regions
        pushed = [(n, self.low - 1, self.high) for n in sorted(self.names)]
        if self.regions is None:
            return pushed
        return [r for r in self.regions if r[0] in self.names]

    def _indexed(self, path: str, src: int, wanted) -> list[InputPartition] | None:
        """Partitions of the chunks that an index has for the places; None without one, or for records without a place."""
        fs, name = file_system(f"{path}.bai")
        if not fs.get_file_info(name).is_file or any(n == "*" for n, _, _ in wanted):
            return None
        index = bai.decode(open_file(f"{path}.bai")[0].read())
        tids = {n: k for k, n in enumerate(_bam_header(path)[0])}
        chunks = sorted({c for n, a, b in wanted if n in tids for c in bai.ranges(index, tids[n], a, b)})
        out: list[_Range] = []
        for beg, end in chunks:
            if not out or (beg >> 16) - (out[-1].chunks[0][0] >> 16) >= self.split:
                out.append(_Range(path, src, 0, 0, []))
            last = out[-1].chunks
            if last and (beg >> 16) - (last[-1][1] >> 16) <= MOST_BLOCK:  # the same block or the next
                last[-1] = (last[-1][0], max(end, last[-1][1]))
            else:
                last.append((beg, end))
        return out

    def partitions(self) -> list[InputPartition]:
        out, wanted = [], self._wanted()
        for k, p in enumerate(self.paths):
            if wanted is not None and (some := self._indexed(p, k, wanted)) is not None:
                out += some
                continue
            f, size = open_file(p)
            step = max(1, self.split) if _block_size(f.read(BLOCK_HEAD)) else max(1, size)
            out += [_Range(p, k, a, min(a + step, size)) for a in range(0, size, step)]
        return out

    def read(self, part: _Range) -> Iterator[tuple]:
        names, skip = _bam_header(part.path)
        for ordinal, data in self._found(part, names, skip):
            yield _bam_record(data, ordinal, part.src, names)

    def _found(self, part: _Range, names: list[str], skip: int) -> Iterator[tuple[int, bytes]]:
        """The records' virtual offsets and bytes."""
        f, size = open_file(part.path)
        if part.chunks is not None:
            done = 0
            for beg, end in part.chunks:
                for at, place, data in _records(_blocks(f, beg >> 16, size), beg & 0xFFFF):
                    if (offset := at << 16 | place) >= end:
                        break
                    if offset >= done:
                        yield offset, data
                        done = offset + 1
            return
        if not _block_size(f.read(BLOCK_HEAD)):
            stream = open_text(part.path)
            whole = ((0, chunk) for chunk in iter(lambda: stream.read(1 << 20), b""))
            for n, (_, _, data) in enumerate(_records(whole, skip)):
                yield n, data
            return
        head = skip
        if part.start:
            first = _first_block(f, size, part.start)
            skip = None if first is None else self._start(f, first, size, len(names), head)
        else:
            first = 0
        if skip is None:
            return
        for at, place, data in _records(_blocks(f, first, size), skip):
            if at >= part.end:
                self._confirm(part, at, place, len(names), head)
                return
            yield at << 16 | place, data

    def _start(self, f, first: int, size: int, references_: int, head: int) -> int | None:
        """Bytes from the block `first` to the first record in it or after; a header that reaches beyond it is passed."""
        seen = 0
        for at, content in _blocks(f, 0, size):
            if at >= first or seen >= head:
                break
            seen += len(content)
        if seen < head:  # the header isn't at its end here
            return head - seen
        return _first_record(_blocks(f, first, size), references_)

    def _confirm(self, part: _Range, at: int, place: int, references_: int, head: int) -> None:
        f, size = open_file(part.path)
        first = _first_block(f, size, part.end)
        skip = None if first is None else self._start(f, first, size, references_, head)
        told = None if skip is None else next(((a, p) for a, p, _ in _records(_blocks(f, first, size), skip)), None)
        if told != (at, place):
            raise ValueError(f"{part.path}: a record begins in block {at} at {place}, not at {told}; set splitBytes to the file's size")


class BamBatchReader(BamReader):
    """The same records as Arrow batches."""

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        names, skip = _bam_header(part.path)
        held: list[tuple[int, bytes]] = []
        for item in self._found(part, names, skip):
            held.append(item)
            if len(held) == BATCH:
                yield _bam_batch(held, part.src, names)
                held = []
        if held:
            yield _bam_batch(held, part.src, names)


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return READS

    def reader(self, schema) -> BamReader:
        return BamBatchReader(self.options)

    def writer(self, schema, overwrite: bool) -> BamWriter:
        return BamWriter(self.options, overwrite)
