"""Reads written as BAM: a folder of complete files, one for each partition, in the order of the partitions.

Tasks write below _temporary; the driver moves their files into place when all have ended, and removes everything when one
failed. With `index`, each file gets its index beside it, made while the file is written.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from ..functions import ragged as G
from . import bai
from .files import file_system
from .sequences import BGZF_END

# Fixed values of the format: operations, bases, head of a block, most bytes in a block, most operations.
OPS = {c: k for k, c in enumerate("MIDNSHP=X")}
BASES = {c: k for k, c in enumerate("=ACMGRSVTWYHKDBN")}
HEAD = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0"
MOST, MOST_OPS = 0xFF00, 0xFFFF
#: Widths of the integers of an array tag.
WIDTH = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


def block(data: bytes, level: int = 6) -> bytes:
    """A BGZF block of at most MOST bytes."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    packed = packer.compress(data) + packer.flush()
    return HEAD + struct.pack("<H", len(packed) + 25) + packed + struct.pack("<II", zlib.crc32(data), len(data))


def header_block(text: str) -> bytes:
    """The header before packing: its text, and the references of the text's SQ lines."""
    refs = [dict(f.split(":", 1) for f in line.split("\t")[1:] if ":" in f) for line in text.splitlines() if line.startswith("@SQ\t")]
    out = b"BAM\1" + struct.pack("<i", len(text.encode())) + text.encode() + struct.pack("<i", len(refs))
    for r in refs:
        name = r["SN"].encode() + b"\0"
        out += struct.pack("<i", len(name)) + name + struct.pack("<i", int(r["LN"]))
    return out


def _tag(name: str, kind: str, value: str) -> bytes:
    head = name.encode()
    if kind in "cCsSiI":
        n = int(value)
        return head + (b"i" + struct.pack("<i", n) if n < 1 << 31 else b"I" + struct.pack("<I", n))
    if kind == "f":
        return head + b"f" + struct.pack("<f", float(value))
    if kind == "A":
        return head + b"A" + value.encode()
    if kind in "ZH":
        return head + kind.encode() + value.encode() + b"\0"
    if kind == "B":
        sub, *rest = value.split(",")
        numbers = [float(x) if sub == "f" else int(x) for x in rest]
        return head + b"B" + sub.encode() + struct.pack(f"<i{len(numbers)}{WIDTH[sub]}", len(numbers), *numbers)
    raise ValueError(f"a tag of unknown type {kind!r}")


@dataclass
class Encoded:
    data: bytes
    tid: int
    start0: int
    end0: int


def encode(row: Mapping, tids: dict[str, int]) -> Encoded:
    """A read as a record, with its size before it. Names come from the header: one that isn't there fails."""

    def number(name: str | None) -> int:
        if name is not None and name not in tids:
            raise ValueError(f"the header has no reference {name!r}")
        return -1 if name is None else tids[name]

    tid, mate, pos = number(row["rname"]), number(row["rnext"]), (row["pos"] or 0) - 1
    ops = [(int(n), OPS[c]) for n, c in re.findall(r"(\d+)([MIDNSHP=X])", row["cigar"] or "")]
    seq, qual, name = row["seq"] or "", row["qual"], row["qname"].encode()
    span = sum(n for n, c in ops if c in (0, 2, 3, 7, 8))
    tags = b"".join(_tag(k, row["tags"][k]["t"], row["tags"][k]["v"]) for k in row["tag_order"] or [])
    if len(ops) > MOST_OPS:  # the operations go to a tag
        tags += b"CGBI" + struct.pack(f"<i{len(ops)}I", len(ops), *[n << 4 | c for n, c in ops])
        ops = [(len(seq), OPS["S"]), (span, OPS["N"])]
    codes = [BASES.get(c, 15) for c in seq.upper()] + [0] * (len(seq) % 2)
    quals = b"\xff" * len(seq) if qual is None else bytes(ord(c) - 33 for c in qual)
    if len(quals) != len(seq):
        raise ValueError(f"{row['qname']}: {len(seq)} bases and {len(quals)} qualities")
    end = pos + max(1, span)
    body = struct.pack("<iiBBHHHiiii", tid, pos, len(name) + 1, 255 if row["mapq"] is None else row["mapq"], bai.bin_of(pos, end) & 0xFFFF, len(ops), row["flag"], len(seq), mate, (row["pnext"] or 0) - 1, row["tlen"] or 0)
    body += name + b"\0" + struct.pack(f"<{len(ops)}I", *[n << 4 | c for n, c in ops])
    body += bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2])) + quals + tags
    return Encoded(struct.pack("<i", len(body)) + body, tid, pos, end)


#: A record before its name.
FIXED = np.dtype([("n", "<i4"), ("tid", "<i4"), ("pos", "<i4"), ("name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("ops", "<u2"), ("flag", "<u2"), ("seq", "<i4"), ("mtid", "<i4"), ("mpos", "<i4"), ("tlen", "<i4")])
#: Code of each byte of a sequence.
CODES = np.full(256, 15, np.uint8)
for _c, _k in BASES.items():
    CODES[[ord(_c), ord(_c.lower())]] = _k


@dataclass
class Batch:
    """Records one after the other; `ends`: where each ends in data."""

    data: np.ndarray
    ends: np.ndarray
    tid: np.ndarray
    start0: np.ndarray
    end0: np.ndarray


def _numbers(column: pa.Array, tids: dict[str, int]) -> np.ndarray:
    coded = column.dictionary_encode()
    for name in coded.dictionary.to_pylist():
        if name not in tids:
            raise ValueError(f"the header has no reference {name!r}")
    known = np.array([*(tids[n] for n in coded.dictionary.to_pylist()), -1])
    return known[pc.fill_null(coded.indices, len(known) - 1).to_numpy()]


def _whole(column: pa.Array, null: int) -> np.ndarray:
    return pc.fill_null(column, null).to_numpy(zero_copy_only=False).astype(np.int64)


def _packed(parts: list[bytes], which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of distinct parts, and the start and length of each row's part."""
    sizes = np.array([len(p) for p in parts] or [0])
    return np.frombuffer(b"".join(parts), np.uint8), G.starts_of(sizes)[which], sizes[which]


def _tags(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tags in their order as bytes: the distinct ones, each tag's start and length there, and its record. A batch has few
    distinct values of most tags, so each is made once."""
    tags, order = batch.column("tags"), batch.column("tag_order")
    rows = np.arange(batch.num_rows)
    of_map, of_order = tags.offsets.to_numpy().astype(np.int64), order.offsets.to_numpy().astype(np.int64)
    in_map, in_order = np.diff(of_map), np.diff(of_order)
    at, wanted = G.places(of_map[:-1], in_map), order.values.take(pa.array(G.places(of_order[:-1], in_order)))
    keys = tags.keys.take(pa.array(at))
    record = np.repeat(rows, in_order)
    if not (np.array_equal(in_map, in_order) and keys.equals(wanted)):  # the map has another order than the record
        both = pa.concat_arrays([keys, wanted]).dictionary_encode()
        code = both.indices.to_numpy().astype(np.int64)
        width = max(1, len(both.dictionary))
        mine, theirs = np.repeat(rows, in_map) * width + code[: len(keys)], record * width + code[len(keys) :]
        ranked = np.argsort(mine)
        found = np.searchsorted(mine[ranked], theirs)
        if len(theirs) and (not len(mine) or found.max() >= len(mine) or (mine[ranked[found]] != theirs).any()):
            raise KeyError("a tag of the order that the record hasn't got")
        at = at[ranked[found]]
    kind, value = (tags.items.field(k).take(pa.array(at)) for k in ("t", "v"))
    told = pc.binary_join_element_wise(wanted, kind, value, "\0")
    if told.null_count:
        raise ValueError("a tag without a value")
    coded = told.dictionary_encode()
    return *_packed([_tag(*t.split("\0", 2)) for t in coded.dictionary.to_pylist()], coded.indices.to_numpy()), record


def _one_by_one(rows: list[Mapping], tids: dict[str, int]) -> Batch:
    each = [encode(r, tids) for r in rows]
    return Batch(np.frombuffer(b"".join(e.data for e in each), np.uint8), np.cumsum([len(e.data) for e in each]), *(np.array([getattr(e, k) for e in each]) for k in ("tid", "start0", "end0")))


def encode_batch(batch: pa.RecordBatch, tids: dict[str, int]) -> Batch:
    """As `encode`, of all records of a batch at once."""
    n, c = batch.num_rows, batch.column
    (seq, seq_at, size), (qual, qual_at, qual_size), (name, name_at, name_size) = (G.text(c(k)) for k in ("seq", "qual", "qname"))
    coded = pc.fill_null(c("cigar"), "").dictionary_encode()
    ops = [[(int(k), OPS[o]) for k, o in re.findall(r"(\d+)([MIDNSHP=X])", text)] for text in coded.dictionary.to_pylist()]
    if any(len(o) > MOST_OPS for o in ops) or (seq > 127).any() or (qual > 127).any():
        return _one_by_one([{**r, "tags": dict(r["tags"] or [])} for r in batch.to_pylist()], tids)
    which = coded.indices.to_numpy()
    cigar, cigar_at, cigar_size = _packed([struct.pack(f"<{len(o)}I", *[k << 4 | x for k, x in o]) for o in ops], which)
    span = np.array([sum(k for k, x in o if x in (0, 2, 3, 7, 8)) for o in ops] or [0])[which]
    has_qual = c("qual").is_valid().to_numpy(zero_copy_only=False)
    wrong = np.flatnonzero(has_qual & (qual_size != size))
    if len(wrong):
        raise ValueError(f"{c('qname')[int(wrong[0])]}: {size[wrong[0]]} bases and {qual_size[wrong[0]]} qualities")
    tag, tag_at, tag_size, tag_record = _tags(batch)
    in_tags = np.bincount(tag_record, weights=tag_size, minlength=n).astype(np.int64)
    pos = _whole(c("pos"), 0) - 1
    end = pos + np.maximum(1, span)
    fields = {
        "tid": _numbers(c("rname"), tids), "pos": pos, "name": name_size + 1, "mapq": _whole(c("mapq"), 255), "bin": bai.bins_of(pos, end) & 0xFFFF, "ops": cigar_size // 4,
        "flag": _whole(c("flag"), 0), "seq": size, "mtid": _numbers(c("rnext"), tids), "mpos": _whole(c("pnext"), 0) - 1, "tlen": _whole(c("tlen"), 0),
    }
    fields["n"] = FIXED.itemsize - 4 + fields["name"] + cigar_size + (size + 1) // 2 + size + in_tags
    fixed = np.zeros(n, FIXED)
    for k, v in fields.items():
        if n and not (np.iinfo(FIXED[k]).min <= v.min() and v.max() <= np.iinfo(FIXED[k]).max):
            raise ValueError(f"a value of {k} that BAM has no room for")
        fixed[k] = v
    whole = fields["n"] + 4
    at = G.starts_of(whole)
    out = np.full(int(whole.sum()), 255, np.uint8)  # a missing quality is 255

    def put(first: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        out[G.places(first, lengths)] = data[G.places(starts, lengths)]

    out[at[:, None] + np.arange(FIXED.itemsize)] = fixed.view(np.uint8).reshape(n, FIXED.itemsize)
    to = at + FIXED.itemsize
    put(to, name, name_at, name_size)
    out[to + name_size] = 0
    to = to + name_size + 1
    put(to, cigar, cigar_at, cigar_size)
    to = to + cigar_size
    pairs = (size + 1) // 2
    k = G.places(np.zeros(n, np.int64), pairs)
    first, codes = np.repeat(seq_at, pairs) + 2 * k, np.append(CODES[seq], np.uint8(0))
    second = np.where(2 * k + 1 < np.repeat(size, pairs), first + 1, len(codes) - 1)
    out[G.places(to, pairs)] = codes[first] << 4 | codes[second]
    to = to + pairs
    if len(qual) and qual[G.places(qual_at, qual_size)].min(initial=33) < 33:
        raise ValueError("a quality below 0")
    put(to[has_qual], qual - np.uint8(33), qual_at[has_qual], qual_size[has_qual])
    to = to + size
    behind = G.starts_of(tag_size) - np.repeat(G.starts_of(in_tags), np.bincount(tag_record, minlength=n))
    put(to[tag_record] + behind, tag, tag_at, tag_size)
    return Batch(out, np.cumsum(whole), fields["tid"], pos, end)


@dataclass
class Written(WriterCommitMessage):
    partition: int
    path: str
    rows: int


class BamWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.header, self.index = options.get("header", ""), options.get("index", "false") == "true"
        self.staging = f"{self.path}/_temporary-{uuid.uuid4().hex}"
        fs, folder = file_system(self.path)
        if not overwrite and bam_files(fs, folder):
            raise FileExistsError(f"{self.path} has BAM files; overwrite them, or write elsewhere")
        file_system(self.staging)[0].create_dir(file_system(self.staging)[1])

    def write(self, iterator: Iterator[pa.RecordBatch | Mapping]) -> Written:
        """Spark gives batches; a single row is taken too."""
        from pyspark import TaskContext

        context = TaskContext.get()
        tids = {m[1]: k for k, m in enumerate(re.finditer(r"^@SQ\t(?:.*\t)?SN:([^\t\n]+)", self.header, re.M))}
        path = f"{self.staging}/{context.partitionId():05d}-{context.taskAttemptId()}.bam"
        fs, name = file_system(path)
        rows, marks = 0, bai.Builder(len(tids))
        with fs.open_output_stream(name, compression=None) as out:
            head = header_block(self.header)
            for k in range(0, len(head), MOST):
                out.write(block(head[k : k + MOST]))
            at, held = out.tell(), bytearray()

            def flush() -> None:
                nonlocal at
                for k in range(0, len(held), MOST):
                    out.write(block(bytes(held[k : k + MOST])))
                held.clear()
                at = out.tell()

            for batch in iterator:
                r = encode_batch(batch, tids) if isinstance(batch, pa.RecordBatch) else _one_by_one([batch], tids)
                offsets, k, begin = np.zeros(len(r.ends), np.int64), 0, 0
                while k < len(offsets):
                    # a block takes whole records; one that is longer has blocks of its own
                    j = int(np.searchsorted(r.ends, begin + MOST - len(held), "right"))
                    if j <= k and held:
                        flush()
                        continue
                    j = max(j, k + 1)
                    offsets[k:j] = at << 16 | len(held)
                    offsets[k + 1 : j] += r.ends[k : j - 1] - begin
                    held += r.data[begin : r.ends[j - 1]].tobytes()
                    k, begin = j, int(r.ends[j - 1])
                    if len(held) >= MOST:
                        flush()
                if self.index:
                    marks.add_all(r.tid, r.start0, r.end0, offsets)
                rows += len(offsets)
            flush()
            out.write(BGZF_END)
        if self.index:
            with fs.open_output_stream(f"{name}.bai", compression=None) as out:
                out.write(marks.to_bytes())
        return Written(context.partitionId(), path, rows)

    def commit(self, messages: list[Written]) -> None:
        fs, folder = file_system(self.path)
        old = bam_files(fs, folder) if self.overwrite else []
        for f in old:
            for name in (f, f"{f}.bai"):
                if fs.get_file_info(name).is_file:
                    fs.delete_file(name)
        for k, m in enumerate(sorted((m for m in messages if m), key=lambda m: m.partition)):
            source = file_system(m.path)[1]
            fs.move(source, f"{folder}/part-{k:05d}.bam")
            if self.index:
                fs.move(f"{source}.bai", f"{folder}/part-{k:05d}.bam.bai")
        fs.delete_dir(file_system(self.staging)[1])

    def abort(self, messages: list[Written | None]) -> None:
        fs, folder = file_system(self.staging)
        if fs.get_file_info(folder).is_file or fs.get_file_info(folder).type.name == "Directory":
            fs.delete_dir(folder)


def bam_files(fs, folder: str) -> list[str]:
    from pyarrow.fs import FileSelector

    return sorted(f.path for f in fs.get_file_info(FileSelector(folder, allow_not_found=True)) if f.is_file and f.path.endswith(".bam"))
