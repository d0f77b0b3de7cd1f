"""FASTA and FASTQ, one partition for each file; and quick checks of files."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import open_file, open_text, paths_of

# Fixed value: the empty block at the end of a BGZF file.
BGZF_END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


class _File(InputPartition):
    def __init__(self, path: str, part: int):
        self.path, self.part = path, part


class _Files(DataSourceReader):
    def __init__(self, options):
        self.paths = paths_of(options)

    def partitions(self) -> list[InputPartition]:
        return [_File(p, k) for k, p in enumerate(self.paths)]


class FastaReader(_Files):
    def read(self, part: _File) -> Iterator[tuple]:
        """name, comment, seq, and what an index needs: length, offset, linebases, linewidth."""
        name = None
        at, parts = 0, []
        for line in open_text(part.path):
            if line.startswith(b">"):
                if name is not None:
                    yield name, comment, "".join(parts), sum(map(len, parts)), offset, bases, width, part.part
                name, _, comment = line[1:].decode().strip().partition(" ")
                parts, offset, bases, width = [], at + len(line), 0, 0
            elif name is not None:
                text = line.decode().strip()
                if text and not bases:
                    bases, width = len(text), len(line)
                parts.append(text)
            at += len(line)
        if name is not None:
            yield name, comment, "".join(parts), sum(map(len, parts)), offset, bases, width, part.part


class FastaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "name string, comment string, seq string, length bigint, offset bigint, linebases int, linewidth int, part int"

    def reader(self, schema) -> FastaReader:
        return FastaReader(self.options)


class FastqReader(_Files):
    def read(self, part: _File) -> Iterator[tuple]:
        lines = (x.decode().rstrip("\r\n") for x in open_text(part.path))
        n = 0
        for head in lines:
            if not head:
                continue
            if head[0] != "@":
                raise ValueError(f"no FASTQ record begins with {head[:40]!r}")
            seq = []
            for line in lines:
                if line.startswith("+"):
                    break
                seq.append(line)
            text, qual = "".join(seq), ""
            while len(qual) < len(text):
                qual += next(lines)
            name, _, comment = head[1:].partition(" ")
            yield n, part.part, name, comment, text, qual
            n += 1


class FastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return "ordinal bigint, part int, name string, comment string, seq string, qual string"

    def reader(self, schema) -> FastqReader:
        return FastqReader(self.options)


def quickcheck(path: str) -> int:
    """0, or the sum of: 2 can't be opened, 4 no alignments, 8 no references in the header, 16 no end mark."""
    from .alignments import parse_header, sam_header

    try:
        f, size = open_file(path)
    except OSError:
        return 2
    head = f.read(4)
    if head[:2] == b"\x1f\x8b":
        body = open_text(path).read(4)
        f.seek(max(0, size - len(BGZF_END)))
        state = 0 if f.read() == BGZF_END else 16
        return state if body == b"BAM\1" else state | 4
    if head[:1] != b"@":
        return 4
    return 0 if parse_header(sam_header(path))["SQ"] else 8
