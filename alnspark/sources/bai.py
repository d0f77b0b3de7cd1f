"""The binning and linear index of a BAM file: what it says of a region, and its bytes.

A virtual offset is the place of a block in the file times 65,536 plus a place in the unpacked block. A chunk is where records of one bin
begin within one block: from `beg` to before `end`.
"""

from __future__ import annotations

import struct

import numpy as np

from ..functions import ragged as G

# Fixed values of the format: the bits that the bins of each level span with the level's first bin, the window's bits.
LEVELS = ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1))
WINDOW, MOST, MAGIC = 14, 1 << 29, b"BAI\1"


def bin_of(start0: int, end0: int) -> int:
    """The smallest bin that holds the whole interval."""
    for bits, first in LEVELS:
        if start0 >> bits == (end0 - 1) >> bits:
            return first + (start0 >> bits)
    return 0


def bins_of(start0: np.ndarray, end0: np.ndarray) -> np.ndarray:
    """As `bin_of`, of many intervals."""
    out = np.zeros(len(start0), np.int64)
    for bits, first in reversed(LEVELS):
        level = start0 >> bits
        out = np.where(level == (end0 - 1) >> bits, first + level, out)
    return out


def bins_over(start0: int, end0: int) -> list[int]:
    """All bins that hold an interval with a base in common with this one."""
    return [0, *(b for bits, first in LEVELS for b in range(first + (start0 >> bits), first + (max(end0 - 1, start0) >> bits) + 1))]


class Builder:
    """Chunks and windows of the records that are added in the file's order."""

    def __init__(self, references: int):
        self.references = references
        self.chunks: dict[int, dict[int, list[list[int]]]] = {}
        self.windows: dict[int, dict[int, int]] = {}
        self.last = (0, 0)

    def add(self, tid: int, start0: int, end0: int, offset: int) -> None:
        if tid < 0 or start0 < 0:
            return
        if end0 > MOST:
            raise ValueError(f"a place beyond {MOST} has no bin")
        if (tid, start0) < self.last:
            raise ValueError("an index needs records in the order of their places")
        self.last = tid, start0
        chunks = self.chunks.setdefault(tid, {}).setdefault(bin_of(start0, end0), [])
        if chunks and chunks[-1][0] >> 16 == offset >> 16:
            chunks[-1][1] = offset + 1
        else:
            chunks.append([offset, offset + 1])
        windows = self.windows.setdefault(tid, {})
        for w in range(start0 >> WINDOW, (end0 - 1 >> WINDOW) + 1):
            windows.setdefault(w, offset)

    def add_all(self, tid: np.ndarray, start0: np.ndarray, end0: np.ndarray, offset: np.ndarray) -> None:
        """As `add`, of many records: what lies in one bin and block, or begins a window, is taken together."""
        k = (tid >= 0) & (start0 >= 0)
        tid, start0, end0, offset = tid[k].astype(np.int64), start0[k], end0[k], offset[k]
        if not len(tid):
            return
        if end0.max() > MOST:
            raise ValueError(f"a place beyond {MOST} has no bin")
        if (int(tid[0]), int(start0[0])) < self.last or ((np.diff(tid) < 0) | (np.diff(tid) == 0) & (np.diff(start0) < 0)).any():
            raise ValueError("an index needs records in the order of their places")
        self.last = int(tid[-1]), int(start0[-1])
        bins, block = bins_of(start0, end0), offset >> 16
        order = np.lexsort((offset, bins, tid))
        new = np.flatnonzero(np.append(True, (np.diff(tid[order]) != 0) | (np.diff(bins[order]) != 0) | (np.diff(block[order]) != 0)))
        beg, end = offset[order[new]], offset[order[np.append(new[1:], len(order)) - 1]] + 1
        for t, b, x, y in zip(*(v.tolist() for v in (tid[order[new]], bins[order[new]], beg, end)), strict=True):
            chunks = self.chunks.setdefault(t, {}).setdefault(b, [])
            if chunks and chunks[-1][0] >> 16 == x >> 16:
                chunks[-1][1] = y
            else:
                chunks.append([x, y])
        first = start0 >> WINDOW
        size = ((end0 - 1) >> WINDOW) - first + 1
        # windows are fewer than 2^15
        keys, at = np.unique(np.repeat(tid << 16, size) + G.places(first, size), return_index=True)
        for key, x in zip(keys.tolist(), np.repeat(offset, size)[at].tolist(), strict=True):
            self.windows.setdefault(key >> 16, {}).setdefault(key & 0xFFFF, x)

    def to_bytes(self) -> bytes:
        return encode(self.references, self.chunks, self.windows)


def encode(references: int, chunks: dict[int, dict[int, list]], windows: dict[int, dict[int, int]]) -> bytes:
    """chunks: by reference and bin; windows: first offset by reference and window."""
    out = [MAGIC, struct.pack("<i", references)]
    for tid in range(references):
        bins, linear = chunks.get(tid, {}), windows.get(tid, {})
        out.append(struct.pack("<i", len(bins)))
        for b in sorted(bins):
            out.append(struct.pack("<Ii", b, len(bins[b])))
            out += [struct.pack("<QQ", beg, end) for beg, end in sorted(bins[b])]
        # a window without a record has the offset of the one before it
        size, last = max(linear, default=-1) + 1, 0
        out.append(struct.pack("<i", size))
        for w in range(size):
            last = linear.get(w, last)
            out.append(struct.pack("<Q", last))
    return b"".join(out)


def decode(data: bytes) -> list[tuple[dict[int, list[tuple[int, int]]], list[int]]]:
    """Chunks by bin, and the windows' offsets, of each reference."""
    if data[:4] != MAGIC:
        raise ValueError("no BAI index")
    at, out = 8, []
    for _ in range(struct.unpack_from("<i", data, 4)[0]):
        bins: dict[int, list[tuple[int, int]]] = {}
        n = struct.unpack_from("<i", data, at)[0]
        at += 4
        for _ in range(n):
            b, k = struct.unpack_from("<Ii", data, at)
            flat = struct.unpack_from(f"<{2 * k}Q", data, at + 8)
            bins[b] = list(zip(flat[::2], flat[1::2]))
            at += 8 + 16 * k
        n = struct.unpack_from("<i", data, at)[0]
        out.append((bins, list(struct.unpack_from(f"<{n}Q", data, at + 4))))
        at += 4 + 8 * n
    return out


def ranges(index: list, tid: int, start0: int, end0: int | None) -> list[tuple[int, int]]:
    """Where records that overlap the interval of a reference may begin, as chunks. The file is in order of places, so what begins
    after a record of a smallest bin behind the interval does not reach it."""
    bins, linear = index[tid]
    end0 = MOST if end0 is None else min(end0, MOST)
    if end0 <= start0 or start0 >> WINDOW >= len(linear):
        return []
    over = linear[start0 >> WINDOW : (end0 - 1 >> WINDOW) + 1]
    least = min((x for x in over if x), default=0)
    leaf = LEVELS[0][1]
    behind = leaf + (end0 - 1 >> WINDOW) + 1
    most = min((beg for b in bins if behind <= b < leaf + (MOST >> WINDOW) for beg, _ in bins[b]), default=1 << 64)
    some = bins_over(start0, end0) if end0 - start0 < 1 << 26 else [b for b in bins if b < leaf + (MOST >> WINDOW)]
    return sorted((max(beg, least), min(end, most)) for b in some for beg, end in bins.get(b, []) if end > least and beg < most)
