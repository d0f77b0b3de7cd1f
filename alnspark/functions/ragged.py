"""Texts of different lengths in one buffer: gathered and put together by numpy, for the tasks that read Arrow batches."""

from __future__ import annotations

import numpy as np


def places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all stretches, one stretch after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """Where each of the stretches begins if they follow each other."""
    return np.cumsum(lengths) - lengths


def text(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a string column, and each row's start and length there; a null has none."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n, first = len(column), column.offset
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[first : first + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at[:-1], np.diff(at)


def signs(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As text, by code points: beyond ASCII a sign has more bytes than one."""
    data, at, size = text(column)
    used = data[places(at, size)]
    if not (used >= 128).any():
        return data, at, size
    count = np.append(0, np.cumsum((used & 0xC0) != 0x80))  # all bytes but those that continue a sign
    first = starts_of(size)
    size = count[first + size] - count[first]
    return np.frombuffer(used.tobytes().decode().encode("utf-32-le"), np.uint32), starts_of(size), size


def strings(data: np.ndarray, lengths: np.ndarray, binary: bool = False):
    """A string column of rows that follow each other in data."""
    import pyarrow as pa

    at = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=at[1:])
    if at[-1] < 1 << 31:
        kind, at = pa.binary() if binary else pa.string(), at.astype(np.int32)
    else:
        kind = pa.large_binary() if binary else pa.large_string()
    out = pa.Array.from_buffers(kind, len(lengths), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data, np.uint8))])
    if not binary:
        out.validate(full=True)
    return out
