"""Opening local and remote files from tasks."""

from __future__ import annotations

import gzip
import io


def file_system(path: str):
    """The file system that a path names, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def open_file(path: str):
    """(seekable binary file, its size), on whatever file system the path names."""
    system, name = file_system(path)
    return system.open_input_file(name), system.get_file_info(name).size


def open_text(path: str) -> io.BufferedIOBase:
    """A binary stream of the file's content, unpacked if it is packed (BGZF is a sequence of gzip members)."""
    f, _ = open_file(path)
    head = f.read(2)
    f.seek(0)
    return gzip.GzipFile(fileobj=f) if head == b"\x1f\x8b" else io.BufferedReader(_Raw(f), 1 << 20)


class _Raw(io.RawIOBase):
    def __init__(self, f):
        self.f = f

    def readable(self) -> bool:
        return True

    def readinto(self, b) -> int:
        data = self.f.read(len(b))
        b[: len(data)] = data
        return len(data)


def paths_of(options, suffix: str = "") -> list[str]:
    """The paths of a load call: 'path', 'paths' separated by commas, or 'pathsFile', a file with one on each line. A
    folder stands for its files with the suffix, by name."""
    if "pathsfile" in options:
        found = open_text(options["pathsfile"]).read().decode().splitlines()
    elif "paths" in options:
        found = options["paths"].split(",")
    elif "path" in options:
        found = [options["path"]]
    else:
        raise ValueError("a path is missing")
    return [f for p in found if p.strip() for f in _within(p.strip(), suffix)]


def _within(path: str, suffix: str) -> list[str]:
    from pyarrow.fs import FileSelector, FileType

    fs, name = file_system(path)
    if not suffix or fs.get_file_info(name).type != FileType.Directory:
        return [path]
    return sorted(f"{path.rstrip('/')}/{f.base_name}" for f in fs.get_file_info(FileSelector(name)) if f.is_file and f.base_name.endswith(suffix))
