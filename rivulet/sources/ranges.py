"""Files as byte ranges that tasks read on their own, on any file system that Arrow knows."""

from __future__ import annotations

from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import InputPartition

PIECE = 1 << 22


@dataclass
class Range(InputPartition):
    """Bytes begin to end of a file of size bytes."""

    path: str
    begin: int
    end: int
    size: int


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def ranges(path: str, length: int, parts: int = 0) -> list[Range]:
    """Every file at path (a file or a folder) in ranges of about length bytes, or in parts ranges each."""
    system, place = opened(path)
    info = system.get_file_info(place)
    prefix = path[: len(path) - len(place)] if path.endswith(place) else ""
    if info.type == fs.FileType.Directory:
        found = system.get_file_info(fs.FileSelector(place, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and not f.base_name.startswith(("_", ".")))
    elif info.is_file:
        files = [(info.path, info.size)]
    else:
        raise FileNotFoundError(path)
    out = []
    for name, size in files:
        n = parts or max(1, -(-size // length))
        cuts = [size * k // n for k in range(n + 1)]
        out += [Range(prefix + name, a, b, size) for a, b in zip(cuts, cuts[1:], strict=False)]
    return out


class Reader:
    """Bytes of a file by position, held in pieces: what is asked for is never more than a few pieces."""

    def __init__(self, path: str, size: int):
        system, place = opened(path)
        self.file, self.size, self.at, self.held = system.open_input_file(place), size, 0, b""

    def get(self, begin: int, length: int) -> bytes:
        """At most length bytes from begin."""
        end = min(self.size, begin + length)
        if begin >= end:
            return b""
        if begin < self.at or end > self.at + len(self.held):
            self.file.seek(begin)
            self.at, self.held = begin, self.file.read(max(PIECE, end - begin))
        return self.held[begin - self.at : end - self.at]

    def find(self, what: bytes, begin: int) -> int:
        """The next position of a byte string from begin, -1 if there is none."""
        while begin < self.size:
            piece = self.get(begin, PIECE)
            at = piece.find(what)
            if at >= 0:
                return begin + at
            begin += max(1, len(piece) - len(what) + 1)
        return -1

    def close(self) -> None:
        self.file.close()
