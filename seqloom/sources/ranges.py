"""Byte ranges of files, for readers that never hold a file as a whole."""

import os
import pickle
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import InputPartition


@dataclass
class FileRange(InputPartition):
    """``[start, end)`` of a file of ``size`` bytes; ``number`` counts the ranges of one file."""

    path: str
    size: int
    number: int
    start: int
    end: int


class RangeGroup(InputPartition):
    """Ranges that one task reads.

    The driver holds the groups of all tasks, so a group is packed, some ten bytes a file of a
    folder of small ones, and unpacked where it is read.
    """

    def __init__(self, ranges: list[FileRange]):
        folder = ranges[0].path[: ranges[0].path.rindex("/") + 1] if ranges else ""
        if not all(one.path.startswith(folder) for one in ranges):
            folder = ""
        rows = [(r.path[len(folder) :], r.size, r.number, r.start, r.end) for r in ranges]
        columns = [list(column) for column in zip(*rows, strict=True)]
        self.packed = zlib.compress(pickle.dumps((folder, columns)))

    @property
    def ranges(self) -> list[FileRange]:
        folder, columns = pickle.loads(zlib.decompress(self.packed))
        return [FileRange(folder + name, *rest) for name, *rest in zip(*columns, strict=True)]


def file_sizes(uri: str) -> Iterator[tuple[str, int]]:
    """URIs and sizes of a file, or of the files of a folder, in any order.

    A local folder (or one that is mounted) is listed as it is read, and never held as a whole.
    """
    system, root = fs.FileSystem.from_uri(uri)
    found = system.get_file_info(root)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    if found.type == fs.FileType.File:
        return iter([(uri, found.size)])
    prefix = uri[: uri.rindex(root.rstrip("/"))]
    return ((prefix + path, size) for path, size in _listed(system, root))


def _listed(system: fs.FileSystem, root: str) -> Iterator[tuple[str, int]]:
    """Paths and sizes of a folder's files; hidden names are work in progress of some writer."""
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(root) as entries:
            for entry in entries:
                if entry.name[0] not in "._" and entry.is_file():
                    yield f"{root.rstrip('/')}/{entry.name}", entry.stat().st_size
    else:
        for f in system.get_file_info(fs.FileSelector(root, recursive=False)):
            if f.type == fs.FileType.File and f.base_name[0] not in "._":
                yield f.path, f.size


def dealt_ranges(files: Iterable[tuple[str, int]], piece: int, task: int) -> list[RangeGroup]:
    """Ranges of ``piece`` bytes, in groups of about ``task`` bytes; an open file costs some too."""
    groups: list[RangeGroup] = []
    ranges: list[FileRange] = []
    held = 0
    for path, size in files:
        for number, start in enumerate(range(0, max(size, 1), piece)):
            end = min(size, start + piece)
            if held >= task:
                groups.append(RangeGroup(ranges))
                ranges, held = [], 0
            ranges.append(FileRange(path, size, number, start, end))
            held += end - start + (1 << 16)
    return [*groups, RangeGroup(ranges)] if ranges else groups


class RangeFile:
    """Reads of one file by place; ``bytes_read`` counts what was asked for."""

    def __init__(self, uri: str):
        system, path = fs.FileSystem.from_uri(uri)
        self._file = system.open_input_file(path)
        self.size = self._file.size()
        self.bytes_read = 0

    def read(self, start: int, end: int) -> bytes:
        start, end = max(0, start), min(end, self.size)
        if start >= end:
            return b""
        self.bytes_read += end - start
        self._file.seek(start)
        return self._file.read(end - start)

    def __enter__(self) -> "RangeFile":
        return self

    def __exit__(self, *_) -> None:
        self._file.close()


def opened(ranges: list[FileRange]) -> Iterator[tuple[FileRange, RangeFile]]:
    """Each range with its file, which stays open while ranges of it follow."""
    path, file = None, None
    try:
        for one in ranges:
            if one.path != path:
                if file:
                    file._file.close()
                path, file = one.path, RangeFile(one.path)
            yield one, file
    finally:
        if file:
            file._file.close()
