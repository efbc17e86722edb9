"""Worker-side helper: files compressed in blocks, read from any block on.

Spark's writers make such files with the codec snappy: each block tells how many bytes of content it has and, in front of each of
its chunks, how long that chunk is. So the blocks are found by reading these lengths only, and a task can begin at any of them.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs

SUFFIX = ".snappy"


def is_blocked(path: str) -> bool:
    return path.endswith(SUFFIX)


def _number(file) -> int | None:
    data = file.read(4)
    return int.from_bytes(data, "big") if len(data) == 4 else None


def _content_length(chunk: bytes) -> int:
    """What a chunk begins with: the length of its content, seven bits to a byte, the lowest first."""
    length = 0
    for i, byte in enumerate(chunk[:5]):
        length |= (byte & 127) << 7 * i
        if byte < 128:
            break
    return length


def places(file) -> Iterator[tuple[int, int]]:
    """Where the blocks of a file begin, in its content and in the file itself, and where both end. Only lengths are read."""
    base = at = 0
    while (length := _number(file)) is not None:
        yield base, at
        base, at, left = base + length, at + 4, length
        while left > 0 and (size := _number(file)) is not None:
            left -= _content_length(file.read(min(size, 5)))
            at += 4 + size
            file.seek(at)
    yield base, at


class Blocks:
    """The content of such a file as a file, from the block on that begins at `at` and at `base` in the content."""

    def __init__(self, file: fs.FileSystem, at: int = 0, base: int = 0):
        self.file, self.first = file, (at, base)
        self._begin()

    def _begin(self) -> None:
        at, self.base = self.first
        self.file.seek(at)
        self.held, self.place = b"", 0

    def _more(self) -> bool:
        """Takes the next block; false at the file's end."""
        length = _number(self.file)
        if length is None:
            return False
        self.base, self.place, parts = self.base + len(self.held), 0, []
        while length > 0 and (size := _number(self.file)) is not None:
            chunk = self.file.read(size)
            parts.append(pa.decompress(chunk, _content_length(chunk), "snappy", asbytes=True))
            length -= len(parts[-1])
        self.held = b"".join(parts)
        return True

    def seek(self, place: int) -> None:
        """To a place of the content, which is not before the first block."""
        if place < self.base:
            self._begin()
        while place > self.base + len(self.held) and self._more():
            pass
        self.place = place - self.base

    def read(self, size: int) -> bytes:
        parts, left = [], size
        while left > 0 and (self.place < len(self.held) or self._more()):
            parts.append(self.held[self.place : self.place + left])
            self.place += len(parts[-1])
            left -= len(parts[-1])
        return b"".join(parts)
