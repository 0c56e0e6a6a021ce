"""Random access to files: byte ranges, BGZF blocks and their virtual offsets, TBI and CSI indexes."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyarrow import fs

#: Bytes read at once; compressed bytes of a BGZF block at most.
CHUNK, BLOCK = 1 << 18, 1 << 16
_MAGIC = b"\x1f\x8b\x08\x04"


def _open(path: str):
    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system, inner


def files(path: str, endings: tuple[str, ...]) -> list[str]:
    """The path itself, or the files below it with one of the endings, in order."""
    system, inner = _open(path)
    if system.get_file_info(inner).type != fs.FileType.Directory:
        return [path]
    prefix = path[: len(path) - len(inner)]
    return sorted(prefix + x.path for x in system.get_file_info(fs.FileSelector(inner, recursive=True)) if x.type == fs.FileType.File and x.path.endswith(endings))


class File:
    """A file opened by path or URI; taken has the number of bytes read so far."""

    def __init__(self, path: str):
        system, inner = _open(path)
        self.handle = system.open_input_file(inner)
        self.size, self.taken = self.handle.size(), 0

    def read(self, at: int, n: int) -> bytes:
        out = self.handle.read_at(max(0, min(n, self.size - at)), at)
        self.taken += len(out)
        return out


def exists(path: str) -> bool:
    system, inner = _open(path)
    return system.get_file_info(inner).type == fs.FileType.File


def block_size(data: bytes, at: int = 0) -> int:
    """Bytes of the BGZF block that begins at a place of data, 0 if none does."""
    if data[at : at + 4] != _MAGIC or at + 18 > len(data):
        return 0
    extra, place = struct.unpack_from("<H", data, at + 10)[0], at + 12
    while place + 6 <= min(at + 12 + extra, len(data)):
        tag, length = data[place : place + 2], struct.unpack_from("<H", data, place + 2)[0]
        if tag == b"BC" and length == 2:
            return struct.unpack_from("<H", data, place + 4)[0] + 1
        place += 4 + length
    return 0


def find_block(file: File, at: int) -> int:
    """The first block that begins at `at` or later, the file's size if none does: a header counts if another block or the
    file's end follows it, so bytes of a payload that look like one don't."""
    if at == 0:
        return 0
    data = file.read(at, 2 * BLOCK + 64)
    k = data.find(_MAGIC)
    while 0 <= k < BLOCK:
        size = block_size(data, k)
        if size and (at + k + size == file.size or block_size(data, k + size)):
            return at + k
        k = data.find(_MAGIC, k + 1)
    return file.size


def blocks(file: File, at: int) -> Iterator[tuple[int, bytes]]:
    """(begin, plain bytes) of the blocks from one on."""
    data, base = b"", at
    while at < file.size:
        own = at - base
        size = block_size(data, own)
        if not size or own + size > len(data):
            data, base, own = file.read(at, CHUNK), at, 0
            size = block_size(data)
            if not size or size > len(data):
                raise ValueError(f"no whole BGZF block at {at}")
        head = 12 + struct.unpack_from("<H", data, own + 10)[0]
        yield at, zlib.decompress(data[own + head : own + size - 8], -15)
        at += size


def is_bgzf(file: File) -> bool:
    return block_size(file.read(0, 64)) > 0


class Stream:
    """Plain bytes of a BGZF file from a virtual offset on; place is the virtual offset of what comes next."""

    def __init__(self, file: File, offset: int = 0):
        self.source, self.data, self.at, self.start = blocks(file, offset >> 16), b"", 0, offset >> 16
        self._next()
        self.at = offset & 0xFFFF

    def _next(self) -> bool:
        for self.start, self.data in self.source:
            self.at = 0
            if self.data:
                return True
        self.data, self.at = b"", 0
        return False

    def place(self) -> int:
        if self.at >= len(self.data):
            self._next()
        return (self.start << 16 | self.at) if self.data else 1 << 63

    def read(self, n: int) -> bytes:
        out = []
        while n > 0:
            if self.at >= len(self.data) and not self._next():
                break
            part = self.data[self.at : self.at + n]
            self.at += len(part)
            n -= len(part)
            out.append(part)
        return b"".join(out)

    def line(self) -> bytes | None:
        """The next line without its end, None at the file's end."""
        out = []
        while True:
            if self.at >= len(self.data) and not self._next():
                return b"".join(out) if out else None
            k = self.data.find(b"\n", self.at)
            if k >= 0:
                out.append(self.data[self.at : k])
                self.at = k + 1
                return b"".join(out)
            out.append(self.data[self.at :])
            self.at = len(self.data)


class Index:
    """A TBI or CSI index: the chunks of virtual offsets by sequence and bin."""

    def __init__(self, path: str):
        data = b"".join(x for _, x in blocks(File(path), 0))
        self.names: list[str] = []
        if data[:4] == b"TBI\1":
            n, _, _, _, _, _, _, length = struct.unpack_from("<8i", data, 4)
            self.shift, self.depth, at, loffset = 14, 5, 36 + length, 0
            self.names = [x.decode() for x in data[36 : 36 + length].split(b"\0")[:-1]]
        elif data[:4] == b"CSI\1":
            self.shift, self.depth, aux = struct.unpack_from("<3i", data, 4)
            if aux >= 28:
                length = struct.unpack_from("<i", data, 40)[0]
                self.names = [x.decode() for x in data[44 : 44 + length].split(b"\0")[:-1]]
            n, at, loffset = struct.unpack_from("<i", data, 16 + aux)[0], 20 + aux, 8
        else:
            raise ValueError(f"neither TBI nor CSI: {path}")
        self.bins: list[dict[int, list[tuple[int, int]]]] = []
        for _ in range(n):
            own: dict[int, list[tuple[int, int]]] = {}
            count, at = struct.unpack_from("<i", data, at)[0], at + 4
            for _ in range(count):
                number, at = struct.unpack_from("<I", data, at)[0], at + 4 + loffset
                chunks, at = struct.unpack_from("<i", data, at)[0], at + 4
                own[number] = [struct.unpack_from("<QQ", data, at + 16 * k) for k in range(chunks)]
                at += 16 * chunks
            if not loffset:
                at += 4 + 8 * struct.unpack_from("<i", data, at)[0]
            # the bin after the last has counts, not chunks
            own.pop(((1 << 3 * (self.depth + 1)) - 1) // 7 + 1, None)
            self.bins.append(own)

    def chunks(self, sequence: int, beg: int, end: int) -> list[tuple[int, int]]:
        """Chunks, put together where they meet, that can hold records of a sequence from beg to end (from 1, inclusive)."""
        if not 0 <= sequence < len(self.bins):
            return []
        found, first = [], 0
        for level in range(self.depth + 1):
            shift = self.shift + 3 * (self.depth - level)
            for number in range(first + (beg - 1 >> shift), first + (end - 1 >> shift) + 1) if end - beg >> shift < len(self.bins[sequence]) else [k for k in self.bins[sequence] if first + (beg - 1 >> shift) <= k <= first + (end - 1 >> shift)]:
                found += self.bins[sequence].get(number, [])
            first += 1 << 3 * level
        out: list[tuple[int, int]] = []
        for a, b in sorted(found):
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], b))
            else:
                out.append((a, b))
        return out

    def starts(self) -> list[int]:
        """Virtual offsets at which records begin, in order."""
        return sorted({a for own in self.bins for chunks in own.values() for a, _ in chunks})
