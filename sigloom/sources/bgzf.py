"""The block format below BAM: gzip members of at most 64 KiB that say how long they are, so a file can be read from any
block on."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

from pyarrow import fs

MAGIC = b"\x1f\x8b\x08\x04"
MOST, PAYLOAD = 1 << 16, 0xFF00  # bytes of a block, and of what we put into one
PIECE = 1 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """A file system and a path in it, of a URI or a path of this machine's."""
    system, inside = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))
    return system, inside.rstrip("/")


def length_at(data: bytes, at: int) -> int | None:
    """Length of the block that starts there; None if none does or its head isn't all there."""
    if data[at : at + 4] != MAGIC or len(data) < at + 12:
        return None
    extra = struct.unpack_from("<H", data, at + 10)[0]
    field, end = at + 12, at + 12 + extra
    while field + 4 <= min(end, len(data)):
        size = struct.unpack_from("<H", data, field + 2)[0]
        if data[field : field + 2] == b"BC" and size == 2 and field + 6 <= len(data):
            return struct.unpack_from("<H", data, field + 4)[0] + 1
        field += 4 + size
    return None


def block(payload: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    data = packer.compress(payload) + packer.flush()
    return MAGIC + b"\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(data) + 25) + data + struct.pack("<II", zlib.crc32(payload), len(payload))


END = block(b"")  # an empty block says that the file is whole


def unpacked(data: bytes, at: int, length: int) -> bytes:
    head = 12 + struct.unpack_from("<H", data, at + 10)[0]
    out = zlib.decompress(data[at + head : at + length - 8], -15)
    crc, size = struct.unpack_from("<II", data, at + length - 8)
    if len(out) != size or zlib.crc32(out) != crc:
        raise ValueError(f"a block of {len(out)} bytes doesn't match its own sum")
    return out


def first_block(file, start: int, size: int) -> int | None:
    """Where the first block at or after start begins: a head whose length leads to another head or to the file's end."""
    data = file.read_at(min(2 * MOST + 64, size - start), start) if start < size else b""
    at = data.find(MAGIC)
    while at >= 0:
        length = length_at(data, at)
        if length and (start + at + length == size or length_at(data, at + length) or (start + at + length < size and length_at(file.read_at(min(64, size - start - at - length), start + at + length), 0))):
            return start + at
        at = data.find(MAGIC, at + 1)
    return None


def blocks(file, start: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(place, content) of the blocks from one on."""
    held, base = b"", start
    at = 0
    while base + at < size:
        length = length_at(held, at)
        if length is None or at + length > len(held):
            more = file.read_at(min(PIECE, size - base - len(held)), base + len(held))
            if not more:
                raise ValueError(f"the file ends inside the block at {base + at}, or no block starts there")
            held, base, at = held[at:] + more, base + at, 0
            if length_at(held, 0) is None:
                raise ValueError(f"no block starts at {base}")
            continue
        yield base + at, unpacked(held, at, length)
        at += length


class Writer:
    """Puts records into blocks; a record that fits into one is not cut unless asked to be."""

    def __init__(self, out, whole: bool = True):
        self.out, self.whole, self.held = out, whole, bytearray()

    def add(self, record: bytes) -> None:
        if self.whole and self.held and len(self.held) + len(record) > PAYLOAD:
            self.flush()
        self.held += record
        while len(self.held) >= PAYLOAD:
            self.out.write(block(bytes(self.held[:PAYLOAD])))
            del self.held[:PAYLOAD]

    def flush(self) -> None:
        if self.held:
            self.out.write(block(bytes(self.held)))
            self.held.clear()
