"""Wavelet matrices of token ids, one compressed file for each shard.

The ids of a shard are cut into bit planes, the highest bit first; each plane orders the ids stably by their bit for the next
one. With the count of ones before each block of a plane (rank) a file answers, without being unpacked as a whole: which id
stands at a place (access), how often an id occurs before a place (rank), and where its k-th occurrence is (select).

File: magic; number of ids, of documents and of planes; sections, each after its length; CRC-32 of all before it. The first
section holds the documents (ids, null marks, ends). A plane's section holds its number of zeros, the ones before each block
and the places of its blocks; blocks of 32,768 bits are compressed one by one, or stay as they are where that is shorter."""

from __future__ import annotations

import struct
import zlib
from collections import OrderedDict

import numpy as np
import zstandard

MAGIC = b"WAVEMAT1"
#: Bytes of a block of a plane, and blocks that an opened file keeps unpacked.
BLOCK, KEPT = 4096, 256


def _pack(parts: list[bytes]) -> bytes:
    return b"".join(struct.pack("<Q", len(p)) + p for p in parts)


def _plane(bits: np.ndarray, press: zstandard.ZstdCompressor) -> bytes:
    raw = np.packbits(bits, bitorder="little")
    ones = np.cumsum([0, *(int(np.bitwise_count(raw[a : a + BLOCK]).sum()) for a in range(0, len(raw), BLOCK))], dtype=np.uint64)
    blocks = []
    for a in range(0, len(raw), BLOCK):
        plain = raw[a : a + BLOCK].tobytes()
        small = press.compress(plain)
        blocks.append(b"\1" + small if len(small) < len(plain) else b"\0" + plain)
    at = np.cumsum([0, *map(len, blocks)], dtype=np.uint64)
    return struct.pack("<QQ", len(bits) - int(ones[-1]), len(blocks)) + ones.tobytes() + at.tobytes() + b"".join(blocks)


def pack(ids: np.ndarray, doc_ids: list[int | None], ends: np.ndarray) -> bytes:
    """The file of ``ids`` (unsigned integers), whose documents ``doc_ids`` (null allowed) end at ``ends`` (ids up to their end)."""
    width, press = int(ids.max()).bit_length() if len(ids) else 0, zstandard.ZstdCompressor(1)
    docs = np.array([0 if d is None else d for d in doc_ids], np.int64).tobytes() + np.array([d is None for d in doc_ids], np.uint8).tobytes() + ends.astype(np.uint64).tobytes()
    sections, now = [press.compress(docs)], ids
    for place in range(width - 1, -1, -1):
        bit = (now >> now.dtype.type(place) & now.dtype.type(1)).astype(bool)
        sections.append(_plane(bit, press))
        now = np.concatenate([now[~bit], now[bit]])
    body = MAGIC + struct.pack("<QQQ", len(ids), len(doc_ids), width) + _pack(sections)
    return body + struct.pack("<I", zlib.crc32(body))


class Plane:
    def __init__(self, data: memoryview, n: int):
        self.n, self.data = n, data
        self.zeros, blocks = struct.unpack_from("<QQ", data)
        self.ones = np.frombuffer(data, np.uint64, blocks + 1, 16).astype(np.int64)
        self.at = np.frombuffer(data, np.uint64, blocks + 1, 24 + 8 * blocks).astype(np.int64)
        self.first = 32 + 16 * blocks
        self.kept: OrderedDict[int, np.ndarray] = OrderedDict()

    def block(self, i: int) -> np.ndarray:
        """The bytes of a block; those read last are kept."""
        if i in self.kept:
            self.kept.move_to_end(i)
            return self.kept[i]
        raw = self.data[self.first + int(self.at[i]) : self.first + int(self.at[i + 1])]
        plain = bytes(raw[1:]) if raw[0] == 0 else zstandard.ZstdDecompressor().decompress(raw[1:], max_output_size=BLOCK)
        made = self.kept[i] = np.frombuffer(plain, np.uint8)
        if len(self.kept) > KEPT:
            self.kept.popitem(last=False)
        return made

    def bits(self) -> np.ndarray:
        if not self.n:
            return np.zeros(0, bool)
        press = zstandard.ZstdDecompressor()
        raws = (self.data[self.first + int(a) : self.first + int(b)] for a, b in zip(self.at[:-1], self.at[1:], strict=True))
        plain = b"".join(bytes(r[1:]) if r[0] == 0 else press.decompress(r[1:], max_output_size=BLOCK) for r in raws)
        return np.unpackbits(np.frombuffer(plain, np.uint8), count=self.n, bitorder="little").view(bool)

    def bit(self, i: int) -> int:
        block, rest = divmod(i, 8 * BLOCK)
        return int(self.block(block)[rest >> 3] >> (rest & 7) & 1)

    def rank(self, i: int) -> int:
        """Ones before place ``i``."""
        block, rest = divmod(i, 8 * BLOCK)
        if not rest:
            return int(self.ones[block])
        own = self.block(block)
        found = int(self.ones[block]) + int(np.bitwise_count(own[: rest >> 3]).sum())
        return found + (int(own[rest >> 3]) & (1 << (rest & 7)) - 1).bit_count() if rest & 7 else found

    def select(self, k: int, one: int) -> int:
        """The place of the ``k``-th (from 0) bit that equals ``one``."""
        before = self.ones if one else np.minimum(np.arange(len(self.ones)) * 8 * BLOCK, self.n) - self.ones
        block = int(np.searchsorted(before, k, "right")) - 1
        own = np.unpackbits(self.block(block), count=min(8 * BLOCK, self.n - block * 8 * BLOCK), bitorder="little")
        return block * 8 * BLOCK + int(np.flatnonzero(own == one)[k - int(before[block])])


class Shard:
    """An opened file."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC or len(data) < 36 or zlib.crc32(memoryview(data)[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("not a whole file of token ids")
        self.n, docs, width = struct.unpack_from("<QQQ", data, 8)
        view, at, sections = memoryview(data), 32, []
        for _ in range(width + 1):
            (size,) = struct.unpack_from("<Q", data, at)
            sections.append(view[at + 8 : at + 8 + size])
            at += 8 + size
        told = zstandard.ZstdDecompressor().decompress(sections[0], max_output_size=17 * docs + 1)
        null = np.frombuffer(told, np.uint8, docs, 8 * docs)
        self.doc_ids = [None if x else d for d, x in zip(np.frombuffer(told, np.int64, docs).tolist(), null.tolist(), strict=True)]
        self.ends = np.frombuffer(told, np.uint64, docs, 9 * docs).astype(np.int64)
        self.planes = [Plane(s, self.n) for s in sections[1:]]

    def ids(self) -> np.ndarray:
        """All ids in order: the planes undone from the last to the first."""
        now = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for place, plane in enumerate(reversed(self.planes)):
            bit, before = plane.bits(), np.empty_like(now)
            before[~bit], before[bit] = now[: plane.zeros], now[plane.zeros :] | now.dtype.type(1 << place)
            now = before
        return now

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for plane in self.planes:
            bit, ones = plane.bit(i), plane.rank(i)
            value = value << 1 | bit
            i = plane.zeros + ones if bit else i - ones
        return value

    def _walk(self, token: int, end: int) -> tuple[int, int]:
        """The range of the last plane's order in which ``token`` of the first ``end`` places stands."""
        a, b = 0, end if token >= 0 and not token >> len(self.planes) else 0
        for place, plane in zip(range(len(self.planes) - 1, -1, -1), self.planes):
            if a == b:
                break
            one, two = plane.rank(a), plane.rank(b)
            a, b = (plane.zeros + one, plane.zeros + two) if token >> place & 1 else (a - one, b - two)
        return a, b

    def rank(self, token: int, end: int | None = None) -> int:
        """Occurrences of ``token`` before place ``end`` (all, if none)."""
        a, b = self._walk(token, self.n if end is None else max(0, min(end, self.n)))
        return b - a

    def select(self, token: int, k: int) -> int:
        """The place of the ``k``-th (from 0) occurrence of ``token``; -1 if there are fewer."""
        a, b = self._walk(token, self.n)
        if not 0 <= k < b - a:
            return -1
        i = a + k
        for place, plane in enumerate(reversed(self.planes)):
            i = plane.select(i - plane.zeros, 1) if token >> place & 1 else plane.select(i, 0)
        return i

    def document(self, i: int) -> int:
        """The number of the document in which place ``i`` lies."""
        return int(np.searchsorted(self.ends, i, "right"))
