"""A wavelet matrix of token ids: bit-planes with rank and select, compressed block by block.

File layout, little-endian: ``WVM1``, the header's length (u32), the header (JSON: ``n``, ``levels``,
``zeros`` per level, ``docs``), the document table (zstd: ids, whether an id is null, token counts), then
for each level a directory (u64 offset, u32 length, u64 ones before, per block) and its zstd blocks of
``BLOCK`` bits. Any token, count or occurrence is found from a few blocks; nothing else is read.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import zstandard

MAGIC = b"WVM1"
#: Bits of a block; a multiple of 8.
BLOCK = 1 << 18
_ENTRY = np.dtype([("offset", "<u8"), ("length", "<u4"), ("ones", "<u8")])


def _narrow(ids: np.ndarray, levels: int) -> np.ndarray:
    return ids.astype(np.uint16 if levels <= 16 else np.uint32)


def write(ids: np.ndarray, docs: np.ndarray, nulls: np.ndarray, counts: np.ndarray) -> bytes:
    """The file for the token ids of some documents: ``docs`` has their ids (0 where ``nulls``)."""
    levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    rest = _narrow(ids, levels)
    pack = zstandard.ZstdCompressor(level=1).compress
    planes, zeros = [], []
    for level in range(levels):
        bit = (rest >> (levels - 1 - level)) & 1 == 1
        packed = np.packbits(bit, bitorder="little")
        pieces, entries, ones = [], [], 0
        for at in range(0, len(packed), BLOCK // 8):
            piece = packed[at : at + BLOCK // 8]
            pieces.append(pack(piece.tobytes()))
            entries.append((0, len(pieces[-1]), ones))
            ones += int(np.bitwise_count(piece).sum())
        planes.append((np.array(entries, _ENTRY), pieces))
        zeros.append(len(rest) - ones)
        rest = np.concatenate([rest[~bit], rest[bit]])
    table = pack(docs.astype("<i8").tobytes() + nulls.astype(np.uint8).tobytes() + counts.astype("<i8").tobytes())
    header = json.dumps({"n": len(ids), "levels": levels, "zeros": zeros, "docs": len(docs), "table": len(table)}).encode()
    at = 8 + len(header) + len(table) + sum(e.nbytes for e, _ in planes)
    for entries, _ in planes:
        entries["offset"] = at + np.concatenate([[0], np.cumsum(entries["length"])[:-1]]) if len(entries) else 0
        at += int(entries["length"].sum())
    parts = [MAGIC, struct.pack("<I", len(header)), header, table]
    parts += [e.tobytes() for e, _ in planes]
    parts += [x for _, pieces in planes for x in pieces]
    return b"".join(parts)


class WaveletMatrix:
    """Reads a file's bytes (or a memory map of it); decompresses the blocks that a question touches."""

    def __init__(self, data):
        self.data = data
        if bytes(data[:4]) != MAGIC:
            raise ValueError("not a wavelet matrix")
        (size,) = struct.unpack("<I", data[4:8])
        head = json.loads(bytes(data[8 : 8 + size]))
        self.n, self.levels, self.zeros = head["n"], head["levels"], head["zeros"]
        unpack = zstandard.ZstdDecompressor().decompress
        table = unpack(bytes(data[8 + size : 8 + size + head["table"]]))
        d = head["docs"]
        self.docs = np.frombuffer(table, "<i8", d)
        self.nulls = np.frombuffer(table, np.uint8, d, 8 * d).astype(bool)
        self.counts = np.frombuffer(table, "<i8", d, 9 * d)
        at, blocks = 8 + size + head["table"], -(-self.n // BLOCK)
        self.directory = []
        for _ in range(self.levels):
            self.directory.append(np.frombuffer(data, _ENTRY, blocks, at))
            at += blocks * _ENTRY.itemsize
        self._unpack = unpack
        self._held: dict[tuple[int, int], np.ndarray] = {}

    def _block(self, level: int, k: int) -> np.ndarray:
        found = self._held.get((level, k))
        if found is None:
            e = self.directory[level][k]
            raw = self._unpack(bytes(self.data[int(e["offset"]) : int(e["offset"]) + int(e["length"])]))
            if len(self._held) > 256:
                self._held.clear()
            found = self._held[level, k] = np.frombuffer(raw, np.uint8)
        return found

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a level."""
        if i >= self.n:
            return self.n - self.zeros[level]
        k, r = divmod(i, BLOCK)
        block = self._block(level, k)
        whole, bits = divmod(r, 8)
        ones = int(self.directory[level][k]["ones"]) + int(np.bitwise_count(block[:whole]).sum())
        if bits:
            ones += int(block[whole] & ((1 << bits) - 1)).bit_count()
        return ones

    def _bit(self, level: int, i: int) -> int:
        k, r = divmod(i, BLOCK)
        return int(self._block(level, k)[r >> 3]) >> (r & 7) & 1

    def access(self, i: int) -> int:
        """The token at place ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.levels):
            ones, bit = self._ones(level, i), self._bit(level, i)
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        low, high = 0, i
        for level in range(self.levels):
            a, b = self._ones(level, low), self._ones(level, high)
            if token >> (self.levels - 1 - level) & 1:
                low, high = self.zeros[level] + a, self.zeros[level] + b
            else:
                low, high = low - a, high - b
        return low, high

    def rank(self, token: int, i: int) -> int:
        """How often ``token`` stands before place ``i``."""
        if token >> self.levels:
            return 0
        low, high = self._range(token, min(i, self.n))
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """Place of the ``k``-th (from 0) bit of that value in a level."""
        ones = self.directory[level]["ones"].astype(np.int64)
        before = ones if bit else np.arange(len(ones)) * BLOCK - ones
        b = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(self._block(level, b), bitorder="little")
        return b * BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[b])])

    def select(self, token: int, k: int) -> int:
        """Place of the ``k``-th (from 0) occurrence of ``token``."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        i = self._range(token, 0)[0] + k
        for level in reversed(range(self.levels)):
            if token >> (self.levels - 1 - level) & 1:
                i = self._select_bit(level, 1, i - self.zeros[level])
            else:
                i = self._select_bit(level, 0, i)
        return i

    def tokens(self) -> np.ndarray:
        """All token ids in order."""
        out = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for level in reversed(range(self.levels)):
            entries = self.directory[level]
            raw = [self._unpack(bytes(self.data[int(e["offset"]) : int(e["offset"]) + int(e["length"])])) for e in entries]
            bits = np.unpackbits(np.frombuffer(b"".join(raw), np.uint8), bitorder="little")[: self.n].astype(bool)
            zeros, above = self.zeros[level], np.empty_like(out)
            above[~bits] = out[:zeros]
            above[bits] = out[zeros:] | out.dtype.type(1 << (self.levels - 1 - level))
            out = above
        return out
