"""A wavelet matrix over token ids: access, rank, select and counting on compressed bit planes.

File format (all integers little-endian): ``WVM2``, then u32 levels, u64 tokens, u32 documents, u32 length of the
compressed document table, that table (zstd; i64 ids, then u32 lengths), then for each plane, highest bit first, for
each block of ``BLOCK`` bits the u32 ones before it in the plane and the u32 end of its bytes in the data (and once
more at the plane's end all ones and the same end), then the data: each block's bits, low bit first, zstd on its own.

So one access, rank or select opens one or two blocks of ``BLOCK`` / 8 bytes of each plane, never the whole file.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

BLOCK = 1 << 16
MAGIC = b"WVM2"
_HEAD = "<IQII"
#: Blocks that an open file remembers, 8 KB each.
REMEMBERED = 256


class WaveletMatrix:
    def __init__(self, n: int, doc_ids: np.ndarray, lengths: np.ndarray, ones: np.ndarray, ends: np.ndarray, data: bytes):
        """``ones`` and ``ends`` have a row for each plane and a place for each block and for the end."""
        self.n, self.doc_ids, self.lengths, self.ones, self.ends, self.data = n, doc_ids, lengths, ones, ends, data
        self.levels = len(ones)
        self._zstd, self._open = zstandard.ZstdDecompressor(), {}

    @classmethod
    def build(cls, values: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray) -> WaveletMatrix:
        n, levels = len(values), max(1, int(values.max(initial=0)).bit_length())
        z, now = zstandard.ZstdCompressor(level=1), values.astype(np.uint16 if levels <= 16 else np.uint32)
        data, end, ones, ends = [], 0, [], []
        for level in range(levels - 1, -1, -1):
            bit = (now >> np.array(level, now.dtype)).astype(np.uint8) & 1
            cuts = np.arange(0, n, BLOCK)
            ones.append(np.concatenate([[0], np.cumsum(np.add.reduceat(bit, cuts, dtype=np.int64) if n else [])]))
            plane = np.packbits(bit, bitorder="little")
            row = []
            for a in range(0, len(plane), BLOCK // 8):
                data.append(z.compress(plane[a : a + BLOCK // 8].tobytes()))
                end += len(data[-1])
                row.append(end)
            ends.append([*row, end])
            one = bit.view(bool)
            now = np.concatenate([now[~one], now[one]])
        return cls(n, doc_ids.astype(np.int64), lengths.astype(np.uint32), np.array(ones, np.uint32), np.array(ends, np.uint32), b"".join(data))

    def to_bytes(self) -> bytes:
        table = zstandard.ZstdCompressor(level=1).compress(self.doc_ids.tobytes() + self.lengths.tobytes())
        head = struct.pack(_HEAD, self.levels, self.n, len(self.doc_ids), len(table))
        return b"".join([MAGIC, head, table, self.ones.astype("<u4").tobytes(), self.ends.astype("<u4").tobytes(), self.data])

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        levels, n, docs, size = struct.unpack_from(_HEAD, data, 4)
        at = 4 + struct.calcsize(_HEAD)
        table = zstandard.ZstdDecompressor().decompress(data[at : at + size], max_output_size=max(1, 12 * docs))
        at, places = at + size, levels * (-(-n // BLOCK) + 1)
        ones, ends = (np.frombuffer(data, "<u4", places, at + 4 * places * k).reshape(levels, -1) for k in (0, 1))
        return cls(n, np.frombuffer(table[: 8 * docs], np.int64), np.frombuffer(table[8 * docs :], np.uint32), ones, ends, data[at + 8 * places :])

    def _packed(self, k: int, b: int) -> bytes:
        start = int(self.ends[k, b - 1]) if b else int(self.ends[k - 1, -1]) if k else 0
        return self._zstd.decompress(self.data[start : int(self.ends[k, b])], max_output_size=BLOCK // 8)

    def _bits(self, k: int, b: int) -> np.ndarray:
        """The bits of block b of plane k."""
        if (k, b) not in self._open:
            if len(self._open) >= REMEMBERED:
                self._open.clear()
            self._open[k, b] = np.frombuffer(self._packed(k, b), np.uint8)
        return np.unpackbits(self._open[k, b], count=min(BLOCK, self.n - b * BLOCK), bitorder="little")

    def _ones(self, k: int, i: int) -> int:
        """Ones among the first i bits of plane k."""
        b = i // BLOCK
        before = int(self.ones[k, b])
        return before + int(self._bits(k, b)[: i - b * BLOCK].sum()) if i > b * BLOCK else before

    def _zeros(self, k: int) -> int:
        return self.n - int(self.ones[k, -1])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(self.levels):
            bit = int(self._bits(k, i // BLOCK)[i % BLOCK])
            ones = self._ones(k, i)
            i = self._zeros(k) + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, value: int, i: int) -> tuple[int, int]:
        """Where the value's run begins in the last order, and where its first i tokens' part of it ends."""
        if value < 0 or value >> self.levels:
            return 0, 0
        lo, hi = 0, i
        for k in range(self.levels):
            a, b = self._ones(k, lo), self._ones(k, hi)
            if value >> (self.levels - 1 - k) & 1:
                lo, hi = self._zeros(k) + a, self._zeros(k) + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def rank(self, value: int, i: int) -> int:
        """Occurrences of ``value`` among the first i tokens."""
        lo, hi = self._range(value, min(max(i, 0), self.n))
        return hi - lo

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, j: int) -> int:
        """Position of the j-th occurrence, from 0; -1 where there is none."""
        lo, hi = self._range(value, self.n)
        if not 0 <= j < hi - lo:
            return -1
        i = lo + j
        for k in range(self.levels - 1, -1, -1):
            one = bool(value >> (self.levels - 1 - k) & 1)
            i = self._nth(k, i - self._zeros(k) if one else i, one)
        return i

    def _nth(self, k: int, j: int, one: bool) -> int:
        """Place of the j-th one, or zero, of plane k."""
        ones = self.ones[k].astype(np.int64)
        before = ones if one else np.minimum(np.arange(len(ones)) * BLOCK, self.n) - ones
        b = int(np.searchsorted(before[:-1], j, side="right")) - 1
        return b * BLOCK + int(np.flatnonzero(self._bits(k, b) == int(one))[j - before[b]])

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, j) for j in range(self.count(value))]

    def tokens(self) -> np.ndarray:
        """All tokens in order, by undoing the planes from the lowest bit up."""
        out = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for k in range(self.levels - 1, -1, -1):
            plane = b"".join(self._packed(k, b) for b in range(self.ones.shape[1] - 1))
            one = np.unpackbits(np.frombuffer(plane, np.uint8), count=self.n, bitorder="little").view(bool)
            zeros = self.n - int(np.count_nonzero(one))
            up = np.empty_like(out)
            up[~one] = out[:zeros]
            up[one] = out[zeros:] | np.array(1 << (self.levels - 1 - k), out.dtype)
            out = up
        return out.astype(np.uint32)
