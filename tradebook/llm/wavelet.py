"""A wavelet matrix over a sequence of ids: one compressed piece of bytes with access, rank and select.

The ids' bits are kept in planes, the highest first. Each plane holds one bit of every id, in an
order in which the ids with a 0 in the plane before come first. Counting ones up to a place (rank)
follows an id from plane to plane; finding the k-th one (select) leads back up.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

_MAGIC = b"WMX1"
_HEAD = "<4sBQQ"


class Wavelets:
    """Ids of several documents one after the other, as bit planes.

    ``doc_ids`` has an id or None for each document, ``lengths`` how many ids it has.
    """

    def __init__(self, bits: int, planes: list[np.ndarray], doc_ids: list[int | None], lengths: np.ndarray):
        self.bits, self.doc_ids, self.lengths = bits, doc_ids, lengths
        self.size = int(lengths.sum())
        self._planes = planes
        self._ranks: list[np.ndarray] | None = None

    @classmethod
    def of(cls, ids: np.ndarray, bits: int, doc_ids: list[int | None], lengths: np.ndarray) -> Wavelets:
        planes, left = [], ids
        for level in range(bits - 1, -1, -1):
            one = (left >> left.dtype.type(level)) & left.dtype.type(1) != 0
            planes.append(np.packbits(one, bitorder="little"))
            if level:
                left = np.concatenate((left.take(np.flatnonzero(~one)), left.take(np.flatnonzero(one))))
        return cls(bits, planes, doc_ids, np.asarray(lengths, np.int64))

    def to_bytes(self) -> bytes:
        pack = zstandard.ZstdCompressor(level=1).compress
        known = np.array([x is not None for x in self.doc_ids], np.uint8)
        parts = [
            np.array([x or 0 for x in self.doc_ids], "<i8").tobytes(),
            known.tobytes(),
            self.lengths.astype("<u8").tobytes(),
            *(p.tobytes() for p in self._planes),
        ]
        packed = [pack(p) for p in parts]
        sizes = np.array([len(p) for p in packed], "<u8").tobytes()
        return b"".join((struct.pack(_HEAD, _MAGIC, self.bits, self.size, len(self.doc_ids)), sizes, *packed))

    @classmethod
    def from_bytes(cls, data: bytes) -> Wavelets:
        magic, bits, size, docs = struct.unpack_from(_HEAD, data)
        if magic != _MAGIC:
            raise ValueError("these bytes are not a wavelet matrix")
        sizes = np.frombuffer(data, "<u8", bits + 3, struct.calcsize(_HEAD)).tolist()
        unpack, at, parts = zstandard.ZstdDecompressor().decompress, struct.calcsize(_HEAD) + 8 * (bits + 3), []
        for n in sizes:
            parts.append(unpack(data[at : at + n]))
            at += n
        known = np.frombuffer(parts[1], np.uint8).tolist()
        ids = [x if k else None for x, k in zip(np.frombuffer(parts[0], "<i8").tolist(), known, strict=True)]
        return cls(bits, [np.frombuffer(p, np.uint8) for p in parts[3:]], ids, np.frombuffer(parts[2], "<u8").astype(np.int64))

    def _one(self, level: int) -> np.ndarray:
        return np.unpackbits(self._planes[level], count=self.size, bitorder="little").view(bool)

    def decode(self) -> np.ndarray:
        """All ids, put together from the lowest plane up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        below = np.zeros(self.size, kind)
        for level in range(self.bits - 1, -1, -1):
            one = self._one(level)
            zeros = self.size - int(np.count_nonzero(one))
            now = np.empty(self.size, kind)
            now[~one] = below[:zeros]
            now[one] = below[zeros:] | kind(1 << (self.bits - 1 - level))
            below = now
        return below

    def _counts(self) -> list[np.ndarray]:
        """For each plane, the ones before each group of 64 places; made once, on the first lookup."""
        if self._ranks is None:
            self._ranks = []
            for plane in self._planes:
                words = np.zeros(-(-self.size // 64) + 1, "<u8")
                words.view(np.uint8)[: len(plane)] = plane
                self._ranks.append(np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64))))
        return self._ranks

    def _rank(self, level: int, place: int) -> int:
        """Ones in the plane before a place."""
        begin = place // 64
        rest = self._planes[level][8 * begin : 8 * begin + (place % 64 + 7) // 8]
        bits = int.from_bytes(rest.tobytes(), "little") & ((1 << (place % 64)) - 1)
        return int(self._counts()[level][begin]) + bits.bit_count()

    def _zeros(self, level: int) -> int:
        return self.size - int(self._counts()[level][-1])

    def access(self, place: int) -> int:
        """The id at a place."""
        if not 0 <= place < self.size:
            raise IndexError(place)
        value = 0
        for level in range(self.bits):
            bit = int(self._planes[level][place // 8]) >> (place % 8) & 1
            ones = self._rank(level, place)
            place = self._zeros(level) + ones if bit else place - ones
            value = 2 * value + bit
        return value

    def _down(self, value: int, begin: int, end: int) -> tuple[int, int]:
        """Where the occurrences of an id within [begin, end) are below the last plane."""
        for level in range(self.bits):
            low, high = self._rank(level, begin), self._rank(level, end)
            if value >> (self.bits - 1 - level) & 1:
                begin, end = self._zeros(level) + low, self._zeros(level) + high
            else:
                begin, end = begin - low, end - high
        return begin, end

    def rank(self, value: int, place: int) -> int:
        """Occurrences of an id before a place."""
        begin, end = self._down(value, 0, place) if 0 <= value < 1 << self.bits else (0, 0)
        return end - begin

    def count(self, value: int) -> int:
        return self.rank(value, self.size)

    def select(self, value: int, k: int) -> int:
        """The place of the k-th occurrence of an id, the first one being number 0."""
        found = self.occurrences(value, k, k + 1)
        if k < 0 or not len(found):
            raise IndexError(k)
        return int(found[0])

    def occurrences(self, value: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """Places of an id, in order; with ``first`` and ``last`` only those numbers of them."""
        begin, end = self._down(value, 0, self.size) if 0 <= value < 1 << self.bits else (0, 0)
        places = np.arange(begin, end)[first:last]
        for level in range(self.bits - 1, -1, -1):
            if not len(places):
                break
            one = np.flatnonzero(self._one(level) == bool(value >> (self.bits - 1 - level) & 1))
            places = one[places - (self._zeros(level) if value >> (self.bits - 1 - level) & 1 else 0)]
        return places
