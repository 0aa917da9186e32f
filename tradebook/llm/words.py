"""Words and word windows of whole batches of texts as numpy arrays.

Used inside tasks. A word is a run of bytes other than the space and the bytes 9 to 13.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Odd multiplier of the rolling hash; the arithmetic is modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
#: Bytes of text that a task works on at a time; a longer text is taken alone.
CHUNK_BYTES = 4 << 20


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.Table]:
    """The batches in pieces of about ``size`` bytes of text, whatever their own size."""
    waiting: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        begin = 0
        for i, n in enumerate(lengths.tolist()):
            held += n
            if held >= size:
                waiting.append(batch.slice(begin, i + 1 - begin))
                yield pa.Table.from_batches(waiting)
                waiting, held, begin = [], 0, i + 1
        if begin < len(lengths):
            waiting.append(batch.slice(begin))
    if waiting:
        yield pa.Table.from_batches(waiting)


class Words:
    """Words of a column of texts: ``codes`` into ``distinct``; text i has words ``starts[i]:starts[i + 1]``."""

    def __init__(self, texts: pa.ChunkedArray | pa.Array, lower: bool = False):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.fill_null("").cast(pa.large_binary())
        _, places, content = texts.buffers()
        offsets = np.frombuffer(places, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(content, dtype=np.uint8)[offsets[0] : offsets[-1]] if content is not None else np.empty(0, np.uint8)
        offsets = offsets - offsets[0]
        inner = ~_BLANK[data]
        first = inner.copy()
        first[1:] &= ~inner[:-1]
        heads = offsets[:-1][offsets[:-1] < len(data)]
        first[heads] = inner[heads]
        at = np.flatnonzero(first)
        kept = data[inner]
        if lower:
            kept = _LOWER[kept]
        bounds = np.append(np.cumsum(inner)[at] - 1, len(kept)).astype(np.int64)
        every = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(kept.tobytes())])
        coded = every.dictionary_encode()
        self.distinct: list[bytes] = coded.dictionary.to_pylist()
        self.codes = coded.indices.to_numpy(zero_copy_only=False)
        self.starts = np.searchsorted(at, offsets)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word, in order."""
        values = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.distinct), np.uint64, len(self.distinct))
        return values[self.codes] if len(values) else np.empty(0, np.uint64)

    def text_of_word(self) -> np.ndarray:
        """Index of the text that each word is in."""
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all their bits."""
    out = values ^ (values >> np.uint64(30))
    out = out * np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(27)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(31)
    return out


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` values from each place on; ``len(hashes) - width + 1`` of them."""
    if len(hashes) < width:
        return np.empty(0, np.uint64)
    total: np.ndarray | None = None
    done, block, size, left = 0, hashes, 1, width
    while left:
        if left & 1:
            if total is None:
                total = block
            else:
                n = len(hashes) - done - size + 1
                total = total[:n] * np.uint64(pow(_BASE, size, 1 << 64)) + block[done : done + n]
            done += size
        left >>= 1
        if left:
            block = block[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + block[size:]
            size *= 2
    return mixed(total[: len(hashes) - width + 1])


def whole(starts: np.ndarray, width: int) -> np.ndarray:
    """Whether the window of ``width`` words from each place on stays inside one text."""
    n = max(0, int(starts[-1]) - width + 1)
    ends = np.repeat(starts[1:], np.diff(starts))[:n]
    return np.arange(n) + width <= ends


def groups(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin in a sorted, non-empty array."""
    return np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
