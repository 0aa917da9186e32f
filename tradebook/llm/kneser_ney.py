"""Interpolated modified Kneser-Ney language model: counted by Spark, kept as sorted hash arrays, mapped by workers.

A text is its words and one end token, with begin tokens before them. A first job counts the words and writes a
vocabulary: by hash of the word one file per bucket, with a number for each word that is the smaller the more
frequent the word is. Tasks then count the n-grams of a few megabytes of text as such numbers and send them, sorted and
compressed, to buckets by the hash of their context. A bucket writes one file: sorted hashes of its n-grams with their
counts (those seen once are hashes only) and of its contexts with their sums. Each distinct n-gram
then counts once for its shorter n-gram without the first word (the continuation count), and so
on down to single words. Files go below the shared folder, under a passing name until they are whole,
so a repeated task only replaces a file by the same one. To score, workers map the files and
look up the hashes of their texts; nothing is loaded, broadcast or sent through the driver but a few sums.

Of a sorted 64-bit hash a file keeps where its first bits begin and the next 32 bits. With the bucket, a million hashes
are told apart by more than 56 bits.

The shared folder must be one that workers can open as files (a path or a ``file:`` URI, such as a mounted
store), since they map them; any other scheme is refused.

Hot contexts: what a bucket gets from one task is at most one entry per distinct follower. A context all of whose words
are more frequent than ``hot_words`` is dealt, by follower, to as many buckets next to each other as the
rarest of its words calls for; each has sums of its own, which scoring adds.

Defined results: a null text counts as empty, which is one end token; a null doc_id counts
as training; repeated rows are counted and scored each; without any training text every token has
probability one; an empty table gives an empty one.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradebook.llm.words import Words, chunks, groups, mixed
from tradebook.sources.files import scratch_path

ORDER = 3
#: Words that a bucket gets on average, beyond the number of shuffle partitions.
BUCKET_WORDS = 1_000_000
#: Occurrences of a word from which on its followers are dealt to several buckets.
HOT_WORDS = 1_000_000
#: Bytes of text that a task counts, and scores, at a time.
COUNTED_BYTES = 4 << 20
SCORED_BYTES = 3 << 20
#: Distinct words that a task gathers before it sends their counts.
GATHERED = 2_000_000
#: Files that a worker holds open at a time.
MAPPED = 600
_END = xxhash.xxh64_intdigest(b"end of text", 7)
#: Number of the token before a text; words are numbered from 1 on, unknown words have this bit.
_BEGIN = 0
_UNKNOWN = np.uint64(1 << 63)
#: Odd multiplier of hashes.
_ODD = 0x9E3779B97F4A7C15


def local_folder(uri: str) -> str:
    """The path of a folder that workers open as files."""
    found = urlparse(uri)
    if found.scheme not in ("", "file"):
        raise ValueError(f"workers map the model's files, so its folder must be a mounted path: {uri}")
    return found.path


@dataclass(frozen=True)
class Model:
    """Where a model's files are, and the sums that its probabilities need."""

    folder: str
    order: int
    buckets: int
    tokens: int
    vocabulary: int
    texts: int
    hot_words: int = HOT_WORDS
    discounts: tuple[tuple[float, float, float], ...] = ()
    #: Sums of the continuation counts of single words, and how many have 1, 2, 3 or more.
    unigrams: tuple[int, int, int, int] = (0, 0, 0, 0)


def _tokens(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct tokens, the place of each token among them, and where each text starts."""
    words = Words(texts, lower=True)
    starts = np.concatenate(([0], np.cumsum(np.diff(words.starts) + 1)))
    distinct = np.fromiter((xxhash.xxh64_intdigest(w) for w in words.distinct), np.uint64, len(words.distinct))
    codes = np.empty(starts[-1], np.int64)
    last = np.zeros(len(codes), bool)
    last[starts[1:] - 1] = True
    codes[last] = len(distinct)
    codes[~last] = words.codes
    return np.append(distinct, np.uint64(_END)), codes, starts


def _grams(tokens: np.ndarray, starts: np.ndarray, order: int, begin: int) -> np.ndarray:
    """The token before each token, ..., and itself, as ``order`` columns; ``begin`` before a text."""
    place = np.arange(len(tokens)) - np.repeat(starts[:-1], np.diff(starts))
    columns = np.empty((order, len(tokens)), tokens.dtype)
    for row, back in enumerate(range(order - 1, -1, -1)):
        columns[row, back:] = tokens[: len(tokens) - back]
        columns[row, place < back] = begin
    return columns


def _spread(ids: np.ndarray) -> np.ndarray:
    """A hash of each number."""
    return mixed(ids + np.uint64(_ODD))


def _key(spread: np.ndarray) -> np.ndarray:
    """One hash for each column of hashes."""
    total = spread[0]
    for row in spread[1:]:
        total = total * np.uint64(_ODD) + row
    return mixed(total)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in ascending order, one place of each, and which of them each value is."""
    by = np.argsort(values)
    begin = groups(values[by]) if len(by) else by
    back = np.empty(len(values), np.int64)
    back[by] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(by))))
    return values[by[begin]], by[begin], back


def _planes(values: np.ndarray) -> bytes:
    """Numbers below 2**40 byte by byte, so that the high bytes, nearly all zero, compress to nothing."""
    if len(values) and int(values.max()) >> 40:
        raise OverflowError("counts and word numbers must be below 2**40")
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].T.tobytes()


def _numbers(planes: np.ndarray) -> np.ndarray:
    flat = planes.reshape(5, -1)
    out = np.zeros((flat.shape[1], 8), np.uint8)
    out[:, :5] = flat.T
    return out.view("<u8").ravel()


def _by_bucket(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that occurs, with the places of its rows in ascending order."""
    by = np.argsort(bucket.astype(np.uint16 if buckets <= 1 << 16 else np.int64), kind="stable")
    bounds = np.searchsorted(bucket[by], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(bounds)).tolist():
        yield b, by[bounds[b] : bounds[b + 1]]


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in ascending order, one place of each, and the sums of ``values``."""
    by = np.argsort(keys)
    begin = groups(keys[by])
    return keys[by[begin]], by[begin], np.add.reduceat(values[by], begin)


# Files ----------------------------------------------------------------------------------------------


def _file(folder: str, kind: str, bucket: int) -> str:
    return f"{folder}/{kind}/{bucket % 256}/{bucket}"


def _narrow(values: np.ndarray) -> np.ndarray:
    """The numbers in as few bytes as the largest needs."""
    return values.astype(np.min_scalar_type(int(values.max()) if len(values) else 0))


def _save(path: str, arrays: list[np.ndarray]) -> None:
    """Lengths and widths, then the arrays, each from a multiple of eight on; the file gets its name when it is whole."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    passing = f"{path}.{uuid.uuid4().hex}"
    with open(passing, "wb") as file:
        file.write(np.array([len(arrays), *(x for a in arrays for x in (len(a), a.itemsize))], "<u8").tobytes())
        for a in arrays:
            file.write(np.ascontiguousarray(a).tobytes())
            file.write(bytes(-a.nbytes % 8))
    os.replace(passing, path)


def _load(path: str) -> list[np.ndarray]:
    """The arrays of a file, mapped; none if there is no such file."""
    if not os.path.exists(path):
        return []
    whole = np.asarray(np.memmap(path, np.uint8, mode="r"))
    n = int(whole[:8].view("<u8")[0])
    sizes = whole[8 : 8 + 16 * n].view("<u8").reshape(n, 2).tolist()
    arrays, at = [], 8 + 16 * n
    for length, width in sizes:
        arrays.append(whole[at : at + length * width].view(f"<u{width}"))
        at += length * width + -length * width % 8
    return arrays


def _table(keys: np.ndarray) -> list[np.ndarray]:
    """Ascending hashes as two arrays: where each value of the first bits begins, and the 32 bits after those."""
    bits = max(0, (len(keys) // 4).bit_length() - 1)
    starts = np.append(np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else [0], len(keys))
    return [_narrow(starts.astype(np.uint64)), ((keys << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)]


def _at(table: list[np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are in a table, and where: all places halved together."""
    starts, low = table
    if not len(low):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    bits = (len(starts) - 1).bit_length() - 1
    first = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    left, end = starts[first].astype(np.int64), starts[first + 1].astype(np.int64)
    want = ((keys << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
    right = end
    for _ in range(int((end - left).max()).bit_length() if len(keys) else 0):
        middle = (left + right) >> 1
        less = (low[np.minimum(middle, len(low) - 1)] < want) & (left < right)
        left, right = np.where(less, middle + 1, left), np.where(less, right, middle)
    left = np.minimum(left, len(low) - 1)
    return (low[left] == want) & (left < end), left


class Lookup:
    """A model's files as mapped arrays."""

    def __init__(self, model: Model):
        self.model = model
        self._open: dict[tuple[str, int], list[np.ndarray]] = {}

    def _arrays(self, kind: str, bucket: int) -> list[np.ndarray]:
        if (kind, bucket) not in self._open:
            if len(self._open) >= MAPPED:
                self._open.clear()
            self._open[kind, bucket] = _load(_file(self.model.folder, kind, bucket))
        return self._open[kind, bucket]

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and plain counts of words by their hash; unknown words have none."""
        ids, raw = hashes | _UNKNOWN, np.zeros(len(hashes), np.int64)
        buckets = self.model.buckets
        for b, take in _by_bucket((hashes % np.uint64(buckets)).astype(np.int64), buckets):
            if arrays := self._arrays("words", b):
                words, rank, counts = arrays
                place = np.minimum(np.searchsorted(words, hashes[take]), len(words) - 1)
                known = words[place] == hashes[take]
                rank = rank[place[known]].astype(np.uint64)
                ids[take[known]] = np.uint64(1) + rank * np.uint64(buckets) + np.uint64(b)
                raw[take[known]] = counts[rank]
        return ids, raw

    def _by_number(self, kind: str, ids: np.ndarray, which: int) -> np.ndarray:
        """Entries of arrays that words' ranks index; 0 for unknown words."""
        out, buckets = np.zeros(len(ids), np.int64), np.uint64(self.model.buckets)
        words = np.flatnonzero((ids != _BEGIN) & (ids < _UNKNOWN))
        at = ids[words] - np.uint64(1)
        for b, take in _by_bucket((at % buckets).astype(np.int64), self.model.buckets):
            if arrays := self._arrays(kind, b):
                out[words[take]] = arrays[which][at[take] // buckets]
        return out

    def dealt(self, ids: np.ndarray, raw: np.ndarray | None = None) -> np.ndarray:
        """How many buckets the followers of each word are dealt to."""
        raw = self._by_number("words", ids, 2) if raw is None else raw
        raw = np.where(ids == _BEGIN, self.model.texts, raw)
        return np.clip(-(-raw // self.model.hot_words), 1, self.model.buckets)

    def pieces(self, columns: np.ndarray) -> np.ndarray:
        """How many buckets the followers of each context are dealt to."""
        out = np.full(columns.shape[1], self.model.buckets)
        for row in columns:
            ids, _, back = _distinct(row)
            out = np.minimum(out, self.dealt(ids)[back])
        return out

    def links(self, ids: np.ndarray) -> np.ndarray:
        """Continuation counts of single words."""
        return self._by_number("1", ids, 0)

    def _many(self, arrays: list[np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which keys are in a table, which of these have entries of their own (others are seen once), and their places."""
        known, place = _at(arrays[:2], keys)
        known = np.flatnonzero(known)
        place, several = place[known], arrays[2]
        if not len(several):
            return known, known[:0], known[:0]
        at = np.minimum(np.searchsorted(several, place.astype(several.dtype)), len(several) - 1)
        many = several[at] == place
        return known, known[many], at[many]

    def longer(self, spread: np.ndarray, pieces: np.ndarray, discounts: tuple[float, float, float]) -> tuple[np.ndarray, ...]:
        """Of n-grams of two or more words: counts, sums of their contexts, what is taken off in these; 0 if unknown.

        ``spread`` has the hashes of the words, ``pieces`` how many buckets the followers of each context are dealt to.
        """
        kind, buckets = str(len(spread)), self.model.buckets
        context, keys = _key(spread[:-1]), _key(spread)
        counts = np.zeros(len(context), np.int64)
        for b, take in _by_bucket(_dealt(context, spread[-1] % pieces.astype(np.uint64), buckets), buckets):
            if arrays := self._arrays(kind, b):
                known, many, at = self._many(arrays[:3], keys[take])
                counts[take[known]] = 1
                counts[take[many]] = arrays[3][at]
        heads, first, back = _distinct(context)
        pieces = pieces[first]
        begin = np.cumsum(pieces) - pieces
        several = np.repeat(heads, pieces)
        which = (np.arange(len(several)) - np.repeat(begin, pieces)).astype(np.uint64)
        total, off = np.zeros(len(several)), np.zeros(len(several))
        for b, take in _by_bucket(_dealt(several, which, buckets), buckets):
            if arrays := self._arrays(kind, b):
                known, many, at = self._many(arrays[4:7], several[take])
                total[take[known]], off[take[known]] = 1, discounts[0]
                total[take[many]] = arrays[7][at]
                off[take[many]] = sum(d * arrays[8 + i][at] for i, d in enumerate(discounts))
        return counts, np.add.reduceat(total, begin)[back], np.add.reduceat(off, begin)[back]


def _dealt(context: np.ndarray, piece: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a context's piece; pieces of one context lie next to each other."""
    return ((context % np.uint64(buckets) + piece) % np.uint64(buckets)).astype(np.int64)


# Counting -------------------------------------------------------------------------------------------

_SENT = pa.schema([("bucket", pa.int32()), ("data", pa.binary())])
_SENT_SQL = "bucket int, data binary"
_CODEC = "zstd"


def _pack(arrays: Iterable[np.ndarray]) -> bytes:
    """Arrays of one length, compressed, after their length."""
    arrays = list(arrays)
    flat = b"".join(_planes(a) for a in arrays)
    return np.array([len(arrays), len(arrays[0])], "<u8").tobytes() + pa.compress(flat, codec=_CODEC, asbytes=True)


def _unpack(data: pa.Buffer) -> np.ndarray:
    width, n = np.frombuffer(data, "<u8", count=2).tolist()
    flat = np.frombuffer(pa.decompress(data.slice(16), 5 * width * n, codec=_CODEC), np.uint8).reshape(width, -1)
    return np.stack([_numbers(a) for a in flat])


def _batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([b for b, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())], schema=_SENT)


def _words(buckets: int):
    """Distinct words of a task with their counts, as hashes in two halves, by bucket."""

    def sent(hashes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        low = np.uint64(0xFFFFFFFF)
        return _batch(
            [(b, _pack((hashes[take] >> np.uint64(32), hashes[take] & low, counts[take].astype(np.uint64))))
             for b, take in _by_bucket((hashes % np.uint64(buckets)).astype(np.int64), buckets)]
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        for chunk in chunks(batches, size=COUNTED_BYTES):
            distinct, codes, _ = _tokens(chunk.column("text"))
            hashes = np.concatenate((hashes, distinct))
            hashes, _, counts = _summed(hashes, np.concatenate((counts, np.bincount(codes, minlength=len(distinct)))))
            if len(hashes) > GATHERED:
                yield sent(hashes, counts)
                hashes, counts = hashes[:0], counts[:0]
        if len(hashes):
            yield sent(hashes, counts)

    return run


def _numbered(folder: str):
    """Writes the vocabulary of one bucket: its hashes, the rank of each by falling count, and counts by rank."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        high, low, counts = np.concatenate([_unpack(x.as_buffer()) for x in table.column("data")], axis=1)
        hashes, _, counts = _summed((high << np.uint64(32)) | low, counts.astype(np.int64))
        by = np.lexsort((hashes, -counts))
        rank = np.empty(len(by), np.uint64)
        rank[by] = np.arange(len(by), dtype=np.uint64)
        _save(_file(folder, "words", bucket), [hashes, _narrow(rank), _narrow(counts[by])])
        ends = int(counts[hashes == np.uint64(_END)].sum())
        return pa.table({"tokens": [int(counts.sum())], "types": [len(counts)], "texts": [ends]})

    return run


def _sent(ids: np.ndarray | None, codes: np.ndarray, counts: np.ndarray, lookup: Lookup) -> Iterator[pa.RecordBatch]:
    """n-grams with the sums of their counts, sorted and packed by bucket.

    A column of ``codes`` is an n-gram, by places in the ascending numbers ``ids``, or by number.
    """
    if not codes.shape[1]:
        return
    bits = max(1, int(codes.max()).bit_length())
    if bits * len(codes) < 64:  # all words of an n-gram in one number
        packed = codes[0].astype(np.uint64)
        for row in codes[1:]:
            packed = (packed << np.uint64(bits)) | row.astype(np.uint64)
        by = np.argsort(packed)
        begin = groups(packed[by])
    else:
        by = np.lexsort(codes[::-1])
        begin = np.flatnonzero(np.concatenate(([True], (codes[:, by[1:]] != codes[:, by[:-1]]).any(axis=0))))
    codes, counts = codes[:, by[begin]], np.add.reduceat(counts[by], begin).astype(np.uint64)
    columns, buckets = codes if ids is None else ids[codes], lookup.model.buckets
    if len(columns) == 1:  # single words by number
        homes = ((columns[0] - np.uint64(1)) % np.uint64(buckets)).astype(np.int64)
    else:
        pieces = lookup.pieces(columns[:-1]) if ids is None else lookup.dealt(ids)[codes[:-1]].min(axis=0)
        spread = _spread(columns)
        homes = _dealt(_key(spread[:-1]), spread[-1] % pieces.astype(np.uint64), buckets)
    rows = []
    for b, take in _by_bucket(homes, buckets):
        mine = columns[:, take]
        rows.append((b, _pack((np.diff(mine[0], prepend=np.uint64(0)), *mine[1:], counts[take]))))
    yield _batch(rows)


def _counted(model: Model):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(model)
        for chunk in chunks(batches, size=COUNTED_BYTES):
            distinct, codes, starts = _tokens(chunk.column("text"))
            ids, _, rank = _distinct(np.append(np.uint64(_BEGIN), lookup.numbers(distinct)[0]))
            columns = _grams(rank[1:][codes], starts, model.order, 0)
            yield from _sent(ids, columns, np.ones(columns.shape[1], np.int64), lookup)

    return run


_SUMS = ("n1", "n2", "n3", "n4", "total", "three")


def _kept(model: Model, order: int):
    """Sums up the n-grams of one bucket, writes its file, and sends the shorter n-grams on.

    Rows that carry sums of a bucket (bucket below zero) pass through.
    """

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        if bucket < 0:
            return table
        parts = []
        for x in table.column("data"):
            part = _unpack(x.as_buffer())
            part[0] = np.cumsum(part[0])
            parts.append(part)
        found = np.concatenate(parts, axis=1)
        spread = _spread(found[:-1])
        key, one, links = _summed(_key(spread), found[-1].astype(np.int64))
        columns = found[:-1, one]
        if order > 1:
            context = _key(spread[:-1, one])
            by = np.argsort(context)
            begin = groups(context[by])
            sums = [np.add.reduceat(x[by].astype(np.int64), begin) for x in (links, links == 1, links == 2, links >= 3)]
            several, many = np.flatnonzero(links > 1), np.flatnonzero(sums[0] > 1)
            arrays = [*_table(key), several.astype(np.min_scalar_type(len(key))), _narrow(links[several])]
            arrays += [*_table(context[by[begin]]), many.astype(np.min_scalar_type(len(begin))), *(_narrow(s[many]) for s in sums)]
        else:
            ranks = (columns[0] - np.uint64(1)) // np.uint64(model.buckets)
            arrays = [_narrow(links[np.argsort(ranks)])]  # each word of the vocabulary ends some n-gram
        _save(_file(model.folder, str(order), bucket), arrays)
        counts = [order, *(int((links == k).sum()) for k in (1, 2, 3, 4)), int(links.sum()), int((links >= 3).sum())]
        out = [_batch([(-1 - bucket, np.array(counts, "<i8").tobytes())])]
        if order > 1:
            out += _sent(None, columns[1:], np.ones(columns.shape[1], np.int64), Lookup(model))
        return pa.Table.from_batches(out)

    return run


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """What is taken off counts of 1, 2, and 3 or more; fixed shares where the counts of counts give none."""
    if min(n1, n2, n3, n4) > 0:
        y = n1 / (n1 + 2 * n2)
        found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        if all(0 < d < k for k, d in enumerate(found, 1)):
            return found
    return (0.5, 1.0, 1.5)


def train(docs: DataFrame, order: int = ORDER, folder: str | None = None, hot_words: int = HOT_WORDS) -> Model:
    """Count the texts of ``docs`` (text; others ignored) and write the model's files below ``folder``.

    Followers of words with more than ``hot_words`` occurrences are dealt to several buckets.
    """
    if order < 1:
        raise ValueError("the order is at least 1")
    spark = docs.sparkSession
    folder = local_folder(folder or scratch_path(spark, "kneser-ney"))
    texts = docs.select(F.col("text").cast("string"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // 6 // BUCKET_WORDS)
    words = texts.mapInArrow(_words(buckets), _SENT_SQL).groupBy("bucket").applyInArrow(_numbered(folder), "tokens long, types long, texts long")
    tokens, types, ends = (x or 0 for x in words.agg(F.sum("tokens"), F.sum("types"), F.sum("texts")).first())
    model = Model(folder, order, buckets, tokens, types, ends, hot_words)
    rows = texts.mapInArrow(_counted(model), _SENT_SQL)
    for k in range(order, 0, -1):
        rows = rows.groupBy("bucket").applyInArrow(_kept(model, k), _SENT_SQL)

    def numbers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [np.frombuffer(x, "<i8").tolist() for x in batch.column("data").to_pylist()]
            columns = [pa.array([v[i] for v in values], pa.int64()) for i in range(1 + len(_SUMS))]
            yield pa.record_batch(columns, ["order", *_SUMS])

    stats = rows.mapInArrow(numbers, ", ".join(f"{c} long" for c in ("order", *_SUMS)))
    sums = {r["order"]: r for r in stats.groupBy("order").agg(*(F.sum(c).alias(c) for c in _SUMS)).collect()}
    none = dict.fromkeys(_SUMS, 0)
    found = [sums[k].asDict() if k in sums else none for k in range(1, order + 1)]
    first = found[0]
    discounts = tuple(_discounts(f["n1"], f["n2"], f["n3"], f["n4"]) for f in found)
    return replace(model, discounts=discounts, unigrams=(first["total"], first["n1"], first["n2"], first["three"]))


# Scoring --------------------------------------------------------------------------------------------


def _step(counts: np.ndarray, total: np.ndarray, off: np.ndarray, discounts: tuple[float, float, float], lower: np.ndarray) -> np.ndarray:
    """Probabilities of one order from those of the order below; ``off`` is what was taken off ``total``."""
    with np.errstate(divide="ignore", invalid="ignore"):
        found = (counts - np.array([0.0, *discounts])[np.minimum(counts, 3)] + off * lower) / total
    return np.where(total > 0, found, lower)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score and perplexity of every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(model)
        for chunk in chunks(batches, size=SCORED_BYTES):
            distinct, codes, starts = _tokens(chunk.column("text"))
            ids, raw = lookup.numbers(distinct)
            total, *kinds = model.unigrams
            off = sum(d * n for d, n in zip(model.discounts[0], kinds, strict=True))
            p = _step(lookup.links(ids), np.array(total), np.array(off), model.discounts[0], np.array(1 / (model.vocabulary + 1)))[codes]
            if model.order > 1:
                spread = _grams(_spread(ids)[codes], starts, model.order, _spread(np.array([_BEGIN], np.uint64))[0])
                pieces = _grams(lookup.dealt(ids, raw)[codes], starts, model.order, lookup.dealt(np.array([_BEGIN], np.uint64))[0])
            for k in range(2, model.order + 1):
                off = model.discounts[k - 1]
                p = _step(*lookup.longer(spread[-k:], pieces[-k:-1].min(axis=0), off), off, p)
            raw = raw[codes]
            base = np.log10((raw + 0.5) / (model.tokens + 0.5 * (model.vocabulary + 1)))
            logs, n = np.add.reduceat(np.log10(p), starts[:-1]), np.diff(starts)
            yield pa.record_batch(
                [
                    chunk.column("doc_id").combine_chunks(),
                    pa.array(n, pa.int64()),
                    pa.array(np.add.reduceat((raw > 0).astype(np.int64), starts[:-1])),
                    pa.array(np.add.reduceat(base, starts[:-1])),
                    pa.array(logs),
                    pa.array(10 ** (-logs / n)),
                ],
                ["doc_id", "n_tokens", "n_known", "base_score", "score", "perplexity"],
            )

    columns = "doc_id long, n_tokens long, n_known long, base_score double, score double, perplexity double"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, columns)
