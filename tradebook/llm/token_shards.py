"""Token-ID output: documents as ids of a public tokenizer, one wavelet matrix per shard.

Documents are dealt out by ranges of their order, and each task writes its range as shards of about
``SHARD_TOKENS`` ids, cut between documents. A shard is one row, and one Parquet file, of Spark's own
writer, so that a lost task leaves nothing behind and any store that Spark writes to will do. The
number of ids before a shard comes from sums per task and within a task, not from one long scan.

The tokenizer splits a text before every space that a non-space follows, and inside such pieces between letters, digits,
punctuation and white space, so that parts between such places have ids of their own. A task finds the parts of its texts by the
kinds of their bytes, and encodes each distinct part once, as long as its worker remembers it. As the tokenizer would not
split a part any further, it goes right to the tokenizer's model. Pieces with an apostrophe, with
two white spaces in a row or with characters other than ASCII and Latin letters are parts as they are, which the tokenizer splits; texts in which
a space is followed by white space or ends the text, and texts with an added token of the tokenizer, such as <|endoftext|>, are encoded
whole. Ids are those of the library's default encoding.

Defined results: a null text counts as empty, which leaves only the end id; null ids come first; rows with the
same id follow each other in the order of a hash of their text; an empty table gives no shard.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradebook.llm.wavelet import Wavelets
from tradebook.llm.words import chunks

END_ID = 2
SHARD_TOKENS = 1 << 21
#: Bytes of text that a task encodes at a time, so that a word that is frequent in them is looked up once.
ENCODED_BYTES = 2 << 20
#: Distinct parts in each of the two generations that a worker remembers the ids of.
REMEMBERED = 200_000
_NOT_CUT = " (?:[\\s\\x{b}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|$)"
_LETTER, _DIGIT, _BLANK, _SIGN, _ROUGH = range(1, 6)


def _kinds() -> np.ndarray:
    """What a byte of UTF-8 belongs to. Two bytes that begin with C3 to C9 are Latin letters, but for two signs."""
    kinds = np.full(256, _ROUGH, np.uint8)
    kinds[:128] = _SIGN
    kinds[9:14] = _BLANK
    kinds[48:58] = _DIGIT
    kinds[65:91] = kinds[97:123] = kinds[0x80:0xC0] = kinds[0xC3:0xCA] = _LETTER
    kinds[ord("'")] = _ROUGH
    return kinds


_KINDS = _kinds()


class _Memory:
    """Ids of what was used of late: two generations, of which the older one goes when the newer one is full."""

    def __init__(self) -> None:
        self._new: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}

    def ids_of(self, wanted: list[bytes], encode: Callable[[list[bytes]], list[bytes]]) -> list[bytes]:
        """Ids of what is ``wanted``, all different."""
        found = list(map(self._new.get, wanted))
        absent = [i for i, x in enumerate(found) if x is None]
        unknown = []
        for i in absent:
            found[i] = self._old.get(wanted[i])
            if found[i] is None:
                unknown.append(i)
        for i, x in zip(unknown, encode([wanted[i] for i in unknown]) if unknown else [], strict=True):
            found[i] = x
        if len(self._new) + len(absent) > REMEMBERED:
            self._new, self._old = {}, self._new
        self._new.update((wanted[i], found[i]) for i in absent)
        return found


class Encoder:
    """Ids of many texts at once with a tokenizer of the ``tokenizers`` library.

    With a byte-level tokenizer that splits by its usual pattern, texts are cut into parts whose ids don't
    depend on their surroundings, and each distinct part is encoded once; others encode whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        self.bits = max(1, (self._tokenizer.get_vocab_size() - 1).bit_length())
        self.kind = np.dtype("<u2" if self.bits <= 16 else "<u4")
        usual = re.fullmatch(r"ByteLevel\(add_prefix_space=False,.*use_regex=True\)", str(self._tokenizer.pre_tokenizer))
        self._whole = not usual or self._tokenizer.normalizer is not None
        # The library looks for added tokens in the whole text before it splits it.
        added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values() if t.content]
        self._not_cut = "|".join([_NOT_CUT, *map(re.escape, added)])
        self._known = _Memory()
        # What stands for the bytes of parts in the tokenizer's model.
        every = "".join(map(chr, range(0x280)))
        ((shown, _),) = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(every)
        self._shown = np.zeros(256, "<u4")
        self._shown[np.frombuffer(every.encode(), np.uint8)] = np.frombuffer(shown.encode("utf-32-le"), "<u4")

    @staticmethod
    def of_worker(path: str) -> Encoder:
        """The encoder of this worker process, with what earlier tasks have learned."""
        import tokenizers

        # Code that is sent with a task goes with it; the library's module stays as long as the worker.
        kept = vars(tokenizers).setdefault("_encoder_of_worker", {})
        if path not in kept:
            kept.clear()
            kept[path] = Encoder(path)
        return kept[path]

    def _plain(self, texts: list[str]) -> list[bytes]:
        return self._packed([e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)])

    def _of_parts(self, parts: list[bytes], rough: set[bytes]) -> list[bytes]:
        """Ids of parts, of which the ``rough`` ones may have to be split further."""
        single = [x for x in parts if x not in rough]
        shown = self._shown[np.frombuffer(b"".join(single), np.uint8)].tobytes().decode("utf-32-le")
        tokenize = self._tokenizer.model.tokenize
        ids = self._packed([[t.id for t in tokenize(shown[a:b])] for a, b in pairwise([0, *accumulate(map(len, single))])])
        if len(single) == len(parts):
            return ids
        of = {False: iter(ids), True: iter(self._plain([x.decode() for x in parts if x in rough]))}
        return [next(of[x in rough]) for x in parts]

    def _packed(self, found: list[list[int]]) -> list[bytes]:
        data = np.fromiter(chain.from_iterable(found), self.kind).tobytes()
        ends = [0, *accumulate(len(x) * self.kind.itemsize for x in found)]
        return [data[a:b] for a, b in pairwise(ends)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many each text has."""
        texts = texts.fill_null("").cast(pa.large_string())
        texts.validate(full=True)  # parts are bytes, which would hide that a text is not UTF-8
        whole = pc.or_(pc.match_substring_regex(texts, self._not_cut), self._whole)
        parts, numbers, rough = _parts(pc.if_else(whole, "", texts))
        parts = parts.dictionary_encode()
        codes = parts.indices.to_numpy(zero_copy_only=False)
        distinct = _listed(parts.dictionary)
        rough = {distinct[i] for i in np.flatnonzero(np.bincount(codes[rough])).tolist()}
        ids, place, sizes = self._laid(self._known.ids_of(distinct, lambda unknown: self._of_parts(unknown, rough)))
        if pc.any(whole).as_py():
            # A whole text stands as one part where it has none.
            more, more_place, more_sizes = self._laid(self._plain(texts.filter(whole).to_pylist()))
            at = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
            codes = np.insert(codes.astype(np.int64), np.cumsum(numbers)[at], len(sizes) + np.arange(len(at)))
            numbers[at] += 1
            ids, place, sizes = np.concatenate((ids, more)), np.concatenate((place, more_place + len(ids))), np.concatenate((sizes, more_sizes))
        taken, lengths = _gathered(ids, place, sizes, codes)
        return taken, np.diff(np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(numbers)))])

    def _laid(self, ids: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids one after the other, with the place and the number of each."""
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.kind.itemsize
        return np.frombuffer(b"".join(ids), self.kind), np.cumsum(sizes) - sizes, sizes


def _listed(strings: pa.Array) -> list[bytes]:
    """The bytes of large strings, none of them null."""
    _, offsets, content = strings.buffers()
    bounds = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1].tolist() if len(strings) else []
    data = content.to_pybytes() if content is not None else b""
    return [data[a:b] for a, b in pairwise(bounds)]


def _parts(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The parts of all texts, in which every space is followed by something else, the number of each text's parts, and
    whether a part may have to be split further, which all parts with the same text agree in."""
    _, offsets, content = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(content, np.uint8)[offsets[0] : offsets[-1]] if content is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    if not len(data):
        return pa.array([], pa.large_string()), np.zeros(len(texts), np.int64), np.zeros(0, dtype=bool)
    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[offsets] = True
    begins = begins[:-1] | (data == 32)
    kinds = _KINDS[data]
    spaces = np.flatnonzero(data == 32)
    kinds[spaces] = kinds[spaces + 1]
    after = np.empty_like(begins)
    after[0], after[1:] = True, (kinds[1:] != kinds[:-1]) | (kinds[1:] == _BLANK)
    rough = kinds == _ROUGH
    # Two signs amid the Latin letters, and white space after white space.
    rough[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    rough[1:] |= (kinds[1:] == _BLANK) & (kinds[:-1] == _BLANK)
    pieces = np.flatnonzero(begins)
    rough = np.repeat(np.logical_or.reduceat(rough, pieces), np.diff(np.append(pieces, len(data))))
    cuts = np.flatnonzero(begins | (after & ~rough))
    bounds = np.append(cuts, len(data))
    parts = pa.Array.from_buffers(pa.large_string(), len(cuts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)])
    return parts, np.diff(np.searchsorted(cuts, offsets)), rough[cuts]


def _gathered(values: np.ndarray, place: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of values that ``codes`` name by their place and size, one after the other, and the length of each."""
    lengths = sizes[codes]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    # Steps of one inside a run, and from run to run the way to its first value.
    steps = np.repeat(place[codes] - (ends - lengths), lengths)
    steps += np.arange(total)
    return values[steps], lengths


def _shards(path: str, end_id: int, shard_tokens: int):
    """Rows of part, shard, n_docs, n_tokens and data, for the documents of one task in order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard = TaskContext.get().partitionId(), 0
        encoder = None
        ids: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        held = 0

        def row() -> pa.RecordBatch:
            data = Wavelets.of(np.concatenate(ids), encoder.bits, doc_ids, np.array(lengths, np.int64)).to_bytes()
            return pa.record_batch(
                [pa.array([x], t) for x, t in ((part, pa.int32()), (shard, pa.int32()), (len(doc_ids), pa.int64()), (sum(lengths), pa.int64()), (data, pa.binary()))],
                ["part", "shard", "n_docs", "n_tokens", "data"],
            )

        for chunk in chunks(batches, size=ENCODED_BYTES):
            if encoder is None:
                encoder = Encoder.of_worker(path)
            found, sizes = encoder.encode(chunk.column("text").combine_chunks())
            begin = 0
            for doc_id, n in zip(chunk.column("doc_id").to_pylist(), sizes.tolist(), strict=True):
                ids += (found[begin : begin + n], np.array([end_id], encoder.kind))
                doc_ids.append(doc_id)
                lengths.append(n + 1)
                begin += n
                held += n + 1
                if held >= shard_tokens:
                    yield row()
                    shard, held, ids, doc_ids, lengths = shard + 1, 0, [], [], []
        if doc_ids:
            yield row()

    return run


def write(
    docs: DataFrame, path: str, tokenizer: str, order: Sequence[str] = ("doc_id",), end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS
) -> None:
    """Write the ids of ``docs`` (doc_id, text and the columns of ``order``) as shards below ``path``.

    ``tokenizer`` is the path of a tokenizer's file that all executors have.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"key_{i}" for i in range(len(order))]
    given = docs.select(
        *(F.col(c).alias(k) for c, k in zip(order, keys, strict=True)), F.col("doc_id").cast("long"), F.col("text").cast("string")
    ).withColumn("tie", F.xxhash64("text"))
    dealt = given.repartitionByRange(parts, *keys, "tie").sortWithinPartitions(*keys, "tie")
    made = dealt.select("doc_id", "text").mapInArrow(
        _shards(tokenizer, end_id, shard_tokens), "part int, shard int, n_docs long, n_tokens long, data binary"
    )
    made.write.option("maxRecordsPerFile", 1).option("compression", "none").parquet(path)


def shards(spark: SparkSession, path: str) -> DataFrame:
    """part, shard, n_docs, n_tokens, start (ids before the shard) and data of every shard."""
    found = spark.read.schema("part int, shard int, n_docs long, n_tokens long, data binary").parquet(path)
    sizes = found.select("part", "shard", "n_tokens")
    earlier = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    inside = sizes.withColumn("inside", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0))).drop("n_tokens")
    # One row for each writing task.
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    outside = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("outside"))
    starts = inside.join(outside, "part").select("part", "shard", (F.col("inside") + F.col("outside")).alias("start"))
    # A small row for each file of some megabytes; their data stay where they are read.
    return found.join(F.broadcast(starts), ["part", "shard"])


def _documents(spark: SparkSession, path: str, name: str, kind: str, made: Callable[[bytes], object]) -> DataFrame:
    """doc_id, start and n_tokens of every document of the shards, and what ``made`` makes of its ids' bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch.column("start").to_pylist(), batch.column("data"), strict=True):
                shard = Wavelets.from_bytes(data.as_py())
                ids = shard.decode().astype("<u4")
                ends = np.cumsum(shard.lengths)
                begins = ends - shard.lengths
                values = [made(ids[b:e].tobytes()) for b, e in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.record_batch(
                    [pa.array(shard.doc_ids, pa.int64()), pa.array(begins + start), pa.array(shard.lengths), pa.array(values, kinds[kind])],
                    ["doc_id", "start", "n_tokens", name],
                )

    kinds = {"binary": pa.binary(), "long": pa.int64()}
    return shards(spark, path).select("start", "data").mapInArrow(run, f"doc_id long, start long, n_tokens long, {name} {kind}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the shards: doc_id, start, n_tokens and ids (little-endian unsigned 32-bit, as binary)."""
    return _documents(spark, path, "ids", "binary", bytes)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """As ``read``, with the CRC-32 of a document's ids in their place."""
    return _documents(spark, path, "ids_crc32", "long", zlib.crc32)
