"""Substring dedup: repeated passages of 50 words are removed wherever a smaller document has them.

A shared passage of 50 words holds one of the blocks of 25 words that a document is cut into from its
start on. Those blocks are the index; every rolling window of 25 words probes it. Hashes meet
in buckets: a task packs the windows of several megabytes of text into one binary row per bucket,
so that an eight-byte hash isn't a row of its own. Windows whose hash is a block of another document
are anchors. All windows of 50 words around anchors, which make up the maximal candidate runs, then
meet by two 64-bit hashes, and a window is a repeat if the smallest document with it is another, smaller one.

Windows are never listed in pairs: what a bucket works out is one smallest id per hash. A task
settles by itself what its own texts prove, and sends one window for all its copies, so a passage in
a third of all documents arrives once per task and not once per document. Spans are given to the texts
by a broadcast only while their measured size allows it, else by a join on the id.

Defined results: a null text has no words; documents with fewer than 50 words lose none; rows with a
null doc_id neither lose words nor cause others to; rows that share an id are judged each by its own
words, and never against each other; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradebook.llm.columns import bounded, written
from tradebook.llm.words import Words, chunks, groups, mixed, rolling, whole

BLOCK = 25
WINDOW = 2 * BLOCK
#: Words that a bucket gets on average, beyond the number of shuffle partitions.
BUCKET_WORDS = 4_000_000
_HASH_BYTES = 6


def _packed(order: np.ndarray, buckets: np.ndarray, count: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places of ``order`` for each bucket that has some; ``order`` is kept within a bucket."""
    by = np.argsort(buckets, kind="stable")
    bounds = np.searchsorted(buckets[by], np.arange(count + 1))
    for b in np.flatnonzero(np.diff(bounds)):
        yield int(b), order[by[bounds[b] : bounds[b + 1]]]


def _own_bucket(ids: np.ndarray, count: int) -> int:
    """Below zero; differs between chunks, so that what they settle themselves stays spread out."""
    return -1 - int(ids[0]) % count


_PACKED = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("ids", "keys", "lengths", "places", "one", "two"))])
_PACKED_SQL = "bucket int, ids binary, keys binary, lengths binary, places binary, one binary, two binary"
_SPANS = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("spans", pa.binary())])


def _row(bucket: int, ids: np.ndarray, keys: np.ndarray, doc: np.ndarray, place: np.ndarray, one: bytes = b"", two: bytes = b"") -> dict:
    """Places in several documents as one row; ``doc``, in runs, says which of ``ids`` each is in."""
    begin = groups(doc) if len(doc) else np.empty(0, np.int64)
    place = place.astype("<u4")
    return {
        "bucket": bucket,
        "ids": ids[doc[begin]].astype("<i8").tobytes(),
        "keys": keys[doc[begin]].astype("<i8").tobytes(),
        "lengths": np.diff(np.append(begin, len(doc))).astype("<u4").tobytes() if len(doc) else b"",
        # Low and high halves apart: the high ones are nearly all zero and compress to nothing.
        "places": (place & 0xFFFF).astype("<u2").tobytes() + (place >> 16).astype("<u2").tobytes(),
        "one": one,
        "two": two,
    }


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids and keys of the documents of several rows, and for each place its document and the place."""
    rows = table.select(["ids", "keys", "lengths", "places"]).to_pylist()
    ids = np.concatenate([np.frombuffer(r["ids"], "<i8") for r in rows])
    keys = np.concatenate([np.frombuffer(r["keys"], "<i8") for r in rows])
    lengths = np.concatenate([np.frombuffer(r["lengths"], "<u4") for r in rows])
    halves = [np.frombuffer(r["places"], "<u2").reshape(2, -1) for r in rows]
    places = np.concatenate([h[0] | (h[1].astype(np.uint32) << np.uint32(16)) for h in halves])
    return ids, keys, np.repeat(np.arange(len(ids), dtype=np.int32), lengths), places


def _to_documents(ids: np.ndarray, keys: np.ndarray, doc: np.ndarray, place: np.ndarray, buckets: int) -> pa.Table:
    """Found places, one row for each bucket of documents."""
    home = (mixed(ids.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)[doc]
    rows = [_row(b, ids, keys, doc[take], place[take]) for b, take in _packed(np.arange(len(doc)), home, buckets)]
    return pa.Table.from_batches([pa.RecordBatch.from_pylist(rows, _PACKED)])


def _anchor_records(buckets: int):
    """Packs the 25-word windows of a chunk of texts by bucket of their hash.

    A row with a bucket below zero has anchors that the chunk has found by itself.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            words = Words(chunk.column("text"))
            ids, keys = chunk.column("doc_id").to_numpy(), chunk.column("key").to_numpy()
            at_word = np.flatnonzero(whole(words.starts, BLOCK))
            if not len(at_word):
                continue
            hashes = rolling(words.hashes(), BLOCK)[at_word]
            doc = words.text_of_word()[at_word]
            place = at_word - words.starts[doc]
            block = place % BLOCK == 0
            order = np.argsort(hashes, kind="stable")
            begin = groups(hashes[order])
            own = ids[doc][order]
            shared = (np.minimum.reduceat(own, begin) != np.maximum.reduceat(own, begin)) & np.logical_or.reduceat(block[order], begin)
            sizes = np.diff(np.append(begin, len(order)))
            proven = np.empty(len(order), bool)
            proven[order] = np.repeat(shared, sizes)
            # One block stands for all windows that the chunk has proven to be anchors.
            first_block = np.full(len(begin), -1)
            blocks = np.flatnonzero(block[order])
            group_of = np.repeat(np.arange(len(begin)), sizes)
            first_block[group_of[blocks[::-1]]] = order[blocks[::-1]]
            sent = ~proven
            sent[first_block[shared]] = True
            rows = [_row(_own_bucket(ids, buckets), ids, keys, doc[proven], place[proven])]
            for bucket, take in _packed(np.flatnonzero(sent), (hashes[sent] % np.uint64(buckets)).astype(np.int64), buckets):
                # The bucket says the rest of the hash.
                rest = (hashes[take] // np.uint64(buckets)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_HASH_BYTES]
                rows.append(_row(bucket, ids, keys, doc[take], place[take], rest.tobytes()))
            yield pa.RecordBatch.from_pylist(rows, _PACKED)

    return run


def _probe(buckets: int):
    """Anchors among the windows of one bucket: their hash is in several documents, and a block in one."""

    def run(table: pa.Table) -> pa.Table:
        ids, keys, doc, place = _unpacked(table)
        if table.column("bucket")[0].as_py() < 0:
            return _to_documents(ids, keys, doc, place, buckets)
        hashes = np.zeros((len(place), 8), np.uint8)
        hashes[:, :_HASH_BYTES] = np.frombuffer(b"".join(table.column("one").to_pylist()), np.uint8).reshape(-1, _HASH_BYTES)
        hashes = hashes.view("<u8").ravel()
        order = np.argsort(hashes, kind="stable")
        begin = groups(hashes[order])
        own = ids[doc][order]
        several = np.minimum.reduceat(own, begin) != np.maximum.reduceat(own, begin)
        shared = several & np.logical_or.reduceat(place[order] % BLOCK == 0, begin)
        found = np.sort(order[np.repeat(shared, np.diff(np.append(begin, len(order))))])
        return _to_documents(ids, keys, doc[found], place[found], buckets)

    return run


def _candidate_records(buckets: int):
    """50-word windows that start in the spans of a text, one for all copies that a chunk has.

    A row with a bucket below zero has places that the chunk itself proves to be repeats.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            words = Words(chunk.column("text"))
            inside = whole(words.starts, WINDOW)
            wanted = np.zeros(len(inside) + 1, np.int64)
            for i, spans in enumerate(chunk.column("spans").to_pylist()):
                ranges = np.frombuffer(spans, "<u4").reshape(-1, 2).astype(np.int64) + words.starts[i]
                ranges = np.minimum(np.minimum(ranges, words.starts[i + 1]), len(inside))
                np.add.at(wanted, ranges[:, 0], 1)
                np.add.at(wanted, ranges[:, 1], -1)
            at_word = np.flatnonzero(inside & (np.cumsum(wanted)[:-1] > 0))
            if not len(at_word):
                continue
            one, two = (rolling(words.hashes(seed), WINDOW)[at_word] for seed in (1, 2))
            doc = words.text_of_word()[at_word]
            ids, keys = chunk.column("doc_id").to_numpy(), chunk.column("key").to_numpy()
            place = at_word - words.starts[doc]
            repeat = ids[doc] > _least_ids(one, two, ids[doc])
            rows = [_row(_own_bucket(ids, buckets), ids, keys, doc[repeat], place[repeat])]
            for bucket, take in _packed(np.flatnonzero(~repeat), (one[~repeat] % np.uint64(buckets)).astype(np.int64), buckets):
                rows.append(_row(bucket, ids, keys, doc[take], place[take], one[take].astype("<u8").tobytes(), two[take].astype("<u8").tobytes()))
            yield pa.RecordBatch.from_pylist(rows, _PACKED)

    return run


def _least_ids(one: np.ndarray, two: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id with the same two hashes, for each place."""
    if not len(one):
        return np.empty(0, np.int64)
    order = np.lexsort((two, one))
    new = np.ones(len(order), bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    begin = np.flatnonzero(new)
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(np.minimum.reduceat(ids[order], begin), np.diff(np.append(begin, len(order))))
    return out


def _repeats(buckets: int):
    """Places of one bucket whose window is also in a document with a smaller id."""

    def run(table: pa.Table) -> pa.Table:
        ids, keys, doc, place = _unpacked(table)
        if table.column("bucket")[0].as_py() < 0:
            return _to_documents(ids, keys, doc, place, buckets)
        one, two = (np.frombuffer(b"".join(table.column(c).to_pylist()), "<u8") for c in ("one", "two"))
        found = np.flatnonzero(ids[doc] > _least_ids(one, two, ids[doc]))
        return _to_documents(ids, keys, doc[found], place[found], buckets)

    return run


def _spans(before: int, after: int):
    """The places of each document of a bucket as merged ranges [place - before, place + after)."""

    def run(table: pa.Table) -> pa.Table:
        ids, keys, doc, place = _unpacked(table)
        if not len(place):
            return _SPANS.empty_table()
        own, key, at = ids[doc], keys[doc], place.astype(np.int64)
        order = np.lexsort((at, key, own))
        own, key, at = own[order], key[order], at[order]
        first, end = np.maximum(at - before, 0), at + after
        document = np.ones(len(at), bool)
        document[1:] = (own[1:] != own[:-1]) | (key[1:] != key[:-1])
        # Ranges of one document have one length, but for those cut at its start, so their ends ascend.
        new = document.copy()
        new[1:] |= first[1:] > end[:-1]
        begin = np.flatnonzero(new)
        spans = np.stack([first[begin], end[np.append(begin[1:], len(at)) - 1]], axis=1).astype("<u4")
        rows = np.flatnonzero(document[begin])
        bounds = np.append(rows, len(begin)).tolist()
        heads = begin[rows]
        data = [spans[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
        return pa.table([pa.array(own[heads]), pa.array(key[heads]), pa.array(data, pa.binary())], schema=_SPANS)

    return run


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, key and spans of each document with repeats; ``docs`` has doc_id, key and text.

    Spans are pairs of little-endian 32-bit word places, first and one past the last.
    """
    docs = docs.filter("doc_id is not null")
    n_words = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_words // BUCKET_WORDS)

    def spans(texts: DataFrame, records, found, before: int, after: int) -> DataFrame:
        packed = texts.mapInArrow(records(buckets), _PACKED_SQL)
        places = packed.groupBy("bucket").applyInArrow(found(buckets), _PACKED_SQL)
        merged = places.groupBy("bucket").applyInArrow(_spans(before, after), "doc_id long, key long, spans binary")
        return written(merged, "spans")

    candidates = spans(docs, _anchor_records, _probe, BLOCK, 1)
    near = docs.join(bounded(candidates), ["doc_id", "key"]).select("doc_id", "key", "text", "spans")
    return spans(near, _candidate_records, _repeats, 0, WINDOW)


def dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_words, n_removed, kept (the text left, words joined by a space)."""
    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), F.col("text").cast("string"))
    spans = repeated_spans(keyed)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = (text or "").encode().split()
                kept, begin = [], 0
                for first, end in np.frombuffer(ranges or b"", "<u4").reshape(-1, 2).tolist():
                    kept += words[begin:first]
                    begin = end
                kept += words[begin:]
                out.append((len(words), len(words) - len(kept), b" ".join(kept).decode()))
            n, removed, texts = zip(*out, strict=True) if out else ((), (), ())
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    found = keyed.join(bounded(spans), ["doc_id", "key"], "left")
    return found.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")
