"""Benchmark decontamination by templates: numbers, names and units become typed placeholders.

Texts and benchmark items become canonical tokens: a word that holds a digit is a number, together with the word for a
measure that follows it or the currency sign before it; capitalised words in a row that are no function words are one name; anything
else is the word in lower case without punctuation around it. So a value may have another number of words. Windows of
``WINDOW`` tokens with enough literal ones are hash-joined.

Hits of one document and item belong together where the item would begin at about the same place of the document. Words put
in or left out move that place, so hits are taken in bands of half the item's length, of which there are two sets, one half a band
further on: places that are a quarter of the item apart or less are in one band. The slots of a band must be consistent: one value of
the item always stands for one value of the document and the other way round. Windows that break this with more support against than
for them are left out, and an item counts as leaked when the rest covers ``LEAST`` of its tokens. So an item asked again with other
numbers and names is caught, and text that only shares a pattern is not.

The benchmark's windows are counted first. Up to ``BROADCAST_WINDOWS`` their hashes go to all tasks, which then send on
only windows that hit. Beyond, all windows are joined by hash; Spark can split that join's
hot hashes. The hits of one document, item and band are bounded by the item's length.

Defined results: null or empty texts and items, and items of fewer than ``WINDOW`` tokens, never match; rows that share a
doc_id or item_id count as one text given several times; a null id is an id like any other; an empty table
on either side gives an empty one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradebook.llm.columns import written
from tradebook.llm.html_extraction import STOP_WORDS
from tradebook.llm.words import Words, chunks, rolling

WINDOW = 8
#: Literal tokens that a window needs, so that a run of placeholders says nothing.
LITERALS = 4
LEAST = 0.5
#: Benchmark windows up to which their hashes (eight bytes each) are sent to all tasks.
BROADCAST_WINDOWS = 2_000_000
UNITS = frozenset(
    "% ° amp amps bit bits byte bytes cent centimeter centimeters cents cm day days degree degrees dollar dollars euro euros feet "
    "foot ft g gallon gallons gb gram grams h hour hours hz in inch inches jahr jahre j kb kg khz kilogram kilograms kilometer "
    "kilometers km kmh kw kwh l lb lbs liter liters m mb meter meters metre metres mg mhz mi mile miles min minute minutes ml mm month "
    "months mph ms ounce ounces oz percent pound pounds prozent s sec second seconds stunden stück t tag tage ton tons v volt volts w "
    "watt watts week weeks yard yards yd year years € £ $ ¥".split()
)
_CURRENCY = frozenset("$€£¥")
_LITERAL, _NUMBER, _NAME, _UNIT, _NONE = range(5)
_AROUND = re.compile(r"^[\W_]+|[\W_]+$")
_DIGIT = re.compile(r"\d")


def _token(word: str) -> tuple[int, str]:
    """Kind and value of one word; a unit is only one after a number."""
    if word in UNITS:
        return _UNIT, word
    bare = _AROUND.sub("", word)
    if not bare:
        return _NONE, ""
    lower = bare.lower()
    if _DIGIT.search(bare):
        return _NUMBER, lower
    if lower in UNITS and bare == lower:
        return _UNIT, lower
    if bare[0].isupper() and bare[1:] == bare[1:].lower() and lower not in STOP_WORDS:
        return _NAME, lower
    return _LITERAL, lower


class _Tokens:
    """Canonical tokens of a column of texts: hashes, kinds and values, and where each text starts."""

    def __init__(self, texts: pa.ChunkedArray):
        words = Words(texts)
        tokens = [_token(w.decode()) for w in words.distinct]
        kinds = np.fromiter((k for k, _ in tokens), np.int8, len(tokens))
        hashes = np.fromiter((xxhash.xxh64_intdigest(v, 3) for _, v in tokens), np.uint64, len(tokens))
        signs = np.fromiter((v in _CURRENCY for _, v in tokens), bool, len(tokens))
        self.codes, self.starts = words.codes, words.starts
        self._keep(kinds[self.codes] != _NONE)
        kind = kinds[self.codes]
        before, after = self._beside(kind)
        unit = (kind == _UNIT) & ((before == _NUMBER) | (signs[self.codes] & (after == _NUMBER)))
        again = (kind == _NAME) & (before == _NAME)
        self.kinds = np.where((kind == _UNIT) & ~unit, _LITERAL, kind)
        self.kinds = self.kinds[self._keep(~(unit | again))]
        self._values = tokens
        marks = np.array([0, *(xxhash.xxh64_intdigest(f"<{k}>", 5) for k in ("number", "name", "unit")), 0], np.uint64)
        canonical = np.where(self.kinds == _LITERAL, hashes[self.codes], marks[self.kinds])
        self.hashes = rolling(canonical, WINDOW)
        n = len(self.hashes)
        ends = np.repeat(self.starts[1:], np.diff(self.starts))[:n]
        literal = np.concatenate(([0], np.cumsum(self.kinds == _LITERAL)))
        self.good = (np.arange(n) + WINDOW <= ends) & (literal[WINDOW:] - literal[:n] >= LITERALS) if n else np.empty(0, bool)

    def _keep(self, kept: np.ndarray) -> np.ndarray:
        self.codes = self.codes[kept]
        self.starts = np.concatenate(([0], np.cumsum(kept)))[self.starts]
        return kept

    def _beside(self, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Kinds of the tokens before and after each one in its text."""
        before, after = np.full_like(kind, _NONE), np.full_like(kind, _NONE)
        before[1:], after[:-1] = kind[:-1], kind[1:]
        heads = self.starts[:-1][self.starts[:-1] < len(kind)]
        before[heads] = _NONE
        after[heads[heads > 0] - 1] = _NONE
        return before, after

    def slots(self, at: int) -> list[str]:
        """Kind and value of each slot of a window, in order."""
        return [f"{self.kinds[i]}{self._values[self.codes[i]][1]}" for i in range(at, at + WINDOW) if self.kinds[i] != _LITERAL]


def _windows(name: str, wanted: np.ndarray | None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            tokens = _Tokens(chunk.column("text"))
            good = tokens.good
            if wanted is not None and len(tokens.hashes):
                place = np.minimum(np.searchsorted(wanted, tokens.hashes), max(len(wanted) - 1, 0))
                good = good & (wanted[place] == tokens.hashes) if len(wanted) else np.zeros(len(good), bool)
            at = np.flatnonzero(good)
            text = np.searchsorted(tokens.starts, at, side="right") - 1
            yield pa.record_batch(
                [
                    pa.array(tokens.hashes[at].view(np.int64)),
                    chunk.column(name).combine_chunks().take(pa.array(text)),
                    pa.array(at - tokens.starts[text], pa.int64()),
                    pa.array((tokens.starts[text + 1] - tokens.starts[text]), pa.int64()),
                    pa.array([tokens.slots(i) for i in at.tolist()], pa.list_(pa.string())),
                ],
                ["hash", name, "at", "size", "slots"],
            )

    return run


def windows(texts: DataFrame, name: str, wanted: np.ndarray | None = None) -> DataFrame:
    """hash, id (as ``name``), at (token), size (tokens of the text) and slots of each window, or of those with a ``wanted`` hash."""
    given = texts.select(name, F.col("text").cast("string"))
    kind = dict(given.dtypes)[name]
    return given.mapInArrow(_windows(name, wanted), f"hash long, {name} {kind}, at long, size long, slots array<string>")


def consistent(windows: list[tuple[int, list[str], list[str]]]) -> list[int]:
    """Places of the windows whose slots agree with what most windows of the same band say.

    A window is (place, slots of the item, slots of the document).
    """
    votes = Counter(p for _, item, doc in windows for p in zip(item, doc, strict=True))
    one: dict[str, str] = {}
    other: dict[str, str] = {}
    for (a, b), _ in sorted(votes.items(), key=lambda v: (-v[1], v[0])):
        if a not in one and b not in other:
            one[a], other[b] = b, a
    return [at for at, item, doc in windows if all(one.get(a) == b for a, b in zip(item, doc, strict=True))]


def _covered(places: list[int]) -> int:
    """Tokens of the item in windows at these places."""
    total, end = 0, 0
    for p in sorted(set(places)):
        total += p + WINDOW - max(p, end)
        end = p + WINDOW
    return total


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row for each document (doc_id, text) and benchmark item (item_id, text) that it has.

    Columns: doc_id, item_id, coverage (share of the item's tokens), n_windows, first_token (in the document, of the best
    band) and contaminated, which is true in all of them.
    """
    asked = written(windows(benchmark, "item_id"), "templates")
    hashes = asked.select("hash").distinct()
    if hashes.count() <= broadcast_windows:
        wanted = np.sort(np.array([r[0] for r in hashes.collect()], np.int64).view(np.uint64))
        found = windows(docs, "doc_id", wanted)
    else:
        found = windows(docs, "doc_id")
    item = asked.select("hash", "item_id", F.col("at").alias("item_at"), F.col("size").alias("item_size"), F.col("slots").alias("item_slots")).distinct()
    hits = found.join(item, "hash").withColumn("shift", F.col("at") - F.col("item_at"))
    width = F.greatest(F.lit(8), F.expr("item_size div 2"))
    sets = [F.struct(F.lit(half).alias("half"), F.floor((F.col("shift") + width * half / 2) / width).alias("band")) for half in (0, 1)]
    # A document repeated under one id adds nothing.
    lines = hits.select("*", F.explode(F.array(*sets)).alias("line")).groupBy("doc_id", "item_id", "line").agg(
        F.first("item_size").alias("size"), F.collect_set(F.struct("item_at", "item_slots", "slots", "at")).alias("hits")
    )
    ids = {n: t for n, t in lines.dtypes if n in ("doc_id", "item_id")}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = batch.column("hits").to_pylist()
            kept = [consistent([(h["item_at"], h["item_slots"], h["slots"]) for h in some]) for some in hits]
            covered = [_covered(k) / n for k, n in zip(kept, batch.column("size").to_pylist(), strict=True)]
            windows = [len(set(k)) for k in kept]
            first = [min((h["at"] for h in some if h["item_at"] in k), default=0) for some, k in zip(hits, map(set, kept), strict=True)]
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("item_id"), pa.array(covered, pa.float64()), pa.array(windows, pa.int64()), pa.array(first, pa.int64())],
                ["doc_id", "item_id", "coverage", "n_windows", "first_token"],
            )

    judged = lines.mapInArrow(run, f"doc_id {ids['doc_id']}, item_id {ids['item_id']}, coverage double, n_windows long, first_token long")
    best = F.max_by(F.struct("coverage", "n_windows", "first_token"), F.struct("coverage", -F.col("first_token")))
    return (
        judged.filter(F.col("coverage") >= least)
        .groupBy("doc_id", "item_id")
        .agg(best.alias("best"))
        .select("doc_id", "item_id", "best.*", F.lit(True).alias("contaminated"))
    )
