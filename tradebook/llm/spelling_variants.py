"""Spelling variants of frequent words, found by PartEnum signatures of letter multisets.

A word is a binary vector with one place for each letter and number of its occurrence in the word: ``banana`` has b1, a1, n1,
a2, n2 and a3. Words that differ by one inserted, deleted or replaced letter have vectors of Hamming distance two at most
(``DISTANCE``). PartEnum deals the places into ``first`` groups, of which at least one then holds no more than
``DISTANCE // first`` differences, and each group into ``second`` parts; every choice of as many parts as surely agree makes a
signature, and two near words share one exactly. The defaults give three signatures, of a third of the places each.

Words of few letters have many anagrams, so the join key has the place of the edit besides: with the shorter word cut into
three stretches, near words agree in all text before one stretch and all after it. Keys are met by an equi-join, whose
condition verifies each pair by its edit distance, so that only near pairs leave the join.

A word's form is its near word of most occurrences, if these are ten times its own at least; forms are followed by pointer
doubling, which ends since occurrences grow tenfold with each step.

Defined results: a null text has no words; a null doc_id counts as empty text in the check sum; rows that repeat count again. Columns other
than doc_id and text are not looked at. Texts and runs may have any length. An empty table gives no words. Words with equal
occurrences are told apart by their code points.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradebook.llm.columns import bounded, written
from tradebook.llm.words import chunks

DISTANCE = 2
#: Groups of places, and parts of each group.
FIRST, SECOND = 3, 1
#: Stretches of the shorter word, one of which has the edit.
STRETCHES = 3
LEAST_LETTERS, LEAST_OCCURRENCES, TIMES = 7, 2, 10
#: One in so many runs of a text loses a letter.
MISSPELT = 31
#: A task adds up so many different words before it passes them on.
_HELD = 500_000
_BATCH = 50_000
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

# --- words


def _counts(least: int, misspelt: int | None) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % least)

    def emitted(totals: Counter) -> Iterator[pa.RecordBatch]:
        words = list(totals)
        for i in range(0, len(words), _BATCH):
            some = words[i : i + _BATCH]
            yield pa.record_batch([pa.array(some, pa.string()), pa.array([totals[w] for w in some], pa.int64())], ["word", "n"])
        totals.clear()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: Counter = Counter()
        for table in chunks(batches):
            for doc_id, text in zip(table.column("doc_id").to_pylist(), table.column("text").cast(pa.large_binary()).to_pylist()):
                if text is None:
                    continue
                head = zlib.crc32(b"%s:" % ("" if doc_id is None else str(doc_id)).encode())
                found = Counter(m.group() for m in runs.finditer(text.translate(_LOWER).decode()))
                for word, n in found.items():
                    if misspelt:
                        check = zlib.crc32(word.encode(), head)
                        if check % misspelt == 0:
                            at = check % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least:
                                continue
                    totals[word] += n
                if len(totals) >= _HELD:
                    yield from emitted(totals)
        yield from emitted(totals)

    return run


def words(docs: DataFrame, least: int = LEAST_LETTERS, occurrences: int = LEAST_OCCURRENCES, misspelt: int | None = MISSPELT) -> DataFrame:
    """(word, n): maximal runs of letters with their occurrences in all texts; ``misspelt`` says how often a letter is dropped."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    partial = texts.mapInArrow(_counts(least, misspelt), "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= occurrences)


# --- signatures


def places(word: str) -> list[tuple[str, int]]:
    """The places of a word's vector that are set: each letter with the number of its occurrence."""
    seen: Counter = Counter()
    out = []
    for letter in word:
        out.append((letter, seen[letter]))
        seen[letter] += 1
    return out


def signatures(word: str, first: int = FIRST, second: int = SECOND, distance: int = DISTANCE, known: dict | None = None) -> list[int]:
    """PartEnum signatures; words whose vectors differ in ``distance`` places at most share one."""
    spare = distance // first
    if spare >= second:
        raise ValueError("more parts are needed than differences that one group may hold")
    known = {} if known is None else known
    sums = [0] * (first * second)
    for place in places(word):
        if place not in known:
            value = xxhash.xxh64_intdigest(f"{place[0]}{place[1]}")
            known[place] = (value % (first * second), xxhash.xxh64_intdigest(f"{place[0]}{place[1]}", 1))
        part, value = known[place]
        sums[part] += value
    out = []
    for group in range(first):
        parts = sums[group * second : (group + 1) * second]
        for chosen in combinations(range(second), second - spare):
            text = f"{group} {chosen} {[parts[i] for i in chosen]}"
            out.append(xxhash.xxh64_intdigest(text) - (1 << 63))
    return out


def _signed(first: int, second: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            found = [signatures(word, first, second, known=known) for word in batch.column("word").to_pylist()]
            yield pa.record_batch([batch.column("word"), batch.column("n"), pa.array(found, pa.list_(pa.int64()))], ["word", "n", "signatures"])

    return run


def _keys(signed: DataFrame, shorter: int) -> DataFrame:
    """(key, word, n) of words that are ``shorter`` letters longer than the shorter word of a pair."""
    size = F.char_length("word") - shorter
    bounds = [(size * i / STRETCHES).cast("int") for i in range(STRETCHES + 1)]
    cuts = [
        F.xxhash64(F.col("signature"), size, F.lit(i), F.substring(F.col("word"), F.lit(1), bounds[i]), F.right(F.col("word"), size - bounds[i + 1]))
        for i in range(STRETCHES)
    ]
    signed = signed.select("word", "n", F.explode("signatures").alias("signature"))
    return signed.select(F.explode(F.array(*cuts)).alias("key"), "word", "n")


def near_pairs(counted: DataFrame, first: int = FIRST, second: int = SECOND) -> DataFrame:
    """(a, a_n, b, b_n): each pair of words that differ by one inserted, deleted or replaced letter, once.

    ``counted`` is a written table of distinct words with their n.
    """
    signed = written(counted.mapInArrow(_signed(first, second), "word string, n long, signatures array<long>"), "signed")
    a = _keys(signed, 0).withColumnsRenamed({"word": "a", "n": "a_n"})
    b = _keys(signed, 0).unionByName(_keys(signed, 1)).withColumnsRenamed({"key": "b_key", "word": "b", "n": "b_n"})
    # Words of equal length meet both ways round, so one way is enough; a longer word is always b.
    once = (F.char_length("a") < F.char_length("b")) | (F.col("a") < F.col("b"))
    met = a.join(b, (F.col("key") == F.col("b_key")) & once & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "a_n", "b", "b_n").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words that have a form, by pointer doubling."""
    jumps = written(forms.select("word", F.col("form").alias("root")), "jumps")
    while True:
        onward = bounded(jumps.select(F.col("word").alias("root"), F.col("root").alias("onward")))
        moved = jumps.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved"))
        moved = written(moved, "jumps")
        jumps = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return jumps


def variants(docs: DataFrame, times: int = TIMES, **of_words: int | None) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of ``docs`` (doc_id, text)."""
    counted = written(words(docs, **of_words), "words")
    pairs = near_pairs(counted)
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("near_n")),
    )).alias("side")).select("side.*")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    found = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    whole = counted.join(found, "word", "left")
    formed = -F.col("best.less") >= times * F.col("n")
    whole = written(
        whole.select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    roots = bounded(_roots(whole.filter("form is not null")))
    return whole.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
