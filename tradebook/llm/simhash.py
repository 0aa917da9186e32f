"""SimHash near-duplicates: fingerprints, a range join on segment bit counts, exact checks, components.

A fingerprint of 64 bits is embedded as the bit counts of its 32 segments of two bits. One differing
bit moves one count by one, so the Manhattan distance of two count vectors is at most the number of
differing bits. Vectors that are at most ``LINK_BITS`` = 2 apart differ on at most two axes; with the
axes dealt into six sets, they agree on four whole sets. Each point therefore enters 15 grids, one
for each choice of four sets, in the cell of its counts there, and all candidates meet in a cell.
A pair counts in the first grid that has it, must pass the Manhattan bound, and is then checked bit
by bit. Counts are kept in unary code (0, 1, 11), in which the Manhattan distance of two vectors is
the number of differing bits.

Pairs are only formed in cells of up to ``PAIRED`` distinct fingerprints. For those of larger cells the
same links come without pairs: two fingerprints differ in two bits or fewer if and only if
some 64-bit value is within one bit of both, so each is joined to its 65 near values and
linked with the smallest fingerprint at each. That is linear, however large the cell.

Copies share a fingerprint and are one point. Defined results: a null text counts as empty, and all
texts without a word have fingerprint zero; rows with a null doc_id get a fingerprint and
component but cannot be the component's id, unless none has an id (null then); repeated ids are
rows of their own; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradebook.llm.columns import written
from tradebook.llm.components import components

SHINGLE = 3
SEED = 42
LINK_BITS = 2
PAIRED = 64
#: The 32 segments in six sets.
_SETS = [sum(3 << (2 * s) for s in range(32) if s % (LINK_BITS + 4) == k) for k in range(LINK_BITS + 4)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


_GRIDS = [_signed(sum(_SETS[k] for k in kept)) for kept in combinations(range(LINK_BITS + 4), 4)]
_LOW = _signed(sum(1 << (2 * s) for s in range(32)))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half of the hashes of the text's shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        pieces = [b" ".join(words)]
    else:
        pieces = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    hashes = np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in pieces), np.uint64)
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    most = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int.from_bytes(np.packbits(most, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fingerprint (as a signed long) of each whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [_signed(fingerprint(t.as_py(), shingle)) for t in batch.column("text")]
            yield pa.record_batch([batch.column("doc_id"), pa.array(values, pa.int64())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fingerprint long")


def _unary(f: Column) -> Column:
    """Bit counts of the segments of two bits, each in unary code."""
    other = F.shiftrightunsigned(f, 1)
    return f.bitwiseOR(other).bitwiseAND(_LOW).bitwiseOR(F.shiftleft(f.bitwiseAND(other).bitwiseAND(_LOW), 1))


def _differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(points: DataFrame) -> DataFrame:
    """(a, b) pairs of distinct fingerprints that connect all of those within ``LINK_BITS`` bits.

    ``points`` has one column, f, of distinct fingerprints, and is best a written table.
    """
    grids = F.array(*(F.struct(F.lit(g).alias("grid"), _unary(F.col("f")).bitwiseAND(F.lit(m)).alias("cell")) for g, m in enumerate(_GRIDS)))
    cells = points.select("f", F.explode(grids).alias("at")).select("at.grid", "at.cell", "f")
    shared = cells.groupBy("grid", "cell").agg(F.count("*").alias("n")).filter("n > 1")
    met = written(cells.join(shared, ["grid", "cell"]), "cells")

    masks = F.array(*(F.lit(m) for m in _GRIDS))

    def pair(a: Column, b: Column) -> Column:
        gap = _unary(a).bitwiseXOR(_unary(b))
        earlier = F.exists(F.slice(masks, F.lit(1), F.col("grid")), lambda m: gap.bitwiseAND(m) == 0)
        return (b > a) & (F.bit_count(gap) <= LINK_BITS) & (_differing(a, b) <= LINK_BITS) & ~earlier

    small = met.filter(F.col("n") <= PAIRED).groupBy("grid", "cell").agg(F.collect_list("f").alias("fs"))
    paired = F.flatten(
        F.transform("fs", lambda a: F.transform(F.filter("fs", lambda b: pair(a, b)), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    )
    from_pairs = small.select(F.explode(paired).alias("l")).select("l.a", "l.b")

    crowded = met.filter(F.col("n") > PAIRED).select("f").distinct()
    near = F.array(F.col("f"), *(F.col("f").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)))
    near_values = crowded.select("f", F.explode(near).alias("near"))
    hubs = near_values.groupBy("near").agg(F.min("f").alias("least"), F.count("*").alias("n")).filter("n > 1")
    from_hubs = near_values.join(hubs, "near").filter("f != least").select(F.col("f").alias("a"), F.col("least").alias("b"))
    return from_pairs.unionByName(from_hubs)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs`` (doc_id, text; others ignored)."""
    found = written(fingerprints(docs, shingle), "fingerprints")
    points = written(found.groupBy(F.col("fingerprint").alias("f")).agg(F.min("doc_id").alias("first")), "points")
    roots = written(components(links(points.select("f"))), "roots")
    # Only fingerprints that have a link move; the others are their own component.
    moved = roots.join(points, roots["node"] == points["f"]).select("f", "root", "first")
    ids = moved.groupBy("root").agg(F.min("first").alias("component_id"))
    joined = moved.select("f", "root").join(ids, "root").select("f", "component_id")
    named = written(
        points.join(joined, "f", "left").select("f", F.coalesce("component_id", "first").alias("component_id")), "components"
    )
    # Both sides come straight from files, so that Spark can split the rows of a very common fingerprint.
    return found.join(named, found["fingerprint"] == named["f"]).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )
