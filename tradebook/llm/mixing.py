"""Mixing sources to target weights by Pfair scheduling of blocks.

The texts of a source, in an order given by a hash, are laid end to end and cut into blocks of ``block_chars``
characters; a document belongs to the block that it starts in. Slots take one block each. With
weight w, the j-th block of a source is released at slot floor(j / w) and due at ceil((j + 1) / w); each
slot goes to the released block that is due first. Weights are taken exactly, as ratios of whole numbers that add up to one, so
every block meets its due slot, and after any number of slots a source has had its share to within less than one
block. When a source runs out, a new phase begins with the others' weights scaled up, and the bound holds from there:
nothing is dropped or repeated, and no source waits for another. Sources without a target weight come after all others.

Slots are dealt to blocks on the driver, which takes a step for each block, and a pass over the sources for each that runs out. Blocks
grow with the corpus so that there are about ``MOST_BLOCKS`` at most, besides one for each source. The plan is a table of
(source, block, slot); it is broadcast up to that number of rows, and joined by shuffle beyond. Numbering the
documents of a source is split over ranges of the hash, so a source that holds most rows is many tasks.

Defined results: a null source is a source; null and empty texts count as one character; rows that
share id and text share a slot; an empty table gives an empty one.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradebook.llm.columns import text_of, written

BLOCK_CHARS = 1 << 16
#: Blocks beyond one for each source; a larger corpus has larger blocks.
MOST_BLOCKS = 1 << 20
#: Documents of one source that are numbered in one task, on average.
NUMBERED = 4096


def whole_weights(weights: Mapping[int, float]) -> dict[int, int]:
    """Whole numbers in exactly the proportion of the weights."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = max((x.denominator for x in exact.values()), default=1)  # powers of two
    return {s: int(x * scale) for s, x in exact.items()}


def phase(weights: Mapping[int, int], blocks: Mapping[int, int]) -> list[int]:
    """The source of each slot, up to the one in which a source runs out of blocks."""
    total = sum(weights.values())
    done = dict.fromkeys(weights, 0)
    waiting = [(0, s) for s in sorted(weights)]
    ready: list[tuple[int, int]] = []
    out: list[int] = []
    while True:
        slot = len(out)
        while waiting and waiting[0][0] <= slot:
            s = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(done[s] + 1) * total // weights[s]), s))
        s = heapq.heappop(ready)[1]
        out.append(s)
        done[s] += 1
        if done[s] == blocks[s]:
            return out
        heapq.heappush(waiting, (max(done[s] * total // weights[s], slot + 1), s))


def slots(blocks: Mapping[int, int], weights: Mapping[int, float]) -> list[int]:
    """The source of each slot until every block has one; phase after phase, as sources run out."""
    left = {s: n for s, n in blocks.items() if n}
    whole = whole_weights({s: weights.get(s, 0.0) for s in left})
    out: list[int] = []
    while left:
        now = {s: whole[s] for s in left if whole[s] > 0} or dict.fromkeys(left, 1)
        taken = phase(now, left)
        out += taken
        for s, n in zip(*map(np.ndarray.tolist, np.unique(taken, return_counts=True)), strict=True):
            left[s] -= n
            if not left[s]:
                del left[s]
    return out


def schedule(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    power: float = 0.5,
    block_chars: int = BLOCK_CHARS,
    seed: int = 42,
) -> DataFrame:
    """Where each row of ``docs`` (doc_id, text, source) comes in the mixture.

    Columns: doc_id, source, text_hash, size (characters), offset (characters of the source before it), block, slot. The
    mixture is the order of (slot, offset). Without ``weights``, a source weighs its characters to the ``power``.
    """
    spark = docs.sparkSession
    size = F.greatest(F.length(text_of("text")), F.lit(1)).cast("long")
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("text_hash"), size.alias("size"))
    rows = written(rows.withColumn("place", F.xxhash64(F.lit(seed), "doc_id", "text_hash")), "sizes")
    splits = max(1, rows.count() // NUMBERED)
    split = rows.withColumn("split", F.shiftright((F.shiftright("place", 32) + (1 << 31)) * splits, 32).cast("int"))
    sizes = split.groupBy("source", "split").agg(F.sum("size").alias("chars"))
    sizes = written(sizes, "splits")
    totals = sizes.groupBy("source").agg(F.sum("chars").alias("chars")).collect()
    earlier = Window.partitionBy("source").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("source", "split", F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "split").orderBy("place", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    numbered = split.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    same = numbered["source"].eqNullSafe(before["source"]) & (numbered["split"] == before["split"])
    placed = numbered.join(before, same).select(
        "doc_id", numbered["source"], "text_hash", "size", (F.col("before") + F.col("inside")).alias("offset")
    )
    names = sorted((r["source"] for r in totals), key=lambda s: (s is not None, s or ""))
    chars = {r["source"]: r["chars"] for r in totals}
    block_chars = max(block_chars, -(-sum(chars.values()) // MOST_BLOCKS))
    # The last document may start up to the last character, so these are all blocks that one can start in.
    blocks = {i: (chars[s] - 1) // block_chars + 1 for i, s in enumerate(names)}
    share = {i: float(chars[s]) ** power if weights is None else float(weights.get(s, 0.0)) for i, s in enumerate(names)}
    sources = np.array(slots(blocks, share), np.int64)
    by_source = np.argsort(sources, kind="stable")
    firsts = np.cumsum([0, *(blocks[i] for i in range(len(names)))])[:-1]
    numbers = np.arange(len(sources)) - firsts[sources[by_source]] if len(sources) else sources
    named = pa.DictionaryArray.from_arrays(pa.array(sources[by_source]), pa.array(names, pa.string())).cast(pa.string())
    plan = pa.table({"name": named, "number": pa.array(numbers, pa.int64()), "slot": pa.array(by_source, pa.int64())})
    plan = spark.createDataFrame(plan, "name string, number long, slot long")
    plan = F.broadcast(plan) if len(sources) <= MOST_BLOCKS else plan
    block = F.expr(f"offset div {block_chars}")
    joined = placed.withColumn("block", block).join(plan, F.col("source").eqNullSafe(F.col("name")) & (F.col("block") == F.col("number")))
    return joined.select("doc_id", "source", "text_hash", "size", "offset", "block", "slot")


def mixed(docs: DataFrame, weights: Mapping[str | None, float] | None = None, **options) -> DataFrame:
    """The rows of ``docs``, with their columns, sorted by the mixture over ranges of slots."""
    places = schedule(docs, weights, **options).groupBy("doc_id", "text_hash").agg(F.min(F.struct("slot", "offset")).alias("place"))
    rows = docs.select(F.struct("*").alias("row"))
    same = rows["row"]["doc_id"].eqNullSafe(places["doc_id"]) & (F.xxhash64(rows["row"]["text"]) == places["text_hash"])
    return rows.join(places, same).select("row", "place").repartitionByRange("place").sortWithinPartitions("place").select("row.*")
