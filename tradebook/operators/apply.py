"""Applying accepted changes to a table, which gives the table's next contents as a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradebook.schema import KEYS, SCHEMAS

# A task that writes copies of one row writes at most this many of them.
COPIES_PER_TASK = 100_000


def apply_changes(
    contents: DataFrame, accepted: DataFrame, table: str, order: tuple[str, ...] = ("seq",)
) -> DataFrame:
    """Insert, replace and remove rows as the changes say; on the same key the last change wins."""
    if KEYS[table]:
        return _apply_by_key(contents, accepted, table, order)
    return _apply_by_value(contents, accepted, table)


def _last_images(accepted: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """One row per touched key: the image it ends with, NULL when it ends removed.

    An update that moves a row to another key removes the old key and sets the new one.
    """
    none = F.when(F.lit(False), F.col("new"))
    touched = F.array(
        F.struct(F.lit(0).alias("step"), *[F.col("old")[k].alias(k) for k in keys], none.alias("image")),
        F.struct(F.lit(1).alias("step"), *[F.col("new")[k].alias(k) for k in keys], F.col("new").alias("image")),
    )
    present = F.when(F.col("op") == "I", F.slice(touched, 2, 1)).when(F.col("op") == "D", F.slice(touched, 1, 1))
    events = accepted.select(*order, F.explode(F.coalesce(present, touched)).alias("event")).select(
        *[F.col("event")[k].alias(k) for k in keys],
        F.struct(*order, F.col("event.step").alias("step")).alias("position"),
        F.col("event.image").alias("image"),
    )
    return events.groupBy(*keys).agg(F.max_by("image", "position").alias("image"))


def _apply_by_key(contents: DataFrame, accepted: DataFrame, table: str, order: tuple[str, ...]) -> DataFrame:
    keys = KEYS[table]
    last = _last_images(accepted, keys, order)
    same_key = [contents[k] == last[k] for k in keys]
    untouched = contents.join(last.select(*keys), same_key, "left_anti")
    written = last.where(F.col("image").isNotNull()).select("image.*")
    return untouched.select(*SCHEMAS[table].fieldNames()).unionByName(written)


def _apply_by_value(contents: DataFrame, accepted: DataFrame, table: str) -> DataFrame:
    """Rows without a key: each removal takes away one copy of its old image.

    Only values that some change touches are counted; all other rows pass through. The copies
    left of a touched value are written in pieces, so that a value with very many copies does
    not end up in one task.
    """
    names = SCHEMAS[table].fieldNames()
    steps = F.array(
        F.struct(F.col("old").alias("image"), F.lit(-1).cast("bigint").alias("copies")),
        F.struct(F.col("new").alias("image"), F.lit(1).cast("bigint").alias("copies")),
    )
    net = (
        accepted.select(F.explode(F.filter(steps, lambda s: s["image"].isNotNull())).alias("step"))
        .select("step.image.*", "step.copies")
        .groupBy(*names)
        .agg(F.sum("copies").alias("copies"))
    )
    same = [contents[c].eqNullSafe(net[c]) for c in names]
    untouched = contents.join(net.select(*names), same, "left_anti").select(*names)
    touched = contents.join(net.select(*names), same, "left_semi").select(*names)
    counted = touched.groupBy(*names).agg(F.count("*").alias("copies"))
    left = counted.unionByName(net).groupBy(*names).agg(F.sum("copies").alias("copies")).where(F.col("copies") > 0)
    pieces = F.sequence(F.lit(0), F.expr(f"(copies - 1) div {COPIES_PER_TASK}"))
    copies_here = F.least(F.lit(COPIES_PER_TASK), F.col("copies") - F.col("piece") * COPIES_PER_TASK)
    written = (
        left.select(*names, "copies", F.explode(pieces).alias("piece"))
        .repartition(*names, "piece")
        .select(*names, F.explode(F.sequence(F.lit(1), copies_here.cast("int"))))
        .select(*names)
    )
    return untouched.unionByName(written)
