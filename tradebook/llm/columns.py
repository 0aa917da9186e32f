"""Column helpers of the operators that stay inside Spark's own functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradebook.sources.files import scratch_path

#: Everything that separates words: the space and the characters 9 to 13.
BLANKS = " \t\n\x0b\x0c\r"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once per row, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: worked out once, and safe from lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes up to which one side of a join is broadcast; measured before it is done.
BROADCAST_BYTES = 64 << 20


def bounded(df: DataFrame) -> DataFrame:
    """``df``, a written table to be joined, marked for broadcast while its measured size allows it."""
    wide = [F.sum(F.octet_length(c)) for c, kind in df.dtypes if kind in ("binary", "string")]
    rows, *sizes = df.agg(F.count("*"), *wide).first()
    return F.broadcast(df) if 16 * len(df.columns) * rows + sum(x or 0 for x in sizes) <= BROADCAST_BYTES else df
