"""Base tables in buckets of a join key, so that joins and sums on the key need no shuffle.

Tables that meet on a key get the same number of buckets. Spark then joins bucket with bucket, each read by one task, so
the number should be such that a bucket fits a task. A key with a large share of the rows makes a large bucket: leave
such a table as it is, where its rows pass a shuffle and Spark splits them.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from tradebook.schema import SCHEMAS, Tables
from tradebook.sources.files import COMPRESSION

BUCKETS = 64
#: Tables that meet on the order.
BY_ORDER = ("orders", "order_items", "order_payments", "order_reviews")


def _name(table: str) -> str:
    return f"clustered_{table}_{uuid4().hex}"


def write_clustered(df: DataFrame, path: str, table: str, by: str = "order_id", buckets: int = BUCKETS) -> DataFrame:
    """Write a table to ``path`` in sorted buckets, one file each, and read it from there."""
    name = _name(table)
    dealt = df.select(*SCHEMAS[table].fieldNames()).repartition(buckets, by)
    writer = dealt.write.format("parquet").option("compression", COMPRESSION).mode("overwrite")
    writer.bucketBy(buckets, by).sortBy(by).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def read_clustered(spark: SparkSession, path: str, table: str, by: str = "order_id", buckets: int = BUCKETS) -> DataFrame:
    """A table that ``write_clustered`` wrote with the same key and number of buckets, in any session."""
    name = _name(table)
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SCHEMAS[table].fields)
    spark.sql(f"create table {name} ({columns}) using parquet clustered by ({by}) sorted by ({by}) into {buckets} buckets location '{path}'")
    return spark.table(name)


def cluster_by_order(tables: Tables, folder: str, buckets: int = BUCKETS) -> Tables:
    """The tables with those that hold an order's rows clustered below ``folder``, and the others as they are."""
    frames = {
        t: write_clustered(df, f"{folder}/{t}", t, buckets=buckets) if t in BY_ORDER else df for t, df in tables.present().items()
    }
    return Tables(**frames)
