"""Reading and writing the base tables as files, with their schemas given, never inferred."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from tradebook.schema import SCHEMAS, Tables

CSV_OPTIONS = {"header": "true", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss", "escape": '"'}
#: Tables whose text may have line ends. Their csv files can't be split, so other tables are read without.
MULTI_LINE = ("order_reviews",)
#: Of Parquet files and of text files, which are several times the size without.
COMPRESSION, TEXT_COMPRESSION = "zstd", "gzip"
#: A compressed text file is read by one task.
RECORDS_PER_TEXT_FILE = 1_000_000
#: Columns by which rows of a table are looked up.
LOOKUP = {
    "customers": ("customer_id", "customer_city"),
    "sellers": ("seller_id",),
    "orders": ("order_id", "customer_id"),
    "order_items": ("order_id", "product_id", "seller_id"),
    "order_payments": ("order_id",),
    "order_reviews": ("order_id", "review_id"),
    "products": ("product_id", "product_category_name"),
}


def read_table(
    spark: SparkSession, path: str, table: str, file_format: str = "parquet", multi_line: bool | None = None
) -> DataFrame:
    """One base table; csv columns are taken by position, whatever the header calls them.

    ``multi_line`` says whether values in csv files may have line ends; such a file is read by one task.
    """
    reader = spark.read.schema(SCHEMAS[table])
    if file_format == "csv":
        lines = table in MULTI_LINE if multi_line is None else multi_line
        reader = reader.options(**CSV_OPTIONS, multiLine=str(lines).lower())
    return reader.format(file_format).load(path)


def read_tables(spark: SparkSession, paths: dict[str, str], file_format: str = "parquet") -> Tables:
    return Tables(**{table: read_table(spark, path, table, file_format) for table, path in paths.items()})


def write_table(
    df: DataFrame, path: str, partition_by: tuple[str, ...] = (), file_format: str = "parquet", lookup: tuple[str, ...] = ()
) -> None:
    """Replace the files at ``path``, which must not be one that ``df`` reads.

    Parquet files written for ``lookup`` have their rows in the order of its first column, so that few row groups span a
    given value, and a bloom filter on each of its columns, by which a reader skips row groups that lack the value.
    """
    if lookup:
        df = df.sortWithinPartitions(*partition_by, *lookup)
    writer = df.write.mode("overwrite").format(file_format).partitionBy(*partition_by)
    writer = writer.options(**{f"parquet.bloom.filter.enabled#{column}": "true" for column in lookup})
    if file_format == "parquet":
        writer = writer.option("compression", COMPRESSION)
    if file_format in ("csv", "json"):
        writer = writer.option("compression", TEXT_COMPRESSION).option("maxRecordsPerFile", RECORDS_PER_TEXT_FILE)
    if file_format == "csv":
        # Values keep the blanks and line ends that they begin or end with.
        blanks = {f"ignore{side}WhiteSpace": "false" for side in ("Leading", "Trailing")}
        writer = writer.options(header="true", escape='"', timestampNTZFormat=CSV_OPTIONS["timestampNTZFormat"], **blanks)
    writer.save(path)


def converted(spark: SparkSession, path: str, table: str, to: str, file_format: str = "csv", records_per_file: int = 1_000_000) -> DataFrame:
    """A table of text files once rewritten as Parquet at ``to``, and read from there.

    A csv file whose values have line ends is read by one task, each time anew. The conversion deals its records over
    all tasks, so that later reads are split over files and row groups, with column pruning and pushed filters.
    """
    records = read_table(spark, path, table, file_format)
    records.hint("rebalance").write.mode("overwrite").option("maxRecordsPerFile", records_per_file).parquet(to)
    return read_table(spark, to, table)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    It is the one the cluster names in ``spark.checkpoint.dir``. A session that names none, as
    in local tests, gets a temporary folder of its own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tradebook-")
        context.setCheckpointDir(named)
    elif context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid4().hex}"
