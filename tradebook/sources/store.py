"""A store of the base tables, the log of their changes and their audit rows, as partitioned Parquet below one folder.

======================================= ====================================================================
``changes/batch=<n>/at_table=<t>``      checked changes of a batch, of all its tables
``audit_log/batch=<n>/at_table=<t>``    audit rows of a batch
``tables/<t>/batch=<n>/bucket=<b>``     rows of a table whose key falls into a bucket, as a batch left them
``published/batch=<n>``                 the tables of a batch and the buckets that it wrote anew
======================================= ====================================================================

A batch writes below its own number only, and overwrites what an unfinished run left there. It is seen in all its tables
at once when its ``published`` rows appear, which are written last. Logged changes are put on top of a bucket until it is written
anew. One writer at a time.
"""

from __future__ import annotations

from collections import defaultdict
from contextlib import contextmanager
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradebook.operators.apply import apply_changes
from tradebook.schema import AUDIT_SCHEMA, KEYS, SCHEMAS, Tables, combined_schema
from tradebook.sources.files import COMPRESSION, LOOKUP, write_table

BUCKETS = 16
INITIAL_BATCH = "initial"
_PUBLISHED = "batch long, batch_id string, at_table string, buckets array<int>"
_LOG = combined_schema("reason STRING, action_desc STRING, logged BOOLEAN, batch_id STRING, action_date TIMESTAMP_NTZ")


def bucket_of(table: str, buckets: int, image: str | None = None) -> Column:
    """The bucket of a row, by its key or, without one, by all its values; of an image of a change where one is named."""
    names = KEYS[table] or SCHEMAS[table].fieldNames()
    return F.pmod(F.xxhash64(*[F.col(image)[n] if image else F.col(n) for n in names]), F.lit(buckets)).cast("int")


@contextmanager
def _log_settings(spark: SparkSession):
    """Settings of a session while the log is written, put back afterwards.

    Writers of several partitions at once, so that rows need not be sorted by them; no task has more than these. And all rules
    and texts of a table would become one method, which the JVM leaves uncompiled beyond 8,000 bytes: they are split up.
    """
    wanted = {"spark.sql.maxConcurrentOutputFileWriters": str(len(SCHEMAS)), "spark.sql.codegen.hugeMethodLimit": "8000"}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    @classmethod
    def create(cls, root: str, tables: Tables, buckets: int = BUCKETS) -> Store:
        """A store that begins with the given tables."""
        frames = tables.present()
        store = cls(next(iter(frames.values())).sparkSession, root, buckets)
        for table, df in frames.items():
            store._write_buckets(df, table, 0)
        store.publish(0, INITIAL_BATCH, dict.fromkeys(frames, list(range(buckets))))
        return store

    # --- batches

    def _read(self, folder: str, schema: T.StructType | str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{folder}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def published(self) -> DataFrame:
        return self._read("published", _PUBLISHED)

    def last(self) -> int:
        """Number of the last published batch, -1 before the first."""
        return self.published().agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]

    def is_done(self, batch_id: str) -> bool:
        return not self.published().where(F.col("batch_id") == batch_id).isEmpty()

    def publish(self, batch: int, batch_id: str, buckets: dict[str, list[int]]) -> None:
        """Show a batch: its tables, with the buckets that were written anew."""
        rows = self.spark.createDataFrame([(batch_id, t, b) for t, b in buckets.items()], "batch_id string, at_table string, buckets array<int>")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/published/batch={batch}")

    def write_changes(self, checked: DataFrame, batch: int) -> None:
        """Log the checked changes of a batch (``combined``) and the audit rows of the accepted ones."""
        for folder, df in (("changes", checked), ("audit_log", None)):
            if df is None:
                accepted = self._read("changes", self._with_batch(_LOG)).where((F.col("batch") == batch) & F.col("reason").isNull() & F.col("logged"))
                df = accepted.select(*AUDIT_SCHEMA.fieldNames())
            with _log_settings(df.sparkSession):
                writer = df.write.mode("overwrite").partitionBy("at_table").option("compression", COMPRESSION)
                writer.parquet(f"{self.root}/{folder}/batch={batch}")

    def _write_buckets(self, df: DataFrame, table: str, batch: int) -> None:
        """Rows of some buckets. Spark deals them over tasks by bucket, and splits the buckets that are large."""
        dealt = df.withColumn("bucket", bucket_of(table, self.buckets)).hint("rebalance", "bucket")
        write_table(dealt, f"{self.root}/tables/{table}/batch={batch}", ("bucket",), lookup=LOOKUP.get(table, ()))

    def touched(self, table: str, batch: int) -> list[int]:
        """Buckets that hold keys of a batch's accepted changes; all for a table without a key, whose copies are counted."""
        if not KEYS[table]:
            return list(range(self.buckets))
        images = [F.when(F.col(i).isNotNull(), bucket_of(table, self.buckets, i)) for i in ("old", "new")]
        changes = self._logged(table).where((F.col("version") == batch) & F.col("reason").isNull())
        return sorted(r[0] for r in changes.select(F.explode(F.array(*images)).alias("b")).where("b is not null").distinct().collect())

    def rewrite(self, table: str, batch: int, only: list[int] | None = None) -> list[int]:
        """Write some buckets (all by default) anew with everything logged up to a batch; which they are."""
        only = list(range(self.buckets)) if only is None else only
        if only:
            self._write_buckets(self.contents(table, only, batch), table, batch)
        return only

    # --- reading

    @staticmethod
    def _with_batch(schema: T.StructType, name: str = "batch") -> T.StructType:
        return T.StructType([*schema.fields, T.StructField(name, T.LongType())])

    def _logged(self, table: str) -> DataFrame:
        """All logged changes of a table, published or not; ``version`` is the number of their batch."""
        log = self._read("changes", self._with_batch(_LOG)).where(F.col("at_table") == table)
        return log.select("op", "seq", f"{table}.old", f"{table}.new", "reason", "action_desc", "logged", "batch_id", F.col("batch").alias("version"))

    def contents(self, table: str, only: list[int] | None = None, upto: int | None = None) -> DataFrame:
        """A table with all published batches, or with those ``upto`` a number; the rows of some buckets, if these are given.

        Of the table's files only the newest of each wanted bucket are opened, of the log only later batches.
        """
        shown = self.last()
        last = shown if upto is None else upto
        own = self.published().where((F.col("at_table") == table) & (F.col("batch") <= last))
        newest = {r.bucket: r.batch for r in own.select("batch", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.max("batch").alias("batch")).collect()}
        files = defaultdict(list)
        for bucket, batch in newest.items():
            if only is None or bucket in only:
                files[batch].append(bucket)
        names = SCHEMAS[table].fieldNames()
        schema = T.StructType([*self._with_batch(SCHEMAS[table]).fields, T.StructField("bucket", T.IntegerType())])
        wanted = [(F.col("batch") == batch) & F.col("bucket").isin(sorted(b)) for batch, b in files.items()]
        contents = self._read(f"tables/{table}", schema).where(reduce(Column.__or__, wanted, F.lit(False))).select(*names)
        first = min(files, default=-1)
        # A batch that wrote its touched buckets anew has nothing left to put on top; one still to be published may.
        waiting = own.where(F.size("buckets") == 0).agg(F.max("batch")).first()[0]
        if last <= shown and (waiting is None or waiting <= first):
            return contents
        pending = self._logged(table).where((F.col("version") > first) & (F.col("version") <= last) & F.col("reason").isNull())
        # A bucket newer than the first already has some of these changes; the last image of a key is the same again.
        after = apply_changes(contents, pending, table, order=("version", "seq"))
        return after if only is None else after.where(bucket_of(table, self.buckets).isin(only))

    def tables(self, *names: str) -> Tables:
        return Tables(**{name: self.contents(name) for name in names or SCHEMAS})

    def change_log(self, table: str) -> DataFrame:
        """All published changes of a table with the reason of refused ones and the audit text."""
        return self._logged(table).where(F.col("version") <= self.last())

    def rejected(self, table: str) -> DataFrame:
        return self.change_log(table).where(F.col("reason").isNotNull()).drop("action_desc", "logged")

    def audit_log(self, *tables: str) -> DataFrame:
        """The audit rows of published batches, of some tables or all; ``version`` is the number of the batch."""
        log = self._read("audit_log", self._with_batch(AUDIT_SCHEMA)).where(F.col("batch") <= self.last())
        log = log.where(F.col("at_table").isin(*tables)) if tables else log
        return log.withColumnRenamed("batch", "version")
