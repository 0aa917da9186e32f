"""Row rules, audit and change log on changes as they arrive."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tradebook.operators.rules import RuleOptions
from tradebook.plans.batch import run_batch
from tradebook.schema import SCHEMAS, combined_schema, split
from tradebook.sources.store import Store

#: What makes a path a pattern of paths.
_PATTERN = r"[\[\]{}*?\\]"


def stream_changes(
    store: Store,
    source: str,
    checkpoint: str,
    as_of: Column | None = None,
    rewrite_every: int | None = 100,
    options: RuleOptions = RuleOptions(),
    files_per_batch: int | None = None,
    bytes_per_batch: str | None = None,
    follow: bool = False,
    trigger: str = "10 seconds",
    audit_limit: int | None = None,
    name: str = "changes",
) -> StreamingQuery:
    """Process the files of combined changes (``schema.combined``) that land in ``source``, of all tables in one stream.

    A micro-batch is one batch of the store. The stream itself reads no more than the names of its tables and files; each table's
    changes are then read from these files, its own columns alone, so that nothing is held in memory. Its changes are seen in all their tables and
    in the audit log together, or not at all. The batch is named after the stream and its number, so a repeated micro-batch
    replaces its own output or does nothing. By default the stream ends when all present files are done; ``follow=True`` keeps it
    waiting for more, looking every ``trigger``. Without ``as_of`` every micro-batch takes the time at which it
    runs. Each ``rewrite_every``-th one writes the touched buckets of its tables anew, so that readers never have
    many logged batches to put on top. A change of a table that there is not ends the stream.
    """
    reader = store.spark.readStream.schema(combined_schema())
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if bytes_per_batch is not None:
        reader = reader.option("maxBytesPerTrigger", bytes_per_batch)

    pattern = re.search(_PATTERN, source)
    incoming = reader.parquet(source)
    if not pattern:
        incoming = incoming.select("at_table", F.col("_metadata.file_path").alias("file"))

    def changes_of(batch: DataFrame, present: list[str]) -> dict[str, DataFrame]:
        if pattern:  # no folder that the files' own partitions could be told from
            return split(batch, *present)
        files = batch.groupBy("at_table").agg(F.collect_set("file").alias("files")).collect()  # a row for each table
        tables = {}
        for row in sorted(files):
            paths = [re.sub(_PATTERN, r"\\\g<0>", unquote(file)) for file in sorted(row.files)]
            read = store.spark.read.schema(combined_schema()).option("basePath", source).parquet(*paths)
            tables |= split(read, row.at_table)
        return tables

    def process(batch: DataFrame, number: int) -> None:
        present = [r[0] for r in batch.select("at_table").distinct().limit(len(SCHEMAS) + 1).collect()]
        if unknown := [t for t in present if t not in SCHEMAS]:
            raise ValueError(f"changes of unknown tables: {unknown}")
        rewrite = rewrite_every is not None and (number + 1) % rewrite_every == 0
        if present:
            run_batch(store, changes_of(batch, sorted(present)), f"{name}-{number:09d}", as_of, rewrite, options, audit_limit=audit_limit)

    writer = (
        incoming.writeStream.queryName(f"{name} from {source}")
        .foreachBatch(process)
        .option("checkpointLocation", checkpoint)
    )
    when = {"processingTime": trigger} if follow else {"availableNow": True}
    return writer.trigger(**when).start()
