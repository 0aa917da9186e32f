"""Batches and streams of changes that write to a store: contents and audit rows afterwards."""

from __future__ import annotations

from tradebook.plans.batch import run_batch
from tradebook.registry.audits import all_audit_sql
from tradebook.registry.rows import as_of, update_sql
from tradebook.schema import SCHEMAS, combined, combined_schema
from tradebook.sources.files import COMPRESSION, scratch_path
from tradebook.sources.store import Store
from tradebook.sources.testdata import all_changes, load_tables, oracle, update_batch
from tradebook.streaming import stream_changes

#: The change files are taken up in so many micro-batches.
MICRO_BATCHES = 2


def stream_all(spark, sf_dir) -> Store:
    """Write the change batches of all tables as files and take them into a store by one stream."""
    root = scratch_path(spark, "stream")
    store, source = Store(spark, f"{root}/store"), f"{root}/incoming"
    combined({t: all_changes(spark, sf_dir, t) for t in SCHEMAS}).write.option("compression", COMPRESSION).parquet(source)
    files = len(spark.read.schema(combined_schema()).parquet(source).inputFiles())
    stream_changes(store, source, f"{root}/progress", as_of=as_of(), files_per_batch=-(-files // MICRO_BATCHES)).awaitTermination()
    return store


def _stream_audit_rows(spark, sf_dir):
    return stream_all(spark, sf_dir).audit_log().select("at_table", "action_desc", "action_date", "seq")


def _batch_contents(spark, sf_dir):
    """The orders after a batch of updates of the whole table, read back from the store."""
    store = Store.create(scratch_path(spark, "batch"), load_tables(spark, sf_dir, "orders"))
    run_batch(store, {"orders": update_batch(spark, sf_dir, "orders")}, "b1", as_of(), rewrite=True)
    return store.contents("orders")


def _logged_contents(spark, sf_dir):
    """The sellers when a batch is logged on top of their files but not yet written into them."""
    store = Store.create(scratch_path(spark, "batch"), load_tables(spark, sf_dir, "sellers"))
    run_batch(store, {"sellers": update_batch(spark, sf_dir, "sellers")}, "b1", as_of())
    return store.contents("sellers")


def _updated_sql(table: str, key: str) -> str:
    columns = ", ".join(f"case when u.reason is null then u.{c} else t.{c} end as {c}" for c in SCHEMAS[table].fieldNames())
    return f"select {columns} from x_{table} t join ({update_sql(table)}) u on t.{key} = u.{key}"


QUERIES = {
    "stream_audit_rows": _stream_audit_rows,
    "batch_contents": _batch_contents,
    "batch_logged_contents": _logged_contents,
}
ORACLES = {
    "batch_contents": oracle(_updated_sql("orders", "order_id")),
    "batch_logged_contents": oracle(_updated_sql("sellers", "seller_id")),
    "stream_audit_rows": oracle(
        f"select at_table, action_desc, action_date, seq from ({all_audit_sql(*SCHEMAS)}) log"
    )
}
