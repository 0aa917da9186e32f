"""One batch of changes from end to end: row rules, change log, audit log, tables, publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradebook.operators.apply import apply_changes
from tradebook.operators.audit import describe_changes
from tradebook.operators.rules import QUARANTINE, RuleOptions, accepted_changes, apply_rules
from tradebook.schema import combined
from tradebook.sources.store import Store


def now(spark: SparkSession) -> Column:
    """The session's time in whole seconds, fixed once so that all jobs of a batch agree on it."""
    text = spark.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")).first()[0]
    return F.lit(text).cast("timestamp_ntz")


def check_changes(
    changes: DataFrame,
    table: str,
    as_of: Column,
    options: RuleOptions = RuleOptions(),
    mode: str = QUARANTINE,
    audit_limit: int | None = None,
) -> DataFrame:
    """Cleansed changes with ``reason``, ``action_desc`` and ``logged``."""
    return describe_changes(apply_rules(changes, table, as_of, options, mode), table, audit_limit)


def settle(
    contents: DataFrame, changes: DataFrame, table: str, as_of: Column, options: RuleOptions = RuleOptions()
) -> tuple[DataFrame, DataFrame]:
    """A table after a change frame, as a batch would leave it, and the checked changes."""
    checked = check_changes(changes, table, as_of, options)
    return apply_changes(contents, accepted_changes(checked), table), checked


def run_batch(
    store: Store,
    changes: dict[str, DataFrame],
    batch_id: str,
    as_of: Column | None = None,
    rewrite: bool = False,
    options: RuleOptions = RuleOptions(),
    mode: str = QUARANTINE,
    audit_limit: int | None = None,
) -> bool:
    """Check, log and audit the changes of some tables; False if the batch was done before or names no table.

    The checked changes of all tables are written by one job and everything after reads them from there, so the
    rules run once and a lost executor costs no more than its own tasks. All tables show the batch at the same moment.
    They are left as they are, and readers see the logged changes on top; with ``rewrite`` the buckets that
    hold touched keys are read and written anew, with all that was logged for them before.
    """
    if not changes or store.is_done(batch_id):
        return False
    if as_of is None:
        as_of = now(store.spark)
    batch = store.last() + 1
    named = {"batch_id": F.lit(batch_id), "action_date": as_of}
    checked = {t: check_changes(df, t, as_of, options, mode, audit_limit).withColumns(named) for t, df in changes.items()}
    store.write_changes(combined(checked), batch)
    buckets = {t: store.rewrite(t, batch, store.touched(t, batch)) if rewrite else [] for t in changes}
    store.publish(batch, batch_id, buckets)
    return True


def rewrite_table(store: Store, table: str, batch_id: str) -> bool:
    """Write all of a table anew, with all logged batches."""
    if store.is_done(batch_id):
        return False
    batch = store.last() + 1
    store.publish(batch, batch_id, {table: store.rewrite(table, batch)})
    return True
