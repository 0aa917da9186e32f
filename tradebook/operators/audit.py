"""Audit rows written from the old and new images of a change.

The texts are templates, turned into one column expression per table.
"""

from __future__ import annotations

from functools import reduce
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradebook import fixed
from tradebook.operators.rules import DELETE, INSERT, UPDATE, any_of, differs, differs_null_safe
from tradebook.schema import SCHEMAS

# Tables whose update messages take NULL as a value of its own when comparing images.
_NULL_SAFE_MESSAGES = ("products",)
# Tables that log an update whose images differ null-safely, even when no message results.
_NULL_SAFE_ROWS = ("orders",)
# Tables that log every update.
_ALWAYS_LOGGED = ("customers", "geolocation", "product_category_name_translation")

_TOO_LONG = "Data too long for column 'action_desc'"


def _text(table: str, reference: str) -> Column:
    """A column of an image as text; a coordinate in the shortest decimals that give it whole."""
    image, name = reference.split(".")
    value = F.col(image)[name]
    if isinstance(SCHEMAS[table][name].dataType, T.DoubleType):
        value = F.regexp_replace(value.cast("string").cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
    return value.cast("string")


def _fill(table: str, template: str) -> Column:
    """The template with values put in; NULL as soon as one of them is NULL."""
    parts: list[Column] = []
    for literal, reference, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if reference:
            parts.append(_text(table, reference))
    return F.concat(*parts)


def _known(template: str) -> Column:
    """Whether all values of a template are known."""
    names = [reference.split(".") for _, reference, _, _ in Formatter().parse(template) if reference]
    return reduce(Column.__and__, [F.col(image)[name].isNotNull() for image, name in names], F.lit(True))


def _update_text(table: str) -> tuple[Column, Column]:
    """The text for an update and whether the update is logged."""
    old, new = F.col("old"), F.col("new")
    messages = fixed.AUDIT_UPDATE_MESSAGES[table]
    compare = differs_null_safe if table in _NULL_SAFE_MESSAGES else differs
    filled = [F.when(compare(old, new, columns), _fill(table, text)) for columns, text in messages]
    head = [_fill(table, part) for part in fixed.AUDIT_UPDATE_HEAD[table]]
    text = F.concat_ws(",", *head, *filled)
    if table in _ALWAYS_LOGGED:
        return text, F.lit(True)
    if table in _NULL_SAFE_ROWS:
        compared = tuple(c for columns, _ in messages for c in columns)
        return text, differs_null_safe(old, new, compared)
    # Whether some message results, without making the texts a second time: none of these tables has a coordinate.
    return text, any_of([compare(old, new, columns) & _known(message) for columns, message in messages])


def describe_changes(changes: DataFrame, table: str, limit: int | None = None) -> DataFrame:
    """Add ``action_desc`` and ``logged`` to checked changes.

    Texts may have any length. With a ``limit``, such as that of a store's column, a change whose text is longer is
    refused like one that breaks a rule; the text is never cut.
    """
    update_text, update_logged = _update_text(table)
    is_update = F.col("op") == UPDATE
    text = (
        F.when(F.col("op") == INSERT, _fill(table, fixed.AUDIT_INSERT[table]))
        .when(is_update, update_text)
        .when(F.col("op") == DELETE, _fill(table, fixed.AUDIT_DELETE[table]))
    )
    described = changes.withColumn("action_desc", text).withColumn(
        "logged", F.when(is_update, update_logged).otherwise(True)
    )
    if limit is not None:
        too_long = F.when(F.col("logged") & (F.char_length("action_desc") > limit), _TOO_LONG)
        described = described.withColumn("reason", F.coalesce("reason", too_long))
    return described


def audit_rows(described: DataFrame, table: str, as_of: Column, batch_id: str) -> DataFrame:
    """The audit rows of the accepted changes.

    As with the accepted changes, a filter would have the texts built a second time.
    """
    row = F.struct(
        F.lit(table).alias("at_table"),
        F.col("action_desc"),
        as_of.alias("action_date"),
        F.lit(batch_id).alias("batch_id"),
        F.col("seq"),
    )
    accepted = F.col("reason").isNull() & F.col("logged")
    return described.select(F.inline(F.when(accepted, F.array(row)).otherwise(F.array())))


def audit_of_table(audit_log: DataFrame, table: str) -> DataFrame:
    return audit_log.where(F.col("at_table") == table)


def latest_audit_rows(audit_log: DataFrame) -> DataFrame:
    """The last audit row of each table in a log as its store keeps it, by the number of the batch and of the change.

    The newest batch of a table comes from the values of the log's partitions; no other batch's rows are read. The text
    decides between rows of one change number. The greatest numbers are found first, by a hash aggregate: for the greatest struct with a
    text Spark sorts what it is given, which then is no more than the rows of these numbers.
    """
    newest = audit_log.groupBy("at_table").agg(F.max("version").alias("version")).collect()  # a row per table
    wanted = [(F.col("at_table") == r.at_table) & (F.col("version") == r.version) for r in newest]
    rows = audit_log.where(reduce(Column.__or__, wanted, F.lit(False)))
    numbers = rows.groupBy("at_table").agg(F.max("seq").alias("seq")).collect()
    ends = [(F.col("at_table") == r.at_table) & F.col("seq").eqNullSafe(F.lit(r.seq).cast("bigint")) for r in numbers]
    order = ["seq", "action_desc"]
    last = F.max(F.struct(*order, *[c for c in audit_log.columns if c not in (*order, "at_table")])).alias("last")
    ended = rows.where(reduce(Column.__or__, ends, F.lit(False)))
    return ended.groupBy("at_table").agg(last).select("at_table", "last.*").select(*audit_log.columns)


def latest_audit_row(audit_log: DataFrame, table: str) -> DataFrame:
    """The last audit row of one table."""
    return latest_audit_rows(audit_of_table(audit_log, table))
