"""Create, find, update and delete for sellers and orders, on whole batches of requests.

A request frame has a ``seq`` that is unique in its batch. Each operator splits the requests
into accepted and refused ones and says which rows change. What a table holds afterwards comes from
putting these changes through the row rules and applying them, in a batch or with ``plans.batch.settle``; where no
rule is wanted, ``Outcome.after`` has it in one pass over the table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradebook import fixed
from tradebook.operators.matching import byte_length_is_not, contains_pattern, is_blank
from tradebook.schema import SCHEMAS, Tables


@dataclass(frozen=True)
class Outcome:
    accepted: DataFrame
    # The refused requests with the reason.
    rejected: DataFrame
    # Change frames (op, seq, old, new) by table, for row rules and audit.
    changes: dict[str, DataFrame] = field(default_factory=dict)
    # The tables as the requests leave them, row rules aside, in one pass over each; not for new rows.
    after: dict[str, DataFrame] = field(default_factory=dict)


def _split(requests: DataFrame, *checks: tuple[Column, str]) -> tuple[DataFrame, DataFrame]:
    """Accepted and refused requests; the first failing check gives the reason."""
    reason = F.coalesce(*[F.when(failed, text) for failed, text in checks])
    checked = requests.withColumn("reason", reason)
    return checked.where(F.col("reason").isNull()).drop("reason"), checked.where(F.col("reason").isNotNull())


def _new_id(batch_id: str) -> Column:
    """A 32-character id that stays the same when a lost task is run again."""
    return F.md5(F.concat(F.lit(batch_id + ":"), F.col("seq").cast("string")))


def _image(table: str, values: dict[str, Column]) -> Column:
    fields = [values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMAS[table].fields]
    return F.struct(*fields)


def _nothing(table: str) -> Column:
    return F.lit(None).cast(SCHEMAS[table])


def _change(op: str, old: Column, new: Column) -> list[Column]:
    return [F.lit(op).alias("op"), F.col("seq").cast("bigint").alias("seq"), old.alias("old"), new.alias("new")]


def _last_given(values: dict[str, str], key: Column, requests: DataFrame) -> DataFrame:
    """One patch per key: of each value the last one that is given, as if patched in turn."""
    given = [F.max_by(v, F.when(F.col(v).isNotNull(), F.col("seq"))).alias(name) for name, v in values.items()]
    return requests.groupBy(key.alias("target")).agg(F.max("seq").alias("seq"), *given)


def _patch(contents: DataFrame, table: str, key: str, patch: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Change frame that puts the patch's values into the named columns where they are given, and the table after it."""
    patch = patch.select("target", "seq", *[F.col(c).alias(f"patch_{c}") for c in columns])
    names = SCHEMAS[table].fieldNames()
    patched = [
        (F.coalesce(F.col(f"patch_{c}"), F.col(c)) if c in columns else F.col(c)).alias(c) for c in names
    ]
    same = contents[key] == patch["target"]
    changes = contents.join(patch, same).select(*_change("U", F.struct(*names), F.struct(*patched)))
    return changes, contents.join(patch, same, "left").select(*patched)


def _left(contents: DataFrame, table: str, key: str, targets: DataFrame) -> DataFrame:
    """The table without the rows of the target ids."""
    return contents.select(*SCHEMAS[table].fieldNames()).join(targets, contents[key] == targets["target"], "left_anti")


def _remove(contents: DataFrame, table: str, key: str, targets: DataFrame) -> DataFrame:
    """Change frame that removes the rows of the target ids.

    An id may hold very many rows. AQE splits such an id in a join whose inputs both come
    straight from a shuffle, so the first requests pass a shuffle of their own before it.
    """
    first = targets.groupBy("target").agg(F.min("seq").alias("seq")).repartition("seq")
    removed = contents.join(first, contents[key] == first["target"])
    old = F.struct(*[contents[c] for c in SCHEMAS[table].fieldNames()])
    return removed.select(*_change("D", old, _nothing(table)))


def _filters_or_raise(blank_text: str, *values: str | None) -> None:
    if any(value is not None and value.strip(" ") == "" for value in values):
        raise ValueError(blank_text)


# --- sellers


def create_sellers(requests: DataFrame, batch_id: str) -> Outcome:
    """Add sellers from requests (seq, zip_code, city, state)."""
    accepted, rejected = _split(
        requests,
        (F.col("zip_code").isNull() | is_blank(F.col("zip_code")), fixed.SELLER_ZIP_MISSING),
        (F.col("city").isNull() | is_blank(F.col("city")), fixed.SELLER_CITY_MISSING),
        (byte_length_is_not(F.col("state"), fixed.STATE_BYTES), fixed.SELLER_STATE_INVALID),
    )
    accepted = accepted.withColumn("seller_id", _new_id(batch_id))
    image = _image(
        "sellers",
        {
            "seller_id": F.col("seller_id"),
            "seller_zip_code_prefix": F.trim("zip_code"),
            "seller_city": F.trim("city"),
            "seller_state": F.upper(F.trim("state")),
        },
    )
    return Outcome(accepted, rejected, {"sellers": accepted.select(*_change("I", _nothing("sellers"), image))})


def find_sellers(sellers: DataFrame, partial_id: str | None = None, state: str | None = None) -> DataFrame:
    """Sellers whose id contains a text and who are in a state; both filters are optional."""
    _filters_or_raise(fixed.SELLER_SEARCH_BLANK, partial_id, state)
    found = sellers.select("seller_id", "seller_zip_code_prefix", "seller_city", "seller_state")
    if state is not None:
        wanted = state.strip(" ")
        if len(wanted.encode()) != fixed.STATE_BYTES:
            raise ValueError(fixed.SELLER_SEARCH_STATE)
        found = found.where(F.col("seller_state") == F.upper(F.lit(wanted)))
    if partial_id is not None:
        found = found.where(contains_pattern("seller_id", partial_id))
    return found


def update_sellers(sellers: DataFrame, requests: DataFrame) -> Outcome:
    """Patch sellers from requests (seq, seller_id, new_zip_code, new_city, new_state)."""
    new_values = ("new_zip_code", "new_city", "new_state")
    blank = is_blank(F.col("new_zip_code")) | is_blank(F.col("new_city")) | is_blank(F.col("new_state"))
    accepted, rejected = _split(
        requests,
        (byte_length_is_not(F.col("seller_id"), fixed.ID_BYTES), fixed.SELLER_ID_INVALID),
        (blank, fixed.SELLER_PATCH_BLANK),
        (
            F.col("new_state").isNotNull() & byte_length_is_not(F.col("new_state"), fixed.STATE_BYTES),
            fixed.SELLER_PATCH_STATE,
        ),
    )
    trimmed = accepted.select("seq", "seller_id", *[F.trim(v).alias(v) for v in new_values]).withColumn(
        "new_state", F.upper("new_state")
    )
    columns = dict(zip(("seller_zip_code_prefix", "seller_city", "seller_state"), new_values))
    patch = _last_given(columns, F.trim("seller_id"), trimmed)
    changes, after = _patch(sellers, "sellers", "seller_id", patch, list(columns))
    return Outcome(accepted, rejected, {"sellers": changes}, {"sellers": after})


def delete_sellers(sellers: DataFrame, requests: DataFrame) -> Outcome:
    """Remove sellers by requests (seq, seller_id); an unknown id is accepted and changes nothing."""
    accepted, rejected = _split(
        requests, (byte_length_is_not(F.col("seller_id"), fixed.ID_BYTES), fixed.SELLER_DELETE_ID)
    )
    accepted = accepted.withColumn("status", F.format_string(fixed.SELLER_REMOVED, F.trim("seller_id")))
    targets = accepted.select(F.trim("seller_id").alias("target"), "seq")
    removed, left = _remove(sellers, "sellers", "seller_id", targets), _left(sellers, "sellers", "seller_id", targets)
    return Outcome(accepted, rejected, {"sellers": removed}, {"sellers": left})


# --- orders


def create_orders(customers: DataFrame, requests: DataFrame, as_of: Column, batch_id: str) -> Outcome:
    """Open orders from requests (seq, customer_id, estimated_delivery DATE)."""
    estimate = F.col("estimated_delivery")
    # Only requests that pass the checks on the row, which leaves out missing ids, ask for their customer.
    passing, rejected = _split(
        requests,
        (byte_length_is_not(F.col("customer_id"), fixed.ID_BYTES), fixed.ORDER_CUSTOMER_ID),
        (estimate.isNull() | (estimate < F.to_date(as_of)), fixed.ORDER_ESTIMATE),
    )
    # The asked-for ids go to the customer table, not the other way round: its rows are not
    # shuffled while the ids are few enough to be broadcast. The requests then only meet the
    # unknown ids, which pass a shuffle of their own, so that AQE can split the requests of one id.
    asked = passing.select(F.trim("customer_id").alias("asked_id")).distinct()
    known = customers.select("customer_id").join(asked, F.col("customer_id") == F.col("asked_id"), "left_semi")
    unknown = asked.join(known, F.col("asked_id") == F.col("customer_id"), "left_anti").repartition(F.xxhash64("asked_id"))
    same = F.trim("customer_id") == F.col("asked_id")
    stranger = passing.join(unknown, same, "left_semi").withColumn("reason", F.lit(fixed.ORDER_CUSTOMER_UNKNOWN))
    rejected = rejected.unionByName(stranger)
    accepted = passing.join(unknown, same, "left_anti").withColumn("order_id", _new_id(batch_id))
    image = _image(
        "orders",
        {
            "order_id": F.col("order_id"),
            "customer_id": F.trim("customer_id"),
            "order_status": F.lit(fixed.STATUS_CREATED),
            "order_purchase_timestamp": as_of,
            "order_estimated_delivery_date": estimate,
        },
    )
    return Outcome(accepted, rejected, {"orders": accepted.select(*_change("I", _nothing("orders"), image))})


def find_orders(
    orders: DataFrame,
    order_id: str | None = None,
    status: str | None = None,
    limit: int | None = fixed.FIND_ORDERS_LIMIT,
) -> DataFrame:
    """Orders by id and status, both optional; the first ones by id when there are many, all with ``limit=None``."""
    _filters_or_raise(fixed.ORDER_SEARCH_BLANK, order_id, status)
    found = orders.select(
        "order_id",
        "customer_id",
        "order_status",
        "order_purchase_timestamp",
        "order_delivered_customer_date",
        "order_estimated_delivery_date",
    )
    for column, value in (("order_id", order_id), ("order_status", status)):
        if value is not None:
            found = found.where(F.col(column) == value.strip(" "))
    return found.orderBy("order_id") if limit is None else found.orderBy("order_id").limit(limit)


def update_orders(orders: DataFrame, requests: DataFrame) -> Outcome:
    """Patch orders from requests (seq, order_id, new_status, delivered_date)."""
    accepted, rejected = _split(
        requests, (byte_length_is_not(F.col("order_id"), fixed.ID_BYTES), fixed.ORDER_PATCH_ID)
    )
    trimmed = accepted.select("seq", "order_id", F.trim("new_status").alias("new_status"), "delivered_date")
    columns = {"order_status": "new_status", "order_delivered_customer_date": "delivered_date"}
    patch = _last_given(columns, F.trim("order_id"), trimmed)
    changes, after = _patch(orders, "orders", "order_id", patch, list(columns))
    return Outcome(accepted, rejected, {"orders": changes}, {"orders": after})


CASCADE = ("order_reviews", "order_payments", "order_items", "orders")


def delete_orders_cascade(tables: Tables, requests: DataFrame) -> Outcome:
    """Remove orders with their reviews, payments and items by requests (seq, order_id)."""
    accepted, rejected = _split(
        requests, (byte_length_is_not(F.col("order_id"), fixed.ID_BYTES), fixed.ORDER_DELETE_ID)
    )
    accepted = accepted.withColumn("status", F.format_string(fixed.ORDER_REMOVED, F.trim("order_id")))
    targets = accepted.select(F.trim("order_id").alias("target"), "seq")
    removed = {t: _remove(getattr(tables, t), t, "order_id", targets) for t in CASCADE}
    return Outcome(accepted, rejected, removed, {t: _left(getattr(tables, t), t, "order_id", targets) for t in CASCADE})
