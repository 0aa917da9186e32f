"""Row rules: how inserted and updated rows are cleansed, and which of them are refused.

A change frame has ``op`` (I, U or D), ``seq`` (order within the batch) and the row images
``old`` and ``new``. All rules are column expressions on one row: a batch of any size passes
through them in one projection, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradebook import fixed

INSERT, UPDATE, DELETE = "I", "U", "D"
QUARANTINE, FAIL = "quarantine", "fail"

Image = Column


@dataclass(frozen=True)
class RuleOptions:
    """Rules with more than one reading."""

    order_status_check: bool = True
    order_statuses: tuple[str, ...] = fixed.UPDATE_STATUSES
    # Which image of an updated seller must have all location fields: "old" or "new".
    seller_location_image: str = "old"


@dataclass(frozen=True)
class Assign:
    """Give a column of the new image another value."""

    column: str
    value: Callable[[Image], Column]
    ops: tuple[str, ...] = (INSERT, UPDATE)


@dataclass(frozen=True)
class Reject:
    """Refuse a row for which the condition is true; an unknown condition lets it pass."""

    reason: str
    when: Callable[[Image, Image], Column]
    ops: tuple[str, ...] = (UPDATE,)


Rule = Assign | Reject


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def differs(old: Image, new: Image, columns: tuple[str, ...]) -> Column:
    """True when some column has another known value; a change from or to NULL does not tell."""
    return F.coalesce(any_of([old[c] != new[c] for c in columns]), F.lit(False))


def differs_null_safe(old: Image, new: Image, columns: tuple[str, ...]) -> Column:
    return any_of([~old[c].eqNullSafe(new[c]) for c in columns])


def _any_null(image: Image, columns: tuple[str, ...]) -> Column:
    return any_of([image[c].isNull() for c in columns])


def _upper(column: str) -> Assign:
    return Assign(column, lambda new: F.upper(new[column]))


def _at_least(column: str, fallback: int) -> Assign:
    """Replace a negative inserted value."""
    return Assign(column, lambda new: F.when(new[column] < 0, fallback).otherwise(new[column]), (INSERT,))


def _outside(column: str, limit: int) -> Callable[[Image, Image], Column]:
    return lambda old, new: ~new[column].between(-limit, limit)


_CUSTOMER_PLACE = ("customer_zip_code_prefix", "customer_city", "customer_state")
_SELLER_PLACE = ("seller_zip_code_prefix", "seller_city", "seller_state")
_ORDER_DATES = ("order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date")
_GEO_COLUMNS = (
    "geolocation_zip_code_prefix",
    "geolocation_lat",
    "geolocation_lng",
    "geolocation_city",
    "geolocation_state",
)
_PRODUCT_MEASURES = (
    "product_name_length",
    "product_description_length",
    "product_photos_qty",
    "product_weight_g",
    "product_length_cm",
    "product_height_cm",
    "product_width_cm",
)


def _partial_place(columns: tuple[str, ...], image: str) -> Reject:
    return Reject(
        fixed.LOCATION_PARTIAL,
        lambda old, new: differs(old, new, columns) & _any_null(old if image == "old" else new, columns),
    )


def rules_of(table: str, as_of: Column, options: RuleOptions = RuleOptions()) -> list[Rule]:
    """The rules of a table in the order in which they apply; ``as_of`` stands for now."""
    if table == "customers":
        return [
            _upper("customer_state"),
            Reject(fixed.CUSTOMER_UNIQUE_ID_NULL, lambda old, new: new["customer_unique_id"].isNull()),
            _partial_place(_CUSTOMER_PLACE, "new"),
        ]
    if table == "sellers":
        return [_upper("seller_state"), _partial_place(_SELLER_PLACE, options.seller_location_image)]
    if table == "order_items":
        return [
            _at_least("freight_value", 0),
            _at_least("price", 0),
            Reject(fixed.ITEM_NEGATIVE, lambda old, new: (new["freight_value"] < 0) | (new["price"] < 0)),
        ]
    if table == "order_payments":
        return [
            _at_least("payment_sequential", 1),
            _at_least("payment_installments", 1),
            _at_least("payment_value", 0),
            Reject(
                fixed.PAYMENT_NEGATIVE,
                lambda old, new: (new["payment_installments"] < 0) | (new["payment_value"] < 0),
            ),
        ]
    if table == "products":
        return [Assign(c, lambda new, c=c: F.abs(new[c])) for c in _PRODUCT_MEASURES]
    if table == "orders":
        due = as_of + F.expr(f"INTERVAL {fixed.DEFAULT_DELIVERY_DAYS} DAYS")
        defaults = {
            "order_status": F.lit(fixed.STATUS_DEFAULT),
            "order_purchase_timestamp": as_of,
            "order_estimated_delivery_date": due,
        }
        rules: list[Rule] = [
            Assign(c, lambda new, c=c, default=default: F.coalesce(new[c], default), (INSERT,))
            for c, default in defaults.items()
        ]
        rules.append(
            Reject(
                fixed.ORDER_DATE_TO_NULL,
                lambda old, new: any_of([old[c].isNotNull() & new[c].isNull() for c in _ORDER_DATES]),
            )
        )
        if options.order_status_check:
            rules.append(
                Reject(
                    fixed.ORDER_STATUS_UNKNOWN,
                    lambda old, new: ~F.lower(new["order_status"]).isin(*options.order_statuses),
                )
            )
        return rules
    if table == "geolocation":
        both = (INSERT, UPDATE)
        return [
            _upper("geolocation_state"),
            Reject(fixed.GEO_FIELD_NULL, lambda old, new: _any_null(new, _GEO_COLUMNS)),
            Reject(fixed.LATITUDE_RANGE, _outside("geolocation_lat", fixed.LATITUDE_LIMIT), both),
            Reject(fixed.LONGITUDE_RANGE, _outside("geolocation_lng", fixed.LONGITUDE_LIMIT), both),
        ]
    return []


def apply_rules(
    changes: DataFrame,
    table: str,
    as_of: Column,
    options: RuleOptions = RuleOptions(),
    mode: str = QUARANTINE,
) -> DataFrame:
    """Cleanse the new images and add ``reason``, NULL for accepted rows.

    The first failing rule gives the reason. With ``mode="fail"`` such a row ends the job.
    """
    rules = rules_of(table, as_of, options)
    old, new = F.col("old"), F.col("new")
    for rule in rules:
        if isinstance(rule, Assign):
            value = rule.value(F.col("new"))
            if rule.ops != (INSERT, UPDATE):
                value = F.when(F.col("op").isin(*rule.ops), value).otherwise(F.col("new")[rule.column])
            kind = changes.schema["new"].dataType[rule.column].dataType
            new = new.withField(rule.column, value.cast(kind))
    cleansed = changes.withColumn("new", new)
    failures = [
        F.when(F.col("op").isin(*rule.ops) & rule.when(old, F.col("new")), rule.reason)
        for rule in rules
        if isinstance(rule, Reject)
    ]
    reason = F.coalesce(*failures) if failures else F.lit(None).cast("string")
    if mode == FAIL:
        reason = F.when(reason.isNotNull(), F.raise_error(reason).cast("string"))
    elif mode != QUARANTINE:
        raise ValueError(f"mode must be {QUARANTINE} or {FAIL}, not {mode!r}")
    return cleansed.withColumn("reason", reason)


def accepted_changes(checked: DataFrame) -> DataFrame:
    """The accepted part of checked changes as a change frame.

    Each change becomes no or one row instead of being filtered: Catalyst would move a filter
    below the projections and put all rules and cleansing into it a second time.
    """
    row = F.struct("op", "seq", "old", "new")
    return checked.select(F.inline(F.when(F.col("reason").isNull(), F.array(row)).otherwise(F.array())))
