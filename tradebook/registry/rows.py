"""Row rules on whole-table batches: ``cleanse_<t>`` for inserts, ``validate_<t>`` for updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradebook.operators.rules import apply_rules
from tradebook.schema import SCHEMAS
from tradebook.sources.testdata import AS_OF, insert_batch, oracle, update_batch

RULED_TABLES = ("customers", "sellers", "order_items", "order_payments", "products", "orders", "geolocation")


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def _checked(table, make_batch):
    def query(spark, sf_dir):
        return apply_rules(make_batch(spark, sf_dir, table), table, as_of()).select("seq", "new.*", "reason")

    return query


QUERIES = {f"cleanse_{t}": _checked(t, insert_batch) for t in RULED_TABLES}
QUERIES |= {f"validate_{t}": _checked(t, update_batch) for t in RULED_TABLES}


def _measures(prefix: str) -> dict[str, str]:
    names = [c for c in SCHEMAS["products"].fieldNames() if c not in ("product_id", "product_category_name")]
    return {c: f"greatest({prefix}{c}, -{prefix}{c})" for c in names}


def _outside(prefix: str) -> str:
    return f"""case when abs({prefix}geolocation_lat) > 90
            then 'Latitude out of range: value must be within -90 and 90 degrees'
        when abs({prefix}geolocation_lng) > 180
            then 'Longitude out of range: value must be within -180 and 180 degrees' end"""


_NO_REASON = "cast(null as varchar)"

# Table -> columns with another value, and the reason.
INSERT_SQL = {
    "customers": ({"customer_state": "upper(customer_state)"}, _NO_REASON),
    "sellers": ({"seller_state": "upper(seller_state)"}, _NO_REASON),
    "order_items": (
        {c: f"cast(if({c} < 0, 0, {c}) as decimal(10,2))" for c in ("price", "freight_value")},
        _NO_REASON,
    ),
    "order_payments": (
        {
            "payment_sequential": "if(payment_sequential < 0, 1, payment_sequential)",
            "payment_installments": "if(payment_installments < 0, 1, payment_installments)",
            "payment_value": "cast(if(payment_value < 0, 0, payment_value) as decimal(10,2))",
        },
        _NO_REASON,
    ),
    "products": (_measures(""), _NO_REASON),
    "orders": (
        {
            "order_status": "ifnull(order_status, 'invoiced')",
            "order_purchase_timestamp": f"ifnull(order_purchase_timestamp, timestamp '{AS_OF}')",
            "order_estimated_delivery_date": "ifnull(order_estimated_delivery_date, timestamp '2024-06-08 00:00:00')",
        },
        _NO_REASON,
    ),
    "geolocation": ({"geolocation_state": "upper(geolocation_state)"}, _outside("")),
}

_MOVED = """(({old}{t}_zip_code_prefix <> {new}{t}_zip_code_prefix) is true
    or ({old}{t}_city <> {new}{t}_city) is true or ({old}{t}_state <> upper({new}{t}_state)) is true)"""
_CUSTOMER_MOVED = _MOVED.format(old="old_", new="new_", t="customer")
_SELLER_MOVED = _MOVED.format(old="old_", new="new_", t="seller")


def _to_null(column: str) -> str:
    return f"(old_{column} is not null and new_{column} is null)"


# When an update of an order sets a date to NULL.
ORDER_DATE_SQL = f"""when {_to_null("order_approved_at")} or {_to_null("order_delivered_carrier_date")}
    or {_to_null("order_delivered_customer_date")} then 'Cannot set date to null'"""

UPDATE_SQL = {
    "customers": (
        {"customer_state": "upper(new_customer_state)"},
        f"""case when new_customer_unique_id is null then 'Update to unique ID cannot be empty'
            when {_CUSTOMER_MOVED} and (new_customer_zip_code_prefix is null or new_customer_city is null
                                        or new_customer_state is null)
            then 'Update to geolocation fields cannot be partially empty' end""",
    ),
    "sellers": (
        {"seller_state": "upper(new_seller_state)"},
        f"""case when {_SELLER_MOVED} and (old_seller_zip_code_prefix is null or old_seller_city is null
                                           or old_seller_state is null)
            then 'Update to geolocation fields cannot be partially empty' end""",
    ),
    "order_items": (
        {},
        """case when new_freight_value < 0 or new_price < 0
            then 'Cannot set negative value for freight value and price' end""",
    ),
    "order_payments": (
        {},
        """case when new_payment_installments < 0 or new_payment_value < 0
            then 'Cannot put negative values in installment and value' end""",
    ),
    "products": (_measures("new_"), _NO_REASON),
    "orders": (
        {},
        f"""case {ORDER_DATE_SQL}
            when lower(new_order_status) not in ('delivered','shipped','cancelled','unavailable','invoiced')
            then 'Incorrect status message' end""",
    ),
    "geolocation": (
        {"geolocation_state": "upper(new_geolocation_state)"},
        f"""case when new_geolocation_zip_code_prefix is null or new_geolocation_lat is null
                or new_geolocation_lng is null or new_geolocation_city is null or new_geolocation_state is null
            then '1 or more fields cannot be empty' else {_outside("new_")} end""",
    ),
}


def insert_sql(table: str) -> str:
    """Checked insert batch: seq, the cleansed columns and the reason."""
    values, reason = INSERT_SQL.get(table, ({}, _NO_REASON))
    columns = ", ".join(f"{values.get(c, c)} as {c}" for c in SCHEMAS[table].fieldNames())
    return f"select seq, {columns}, {reason} as reason from i_{table}"


def update_sql(table: str, old_images: bool = False) -> str:
    """Checked update batch; with ``old_images`` also the ``old_`` columns."""
    values, reason = UPDATE_SQL.get(table, ({}, _NO_REASON))
    names = SCHEMAS[table].fieldNames()
    columns = [f"{values.get(c, 'new_' + c)} as {c}" for c in names]
    columns += [f"old_{c}" for c in names if old_images]
    return f"select seq, {', '.join(columns)}, {reason} as reason from u_{table}"


ORACLES = {f"cleanse_{t}": oracle(insert_sql(t)) for t in RULED_TABLES}
ORACLES |= {f"validate_{t}": oracle(update_sql(t)) for t in RULED_TABLES}
