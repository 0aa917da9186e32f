"""Audit texts of whole-table batches: ``audit_<t>_insert``, ``_update`` and ``_delete``."""

from __future__ import annotations

from tradebook.operators.audit import audit_rows, describe_changes, latest_audit_rows
from tradebook.plans.batch import run_batch
from tradebook.operators.rules import apply_rules
from tradebook.registry.rows import as_of, insert_sql, update_sql
from tradebook.schema import SCHEMAS
from tradebook.sources.files import scratch_path
from tradebook.sources.testdata import AS_OF, all_changes, delete_batch, insert_batch, oracle, update_batch
from tradebook.sources.store import Store

BATCH_ID = "b1"
_BATCHES = {"insert": insert_batch, "update": update_batch, "delete": delete_batch}


def _audit(changes, table):
    described = describe_changes(apply_rules(changes, table, as_of()), table)
    return audit_rows(described, table, as_of(), BATCH_ID)


def _query(table, kind):
    return lambda spark, sf_dir: _audit(_BATCHES[kind](spark, sf_dir, table), table)


#: Stores by session and folder: a store is there to be read many times.
_STORES: dict[tuple[str, str], Store] = {}


def written_store(spark, sf_dir) -> Store:
    """A store after a batch with all changes of all tables and a later one of insertions, written once in a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        store = Store(spark, scratch_path(spark, "audit"))
        run_batch(store, {t: all_changes(spark, sf_dir, t) for t in SCHEMAS}, "b9", as_of())
        run_batch(store, {t: insert_batch(spark, sf_dir, t) for t in SCHEMAS}, "b10", as_of())
        _STORES[key] = store
    return _STORES[key]


def _audit_by_table(spark, sf_dir):
    return written_store(spark, sf_dir).audit_log("customers")


def _audit_latest(spark, sf_dir):
    return latest_audit_rows(written_store(spark, sf_dir).audit_log())


QUERIES = {f"audit_{t}_{kind}": _query(t, kind) for t in SCHEMAS for kind in _BATCHES}
QUERIES["audit_by_table"] = _audit_by_table
QUERIES["audit_latest"] = _audit_latest


def _coordinate(column: str) -> str:
    whole = f"cast(cast(cast({column} as varchar) as decimal(38,18)) as varchar)"
    return f"regexp_replace({whole}, '\\.?0+$', '')"


def _changed(column: str, label: str) -> str:
    """Label and new value where both images are known and differ."""
    return f"case when old_{column} <> {column} then '{label}' || cast({column} as varchar) end"


def _changed_null_safe(column: str, label: str) -> str:
    return f"case when old_{column} is distinct from {column} then '{label}' || cast({column} as varchar) end"


def _moved(t: str) -> str:
    fields = (f"{t}_zip_code_prefix", f"{t}_city", f"{t}_state")
    return "(" + " or ".join(f"ifnull(old_{f} <> {f}, false)" for f in fields) + ")"


def _place(t: str) -> str:
    return f"{t}_zip_code_prefix || ',' || {t}_city || ',' || {t}_state"


_INSERT_TEXT = {
    "customers": "'Added customer with id: ' || customer_id",
    "sellers": "'Added new seller: ' || seller_id",
    "order_items": "'Added new order id ' || order_id || 'with item id: ' || order_item_id",
    "order_payments": "'Added order payment: ' || order_id",
    "products": "'Added product id: ' || product_id",
    "orders": "'Added order: ' || order_id",
    "geolocation": f"""'New location added at ' || geolocation_city || ' with LAT/LON ' ||
        {_coordinate("geolocation_lat")} || '/' || {_coordinate("geolocation_lng")}""",
    "order_reviews": "'Added order review: ' || order_id",
    "product_category_name_translation": "'Added translation name: ' || product_category_name",
}
_DELETE_TEXT = {
    "customers": "'Deleted customer with the id: ' || customer_id",
    "sellers": "'Deleted seller: ' || seller_id",
    "order_items": "'Deleted order id ' || order_id || ' with item id: ' || order_item_id",
    "order_payments": "'Deleted order payment: ' || order_id",
    "products": "'Deleted product id: ' || product_id",
    "orders": "'Deleted order: ' || order_id",
    "geolocation": f"""'Deleted location at ' || geolocation_city || ' with LAT/LON of ' ||
        {_coordinate("geolocation_lat")} || '/' || {_coordinate("geolocation_lng")}""",
    "order_reviews": "'Deleted order review: ' || order_id",
    "product_category_name_translation": "'Deleted translation for ' || product_category_name",
}

_ORDER_PARTS = [
    _changed(c, "New status: ")
    for c in ("order_status", "order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date")
]
_ITEM_PARTS = [
    _changed("product_id", "Product id: "),
    _changed("seller_id", "Seller id: "),
    _changed("shipping_limit_date", "Due Date: "),
    _changed("price", "Price: "),
    _changed("freight_value", "Freight value: "),
]
_PAYMENT_PARTS = [
    _changed("payment_installments", "New installment: "),
    _changed("payment_value", "New value: "),
]
_PRODUCT_PARTS = [
    _changed_null_safe("product_category_name", "New category: "),
    _changed_null_safe("product_name_length", "New name length: "),
    _changed_null_safe("product_description_length", "New desc length: "),
    _changed_null_safe("product_photos_qty", "New photo quantity: "),
    _changed_null_safe("product_weight_g", "New weight: "),
    _changed_null_safe("product_length_cm", "New length: "),
    _changed_null_safe("product_height_cm", "New height: "),
    _changed_null_safe("product_width_cm", "New width: "),
]
_GEO_PARTS = [
    _changed("geolocation_zip_code_prefix", "ZIP Code updated: "),
    f"""case when old_geolocation_lat <> geolocation_lat
        then 'Latitude updated: ' || {_coordinate("geolocation_lat")} end""",
    f"""case when old_geolocation_lng <> geolocation_lng
        then 'Longitute updated: ' || {_coordinate("geolocation_lng")} end""",
    _changed("geolocation_city", "City updated: "),
    _changed("geolocation_state", "State updated: "),
]
_REVIEW_PARTS = [
    _changed("review_score", "New score:"),
    _changed("review_comment_title", "New title:"),
    _changed("review_comment_message", "New message:"),
    _changed("review_creation_date", "New creation date:"),
    _changed("review_answer_timestamp", "New answer timestamp:"),
]


def _joined(head: str, parts: list[str]) -> str:
    return f"concat_ws(',', {', '.join([head, *parts] if head else parts)})"


def _some(parts: list[str]) -> str:
    return f"coalesce({', '.join(parts)}) is not null"


# Table -> text of an update, condition under which it is logged.
_UPDATE_TEXT = {
    "customers": (
        f"""'Updated on ID ,' || old_customer_id || ',: ' ||
            case when old_customer_unique_id <> customer_unique_id
                 then ',Updated unique id: ' || old_customer_id else '' end ||
            case when {_moved("customer")} then coalesce(',Updated location: ' || {_place("customer")}, '')
                 else '' end""",
        "true",
    ),
    "sellers": (
        f"'Updated location for id ' || old_seller_id || ': ' || {_place('seller')}",
        f"{_moved('seller')} and ({_place('seller')}) is not null",
    ),
    "order_items": (
        _joined("'Updated order item on id ' || old_order_item_id", _ITEM_PARTS),
        _some(_ITEM_PARTS),
    ),
    "order_payments": (_joined("'Payment updated on id ', old_order_id", _PAYMENT_PARTS), _some(_PAYMENT_PARTS)),
    "products": (_joined("'Updated on product id ' || old_product_id", _PRODUCT_PARTS), _some(_PRODUCT_PARTS)),
    "orders": (
        _joined("'Updated orders on id ', old_order_id", _ORDER_PARTS),
        """(old_order_status is distinct from order_status
            or old_order_approved_at is distinct from order_approved_at
            or old_order_delivered_carrier_date is distinct from order_delivered_carrier_date
            or old_order_delivered_customer_date is distinct from order_delivered_customer_date)""",
    ),
    "geolocation": (_joined("", _GEO_PARTS), "true"),
    "order_reviews": (_joined("'Updated review on id ' || old_review_id", _REVIEW_PARTS), _some(_REVIEW_PARTS)),
    "product_category_name_translation": ("'Updated translation for ' || product_category_name", "true"),
}


def audit_sql(table: str, kind: str) -> str:
    if kind == "insert":
        rows, text, logged = insert_sql(table), _INSERT_TEXT[table], "true"
    elif kind == "update":
        rows, (text, logged) = update_sql(table, old_images=True), _UPDATE_TEXT[table]
    else:
        rows = f"select *, cast(null as varchar) as reason from k_{table}"
        text, logged = _DELETE_TEXT[table], "true"
    return f"""select '{table}' as at_table, {text} as action_desc, timestamp '{AS_OF}' as action_date,
        '{BATCH_ID}' as batch_id, cast(seq as bigint) as seq from ({rows}) checked
        where reason is null and {logged}"""


def update_text_sql(table: str) -> tuple[str, str]:
    """Text of an update and whether it is logged, for rows with ``old_`` columns."""
    return _UPDATE_TEXT[table]


def all_audit_sql(*tables: str) -> str:
    return " union all ".join(audit_sql(t, kind) for t in tables for kind in _BATCHES)


ORACLES = {f"audit_{t}_{kind}": oracle(audit_sql(t, kind)) for t in SCHEMAS for kind in _BATCHES}


def _written_sql(*tables: str) -> str:
    first, second = all_audit_sql(*tables), " union all ".join(audit_sql(t, "insert") for t in tables)
    return f"""select * replace ('b9' as batch_id), cast(0 as bigint) as version from ({first}) f
        union all select * replace ('b10' as batch_id), cast(1 as bigint) as version from ({second}) s"""


ORACLES["audit_by_table"] = oracle(_written_sql("customers"))
ORACLES["audit_latest"] = oracle(
    f"""select * from ({_written_sql(*SCHEMAS)}) log
        qualify row_number() over (partition by at_table order by version desc, seq desc, action_desc desc) = 1"""
)
