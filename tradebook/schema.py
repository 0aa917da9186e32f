"""Column types and row keys of the nine base tables and the audit table."""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(10, 2)
MONEY_SUM = T.DecimalType(20, 2)


_TYPES = {
    "STRING": T.StringType(),
    "INT": T.IntegerType(),
    "BIGINT": T.LongType(),
    "DOUBLE": T.DoubleType(),
    "BOOLEAN": T.BooleanType(),
    "MONEY": MONEY,
    "TIMESTAMP_NTZ": T.TimestampNTZType(),
}


def _struct(columns: str) -> T.StructType:
    pairs = [column.split() for column in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


SCHEMAS: dict[str, T.StructType] = {
    "customers": _struct(
        "customer_id STRING, customer_unique_id STRING, customer_zip_code_prefix STRING, "
        "customer_city STRING, customer_state STRING"
    ),
    "sellers": _struct(
        "seller_id STRING, seller_zip_code_prefix STRING, seller_city STRING, seller_state STRING"
    ),
    "orders": _struct(
        "order_id STRING, customer_id STRING, order_status STRING, "
        "order_purchase_timestamp TIMESTAMP_NTZ, order_approved_at TIMESTAMP_NTZ, "
        "order_delivered_carrier_date TIMESTAMP_NTZ, order_delivered_customer_date TIMESTAMP_NTZ, "
        "order_estimated_delivery_date TIMESTAMP_NTZ"
    ),
    "order_items": _struct(
        "order_id STRING, order_item_id INT, product_id STRING, seller_id STRING, "
        "shipping_limit_date TIMESTAMP_NTZ, price MONEY, freight_value MONEY"
    ),
    "order_payments": _struct(
        "order_id STRING, payment_sequential INT, payment_type STRING, "
        "payment_installments INT, payment_value MONEY"
    ),
    "order_reviews": _struct(
        "review_id STRING, order_id STRING, review_score INT, review_comment_title STRING, "
        "review_comment_message STRING, review_creation_date TIMESTAMP_NTZ, "
        "review_answer_timestamp TIMESTAMP_NTZ"
    ),
    "products": _struct(
        "product_id STRING, product_category_name STRING, product_name_length INT, "
        "product_description_length INT, product_photos_qty INT, product_weight_g INT, "
        "product_length_cm INT, product_height_cm INT, product_width_cm INT"
    ),
    "geolocation": _struct(
        "geolocation_zip_code_prefix STRING, geolocation_lat DOUBLE, geolocation_lng DOUBLE, "
        "geolocation_city STRING, geolocation_state STRING"
    ),
    "product_category_name_translation": _struct(
        "product_category_name STRING, product_category_name_english STRING"
    ),
}

# An empty key means rows are told apart only by all of their values.
KEYS: dict[str, tuple[str, ...]] = {
    "customers": ("customer_id",),
    "sellers": ("seller_id",),
    "orders": ("order_id",),
    "order_items": ("order_id", "order_item_id"),
    "order_payments": ("order_id", "payment_sequential"),
    "order_reviews": ("review_id", "order_id"),
    "products": ("product_id",),
    "geolocation": (),
    "product_category_name_translation": ("product_category_name",),
}

AUDIT_SCHEMA = _struct(
    "at_table STRING, action_desc STRING, action_date TIMESTAMP_NTZ, batch_id STRING, seq BIGINT"
)


def change_schema(table: str) -> T.StructType:
    """Schema of a change frame: operation I, U or D, order within the batch, row images."""
    return T.StructType(
        [
            T.StructField("op", T.StringType()),
            T.StructField("seq", T.LongType()),
            T.StructField("old", SCHEMAS[table]),
            T.StructField("new", SCHEMAS[table]),
        ]
    )


def combined_schema(more: str = "") -> T.StructType:
    """Schema of changes of any table in one frame: the table's name, ``more`` columns, and a pair of images for each table."""
    added = _struct(more).fields if more else []
    images = [T.StructField(t, T.StructType([T.StructField(i, s) for i in ("old", "new")])) for t, s in SCHEMAS.items()]
    head = [T.StructField("at_table", T.StringType()), T.StructField("op", T.StringType()), T.StructField("seq", T.LongType())]
    return T.StructType([*head, *added, *images])


def combined(changes: dict[str, DataFrame]) -> DataFrame:
    """Change frames of several tables as one; columns besides op, seq, old and new are kept."""

    def wide(table: str, df: DataFrame) -> DataFrame:
        more = [c for c in df.columns if c not in ("op", "seq", "old", "new")]
        images = [F.struct("old", "new") if t == table else F.lit(None).cast(combined_schema()[t].dataType) for t in SCHEMAS]
        return df.select(F.lit(table).alias("at_table"), "op", "seq", *more, *[i.alias(t) for i, t in zip(images, SCHEMAS)])

    return reduce(DataFrame.unionByName, [wide(table, df) for table, df in changes.items()])


def split(changes: DataFrame, *tables: str) -> dict[str, DataFrame]:
    """The change frames of the named tables, out of a combined one."""
    return {t: changes.where(F.col("at_table") == t).select("op", "seq", f"{t}.old", f"{t}.new") for t in tables}


@dataclass(frozen=True)
class Tables:
    """The base tables as DataFrames; leave out those a query does not use."""

    customers: DataFrame | None = None
    sellers: DataFrame | None = None
    orders: DataFrame | None = None
    order_items: DataFrame | None = None
    order_payments: DataFrame | None = None
    order_reviews: DataFrame | None = None
    products: DataFrame | None = None
    geolocation: DataFrame | None = None
    product_category_name_translation: DataFrame | None = None

    def present(self) -> dict[str, DataFrame]:
        named = {f.name: getattr(self, f.name) for f in fields(self)}
        return {name: df for name, df in named.items() if df is not None}
