"""Operators on tables in the layouts that sources offer: buckets, files for look-ups, text formats.

A layout is written once in a session and read by every run after that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from tradebook.operators import requests, revenue, sentiment
from tradebook.registry import analysis
from tradebook.schema import SCHEMAS, Tables
from tradebook.sources.clustered import BY_ORDER, cluster_by_order
from tradebook.sources.files import LOOKUP, converted, read_table, scratch_path, write_table
from tradebook.sources.testdata import SOURCE_SCHEMAS, load_tables, oracle

ORDER_ID, CUSTOMER_ID = "777".rjust(32, "O"), "42".rjust(32, "C")
PRODUCT_ID = "77".rjust(32, "P")
BUCKETS = 8
#: Beyond these the buckets grow in number, so that a task sorts its own in memory.
ORDERS_PER_BUCKET = 100_000

_WRITTEN: dict[tuple, object] = {}


def _once(spark, sf_dir, kind: str, make: Callable[[str], object]):
    """What ``make`` writes below a folder, once for a session and a folder of tables."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _WRITTEN:
        _WRITTEN[key] = make(scratch_path(spark, kind))
    return _WRITTEN[key]


def _clustered(spark, sf_dir, *names: str) -> Tables:
    """The named tables, those with an order's rows clustered; a table is written when a query first asks for it."""
    tables = load_tables(spark, sf_dir, *names)
    orders = spark.read.schema(SOURCE_SCHEMAS["orders"]).parquet(f"{sf_dir}/orders.parquet").count()  # from the files' footers
    buckets = max(BUCKETS, -(-orders // ORDERS_PER_BUCKET))

    def table(name: str, df):
        if name not in BY_ORDER:
            return df
        alone = Tables(**{name: df})
        return _once(spark, sf_dir, f"clustered-{name}", lambda path: getattr(cluster_by_order(alone, path, buckets), name))

    return Tables(**{name: table(name, df) for name, df in tables.present().items()})


def _lookup(spark, sf_dir, table: str):
    def make(path: str):
        write_table(getattr(load_tables(spark, sf_dir, table), table), path, lookup=LOOKUP[table])
        return read_table(spark, path, table)

    return _once(spark, sf_dir, f"lookup-{table}", make)


def _in_format(table: str, file_format: str):
    def query(spark, sf_dir):
        def make(path: str):
            write_table(getattr(load_tables(spark, sf_dir, table), table), path, file_format=file_format)
            return read_table(spark, path, table, file_format)

        return _once(spark, sf_dir, f"{file_format}-{table}", make)

    return query


def _converted_csv(table: str):
    def query(spark, sf_dir):
        def make(path: str):
            write_table(getattr(load_tables(spark, sf_dir, table), table), f"{path}/csv", file_format="csv")
            return converted(spark, f"{path}/csv", table, f"{path}/parquet")

        return _once(spark, sf_dir, f"converted-{table}", make)

    return query


def _items_of_product(spark, sf_dir):
    return _lookup(spark, sf_dir, "order_items").where(F.col("product_id") == PRODUCT_ID)


def _orders_of_customer(spark, sf_dir):
    return _lookup(spark, sf_dir, "orders").where(F.col("customer_id") == CUSTOMER_ID)


QUERIES = {
    "location_revenue_clustered": lambda spark, sf_dir: revenue.location_revenue(_clustered(spark, sf_dir, "orders", "order_items", "customers")),
    "sentiment_metrics_clustered": lambda spark, sf_dir: sentiment.sentiment_metrics(
        _clustered(spark, sf_dir, "order_items", "order_reviews", "products"), analysis.MIN_REVIEWS
    ),
    "find_orders_by_id": lambda spark, sf_dir: requests.find_orders(_lookup(spark, sf_dir, "orders"), order_id=ORDER_ID),
    "orders_of_customer": _orders_of_customer,
    "items_of_product": _items_of_product,
    "orc_orders": _in_format("orders", "orc"),
    "json_order_items": _in_format("order_items", "json"),
    "converted_csv_order_reviews": _converted_csv("order_reviews"),
}


def _rows_sql(table: str, where: str = "true") -> str:
    return oracle(f"select {', '.join(SCHEMAS[table].fieldNames())} from x_{table} where {where}")


ORACLES = {
    "location_revenue_clustered": analysis.ORACLES["location_revenue"],
    "sentiment_metrics_clustered": analysis.ORACLES["sentiment_metrics"],
    "find_orders_by_id": oracle(
        f"""select order_id, customer_id, order_status, order_purchase_timestamp, order_delivered_customer_date,
            order_estimated_delivery_date from x_orders where order_id = '{ORDER_ID}'"""
    ),
    "orders_of_customer": _rows_sql("orders", f"customer_id = '{CUSTOMER_ID}'"),
    "items_of_product": _rows_sql("order_items", f"product_id = '{PRODUCT_ID}'"),
    "orc_orders": _rows_sql("orders"),
    "json_order_items": _rows_sql("order_items"),
    "converted_csv_order_reviews": _rows_sql("order_reviews"),
}
