"""What a session offers besides operators: prepared views and functions in SQL, collations, csv files."""

from __future__ import annotations

from tradebook import fixed
from tradebook.functions import register_sql_functions
from tradebook.operators import payments, revenue
from tradebook.plans import snapshots
from tradebook.registry import analysis
from tradebook.schema import SCHEMAS
from tradebook.sources.files import read_table, scratch_path, write_table
from tradebook.sources.testdata import load_tables, oracle

_BELOW_AVERAGE = """select * from {metrics}
    where Total_Units_Sold < (select avg(Total_Units_Sold) from {metrics})"""
_FUNCTIONS = {
    "order_items": "select order_id, order_item_id, {f}(price, freight_value) as order_total from {t}",
    "orders": "select order_id, {f}(order_estimated_delivery_date, order_delivered_customer_date) as delivery_delay from {t}",
    "order_reviews": "select review_id, order_id, {f}(review_score) as sentiment from {t}",
}
_FUNCTION_NAMES = {
    "order_items": fixed.SQL_ORDER_TOTAL,
    "orders": fixed.SQL_DELIVERY_DELAY,
    "order_reviews": fixed.SQL_REVIEW_SENTIMENT,
}


def _prepared_category_revenue(spark, sf_dir):
    tables = load_tables(spark, sf_dir, "order_items", "products")
    snapshots.prepare_category_revenue(tables, keep=snapshots.DURABLE)
    return spark.sql(_BELOW_AVERAGE.format(metrics=fixed.VIEW_CATEGORY_REVENUE))


def _prepared_payment_metrics(spark, sf_dir):
    tables = load_tables(spark, sf_dir, "order_payments")
    snapshots.prepare_payment_metrics(tables, keep=snapshots.CACHED)
    return spark.sql(f"select * from {fixed.VIEW_PAYMENT_METRICS}")


def _prepared(view, prepare, *tables, keep=snapshots.CACHED):
    """A prepared metric, read back from its view."""

    def query(spark, sf_dir):
        prepare(load_tables(spark, sf_dir, *tables), keep)
        return spark.sql(f"select * from {view}")

    return query


def _function(table):
    def query(spark, sf_dir):
        register_sql_functions(spark)
        text = _FUNCTIONS[table].format(f=_FUNCTION_NAMES[table], t="{rows}")
        return spark.sql(text, rows=getattr(load_tables(spark, sf_dir, table), table))

    return query


def _csv(table):
    def query(spark, sf_dir):
        path = scratch_path(spark, "csv")
        write_table(getattr(load_tables(spark, sf_dir, table), table), path, file_format="csv")
        return read_table(spark, path, table, "csv")

    return query


def _payments_any_case(spark, sf_dir):
    tables = load_tables(spark, sf_dir, "order_payments")
    return payments.payment_metrics(tables, analysis.PAYMENT_TYPE.upper(), collation="UTF8_LCASE")


def _city_without_accents(spark, sf_dir):
    tables = load_tables(spark, sf_dir, "order_items", "orders", "customers")
    city = analysis.CITY.replace("u", "ú").upper()
    return revenue.location_revenue(tables, analysis.STATE.lower(), city, collation="UNICODE_CI_AI")


QUERIES = {
    "prepared_category_revenue_sql": _prepared_category_revenue,
    "prepared_payment_metrics_sql": _prepared_payment_metrics,
    "prepared_location_revenue_sql": _prepared(
        fixed.VIEW_LOCATION_REVENUE, lambda t, keep: snapshots.prepare_location_revenue(t, keep=keep), "order_items", "orders", "customers"
    ),
    "prepared_seller_revenue_sql": _prepared(
        fixed.VIEW_SELLER_REVENUE, lambda t, keep: snapshots.prepare_seller_revenue(t, keep=keep), "order_items", "sellers"
    ),
    "prepared_shipping_delays_sql": _prepared(
        fixed.VIEW_SHIPPING_DELAYS,
        lambda t, keep: snapshots.prepare_shipping_delays(t, analysis.MIN_DELAY_DAYS, keep=keep),
        "orders",
        "customers",
        keep=snapshots.DURABLE,
    ),
    "prepared_sentiment_metrics_sql": _prepared(
        fixed.VIEW_SENTIMENT_METRICS,
        lambda t, keep: snapshots.prepare_sentiment_metrics(t, analysis.MIN_REVIEWS, keep=keep),
        "order_reviews",
        "order_items",
        "products",
        keep=snapshots.DURABLE,
    ),
    "sql_function_order_total": _function("order_items"),
    "sql_function_delivery_delay": _function("orders"),
    "sql_function_review_sentiment": _function("order_reviews"),
    "payment_metrics_any_case": _payments_any_case,
    "location_revenue_any_accent": _city_without_accents,
    "csv_sellers": _csv("sellers"),
    "csv_order_reviews": _csv("order_reviews"),
}
ORACLES = {
    "prepared_category_revenue_sql": f"""with metrics as ({analysis.ORACLES["category_revenue"]})
        {_BELOW_AVERAGE.format(metrics="metrics")}""",
    "prepared_payment_metrics_sql": analysis.ORACLES["payment_metrics"],
    "prepared_location_revenue_sql": analysis.ORACLES["location_revenue"],
    "prepared_seller_revenue_sql": analysis.ORACLES["seller_revenue"],
    "prepared_shipping_delays_sql": analysis.ORACLES["shipping_delays"],
    "prepared_sentiment_metrics_sql": analysis.ORACLES["sentiment_metrics"],
    "sql_function_order_total": analysis.ORACLES["fn_order_total"],
    "sql_function_delivery_delay": analysis.ORACLES["fn_delivery_delay"],
    "sql_function_review_sentiment": analysis.ORACLES["fn_review_sentiment"],
    "payment_metrics_any_case": analysis.ORACLES["payment_metrics_filtered"],
    "location_revenue_any_accent": analysis.ORACLES["location_revenue_city"],
    **{f"csv_{t}": oracle(f"select {', '.join(SCHEMAS[t].fieldNames())} from x_{t}") for t in ("sellers", "order_reviews")},
}
