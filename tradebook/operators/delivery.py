"""Orders delivered late, singly and by state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradebook import fixed
from tradebook.functions import delivery_delay, rounded_ratio
from tradebook.schema import Tables


def _delivered(orders: DataFrame) -> DataFrame:
    return orders.where(F.col("order_status") == fixed.STATUS_DELIVERED).withColumn(
        "days_late", delivery_delay("order_estimated_delivery_date", "order_delivered_customer_date")
    )


def shipping_delays(tables: Tables, min_delay_days: int | None) -> DataFrame:
    """Delivered orders at least so many days late; none when no number is given."""
    late = _delivered(tables.orders).where(F.col("days_late") >= F.lit(min_delay_days).cast("int"))
    customers = tables.customers.select("customer_id", "customer_state", "customer_city")
    return late.join(customers, "customer_id").select(
        "order_id", "customer_id", "customer_state", "customer_city", "order_purchase_timestamp", "days_late"
    )


def report_shipping_delays(tables: Tables, min_delay_days: int | None) -> DataFrame:
    """Late orders, their mean delay and their share of all delivered orders, per customer state.

    Orders are summed per customer before the join, so that a customer with very many orders
    is one row there.
    """
    late = F.col("days_late") >= F.lit(min_delay_days).cast("int")
    per_customer = (
        _delivered(tables.orders)
        .groupBy("customer_id")
        .agg(
            F.count("order_id").alias("orders"),
            F.sum(F.when(late, 1).otherwise(0)).alias("late_orders"),
            F.sum(F.when(late, F.col("days_late"))).alias("late_days"),
        )
    )
    return (
        per_customer.join(tables.customers.select("customer_id", "customer_state"), "customer_id")
        .groupBy(F.col("customer_state").alias("Customer_State"))
        .agg(
            F.sum("late_orders").alias("Total_Delayed_Orders"),
            rounded_ratio(F.sum("late_days"), F.sum("late_orders"), 1).alias("Avg_Days_Late"),
            rounded_ratio(F.sum("late_orders"), F.sum("orders"), 2, scale=100).alias("Delay_Percentage"),
        )
        .orderBy(F.desc("Total_Delayed_Orders"), "Customer_State")
    )
