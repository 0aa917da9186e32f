"""Popularity and cash flow of payment types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradebook.functions import rounded_ratio
from tradebook.operators.matching import equals
from tradebook.schema import MONEY_SUM, Tables


def payment_metrics(tables: Tables, payment_type: str | None = None, collation: str | None = None) -> DataFrame:
    """Payments, cash flow and mean installments per type; an order paid in two parts counts twice."""
    payments = tables.order_payments
    if payment_type is not None:
        payments = payments.where(equals("payment_type", payment_type, collation))
    return payments.groupBy(F.col("payment_type").alias("Payment_Type")).agg(
        F.count("order_id").alias("Total_Transactions"),
        F.sum("payment_value").cast(MONEY_SUM).alias("Total_Cash_Flow"),
        F.avg("payment_installments").alias("Avg_Installments"),
    )


def report_payment_methods(tables: Tables) -> DataFrame:
    """Distinct orders, collected value and rounded mean installments per type, most used first.

    One row per (type, order) is formed first, so the exact distinct count needs only a plain
    count afterwards and is spread over the orders, not over the few types.
    """
    per_order = tables.order_payments.groupBy("payment_type", "order_id").agg(
        F.sum("payment_value").alias("collected"),
        F.sum("payment_installments").alias("installments"),
        F.count("payment_installments").alias("installment_rows"),
    )
    return (
        per_order.groupBy(F.col("payment_type").alias("Payment_Method"))
        .agg(
            F.count("order_id").alias("Transaction_Count"),
            F.sum("collected").cast(MONEY_SUM).alias("Total_Collected"),
            rounded_ratio(F.sum("installments"), F.sum("installment_rows"), 1).alias("Avg_Installments"),
        )
        .orderBy(F.desc("Transaction_Count"), "Payment_Method")
    )
