"""Questions asked of a prepared metric: leaderboards, rankings and second-level sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_categories(category_revenue: DataFrame, limit: int = 10) -> DataFrame:
    return category_revenue.orderBy(F.desc("Total_Revenue"), "Category").limit(limit)


def slow_categories(category_revenue: DataFrame, units_below: int = 50) -> DataFrame:
    return category_revenue.where(F.col("Total_Units_Sold") < units_below).orderBy("Total_Units_Sold", "Category")


def average_item_value(category_revenue: DataFrame) -> DataFrame:
    per_item = F.col("Total_Revenue").cast("double") / F.col("Total_Units_Sold").cast("double")
    return category_revenue.select("Category", per_item.alias("Avg_Value_Per_Item"))


def payment_popularity(payment_metrics: DataFrame) -> DataFrame:
    ranked = payment_metrics.select("Payment_Type", "Total_Transactions")
    return ranked.orderBy(F.desc("Total_Transactions"), "Payment_Type")


def payment_cash_flow(payment_metrics: DataFrame) -> DataFrame:
    ranked = payment_metrics.select("Payment_Type", "Total_Cash_Flow")
    return ranked.orderBy(F.desc("Total_Cash_Flow"), "Payment_Type")


def delays_by_state(shipping_delays: DataFrame) -> DataFrame:
    return shipping_delays.groupBy("customer_state").agg(
        F.count("*").alias("delayed_orders"), F.avg("days_late").alias("avg_days_late")
    )


def delays_by_city(shipping_delays: DataFrame) -> DataFrame:
    return shipping_delays.groupBy("customer_city").agg(F.count("*").alias("delayed_orders"))


def best_reviewed(sentiment_metrics: DataFrame) -> DataFrame:
    shown = sentiment_metrics.select("Category", "Positive_Review_Count", "Avg_Review_Score")
    return shown.orderBy(F.desc("Avg_Review_Score"), "Category")


def worst_reviewed(sentiment_metrics: DataFrame) -> DataFrame:
    shown = sentiment_metrics.select("Category", "Negative_Review_Count", "Avg_Review_Score")
    return shown.orderBy("Avg_Review_Score", "Category")
