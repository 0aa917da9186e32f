"""Review sentiment per product category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradebook import fixed
from tradebook.functions import review_sentiment, rounded_ratio
from tradebook.schema import Tables


def sentiment_metrics(tables: Tables, min_review_count: int | None = None) -> DataFrame:
    """Positive, negative and all reviews per category; a review counts once per item of its order.

    Items and reviews meet many-to-many on the order. Reviews are summed per order and sentiment
    first, so an item row meets at most four rows however many reviews its order has, and the
    pairs are counted, never listed. Both join inputs come straight from a shuffle, which lets
    AQE split an order that holds very many items.
    """
    categories = tables.products.select("product_id", "product_category_name").where(
        F.col("product_category_name").isNotNull()
    )
    sold = tables.order_items.select("order_id", "product_id").join(categories, "product_id")
    scored = tables.order_reviews.groupBy("order_id", review_sentiment("review_score").alias("sentiment")).agg(
        F.count("*").alias("pairs"),
        F.count("review_id").alias("reviews"),
        F.sum("review_score").alias("score_sum"),
        F.count("review_score").alias("score_rows"),
    )

    def pairs_of(sentiment: str) -> Column:
        return F.sum(F.when(F.col("sentiment") == sentiment, F.col("pairs")).otherwise(0))

    return (
        sold.select("order_id", "product_category_name")
        .join(scored, "order_id")
        .groupBy(F.col("product_category_name").alias("Category"))
        .agg(
            pairs_of(fixed.POSITIVE).alias("Positive_Review_Count"),
            pairs_of(fixed.NEGATIVE).alias("Negative_Review_Count"),
            F.sum("reviews").alias("Total_Review_Count"),
            rounded_ratio(F.sum("score_sum"), F.sum("score_rows"), 2).alias("Avg_Review_Score"),
        )
        .where(F.col("Total_Review_Count") >= (1 if min_review_count is None else min_review_count))
    )
