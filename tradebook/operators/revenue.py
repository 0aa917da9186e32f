"""Units sold and revenue by category, customer location and seller.

Sums are taken per join key before any join, so a key that holds a large share of the items is
combined on the map side and crosses the shuffle as one row per task. A filter on a place narrows
the orders before they meet the sums. A filter on a category comes before the sums altogether: its
products are often few enough to be broadcast, and then most items go no further than the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradebook.functions import order_total
from tradebook.operators.matching import equals
from tradebook.schema import MONEY_SUM, Tables


def _revenue() -> Column:
    return F.sum(order_total("price", "freight_value")).alias("revenue")


def _sales(items: DataFrame, *keys: str, counted: str = "order_id") -> DataFrame:
    return items.groupBy(*keys).agg(F.count(counted).alias("units"), _revenue())


def _merge(sales: DataFrame, *keys: Column | str) -> DataFrame:
    return sales.groupBy(*keys).agg(F.sum("units").alias("units"), F.sum("revenue").alias("revenue"))


def _report(sales: DataFrame, **names: str) -> DataFrame:
    return sales.select(
        *[F.col(column).alias(name) for name, column in names.items()],
        F.col("units").alias("Total_Units_Sold"),
        F.col("revenue").cast(MONEY_SUM).alias("Total_Revenue"),
    )


def category_revenue(
    tables: Tables, category: str | None = None, counted: str = "order_id", collation: str | None = None
) -> DataFrame:
    """Units and revenue per product category; rows without a category are left out."""
    products = tables.products.select("product_id", "product_category_name").where(
        F.col("product_category_name").isNotNull()
    )
    if category is None:
        sales = _sales(tables.order_items, "product_id", counted=counted).join(products, "product_id")
        sales = _merge(sales, "product_category_name")
    else:
        products = products.where(equals("product_category_name", category, collation))
        sold = tables.order_items.join(products, "product_id")
        sales = _sales(sold, "product_category_name", counted=counted)
    return _report(sales, Category="product_category_name")


def location_revenue(
    tables: Tables, state: str | None = None, city: str | None = None, collation: str | None = None
) -> DataFrame:
    """Units and revenue per customer state and city; missing places form their own group."""
    place = ("customer_state", "customer_city")
    orders = tables.orders.select("order_id", "customer_id")
    customers = tables.customers.select("customer_id", *place)
    per_order = _sales(tables.order_items, "order_id")
    if state is None and city is None:
        per_customer = _merge(per_order.join(orders, "order_id"), "customer_id")
        sales = _merge(per_customer.join(customers, "customer_id"), *place)
    else:
        for column, value in zip(place, (state, city)):
            if value is not None:
                customers = customers.where(equals(column, value, collation))
        wanted = orders.join(customers, "customer_id").drop("customer_id")
        sales = _merge(per_order.join(wanted, "order_id"), *place)
    return _report(sales, State="customer_state", City="customer_city")


def seller_revenue(tables: Tables, seller_id: str | None = None, collation: str | None = None) -> DataFrame:
    """Units and revenue per seller with the seller's place."""
    items, sellers = tables.order_items, tables.sellers.select("seller_id", "seller_state", "seller_city")
    if seller_id is not None:
        items = items.where(equals("seller_id", seller_id, collation))
    sales = _merge(
        _sales(items, "seller_id").join(sellers, "seller_id"), "seller_id", "seller_state", "seller_city"
    )
    return _report(sales, Seller_ID="seller_id", Seller_State="seller_state", Seller_City="seller_city")


def report_top_categories(tables: Tables, limit: int) -> DataFrame:
    """The categories with most revenue; equal revenues are ordered by name."""
    return category_revenue(tables, counted="order_item_id").orderBy(F.desc("Total_Revenue"), "Category").limit(limit)
