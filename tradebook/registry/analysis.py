"""Metrics, reports, follow-ups and scalar functions over the model tables."""

from __future__ import annotations

from tradebook.functions import delivery_delay, order_total, review_sentiment
from tradebook.operators import delivery, payments, revenue, sentiment
from tradebook.plans import follow_ups
from tradebook.sources.testdata import load_tables, oracle

MIN_DELAY_DAYS = 5
MIN_REVIEWS = 700
SLOW_UNITS = 700
STATE, CITY, CATEGORY, PAYMENT_TYPE = "SP", "building", "promo_3", "credit_card"
SELLER_ID = "2".rjust(32, "S")


_CATEGORY = ("order_items", "products")
_LOCATION = ("order_items", "orders", "customers")
_SELLER = ("order_items", "sellers")
_DELAY_TABLES = ("orders", "customers")
_SENTIMENT_TABLES = ("order_reviews", "order_items", "products")


def _query(build, *tables):
    return lambda spark, sf_dir: build(load_tables(spark, sf_dir, *tables))


def _slow_categories(tables):
    return follow_ups.slow_categories(revenue.category_revenue(tables), SLOW_UNITS)


def _category_avg_item_value(tables):
    return follow_ups.average_item_value(revenue.category_revenue(tables))


def _delays(tables):
    return delivery.shipping_delays(tables, MIN_DELAY_DAYS)


def _fn_order_total(tables):
    total = order_total("price", "freight_value").alias("order_total")
    return tables.order_items.select("order_id", "order_item_id", total)


def _fn_delivery_delay(tables):
    delay = delivery_delay("order_estimated_delivery_date", "order_delivered_customer_date")
    return tables.orders.select("order_id", delay.alias("delivery_delay"))


def _fn_review_sentiment(tables):
    return tables.order_reviews.select("review_id", "order_id", review_sentiment("review_score").alias("sentiment"))


QUERIES = {
    "category_revenue": _query(revenue.category_revenue, *_CATEGORY),
    "category_revenue_filtered": _query(lambda t: revenue.category_revenue(t, CATEGORY), *_CATEGORY),
    "payment_metrics": _query(payments.payment_metrics, "order_payments"),
    "payment_metrics_filtered": _query(lambda t: payments.payment_metrics(t, PAYMENT_TYPE), "order_payments"),
    "location_revenue": _query(revenue.location_revenue, *_LOCATION),
    "location_revenue_state": _query(lambda t: revenue.location_revenue(t, STATE), *_LOCATION),
    "location_revenue_city": _query(lambda t: revenue.location_revenue(t, STATE, CITY), *_LOCATION),
    "seller_revenue": _query(revenue.seller_revenue, *_SELLER),
    "seller_revenue_one": _query(lambda t: revenue.seller_revenue(t, SELLER_ID), *_SELLER),
    "shipping_delays": _query(_delays, *_DELAY_TABLES),
    "sentiment_metrics": _query(lambda t: sentiment.sentiment_metrics(t, MIN_REVIEWS), *_SENTIMENT_TABLES),
    "top_categories_10": _query(lambda t: follow_ups.top_categories(revenue.category_revenue(t)), *_CATEGORY),
    "slow_categories": _query(_slow_categories, *_CATEGORY),
    "category_avg_item_value": _query(_category_avg_item_value, *_CATEGORY),
    "payment_popularity": _query(lambda t: follow_ups.payment_popularity(payments.payment_metrics(t)), "order_payments"),
    "payment_cash_flow": _query(lambda t: follow_ups.payment_cash_flow(payments.payment_metrics(t)), "order_payments"),
    "delays_by_state": _query(lambda t: follow_ups.delays_by_state(_delays(t)), *_DELAY_TABLES),
    "delays_by_city": _query(lambda t: follow_ups.delays_by_city(_delays(t)), *_DELAY_TABLES),
    "sentiment_best": _query(lambda t: follow_ups.best_reviewed(sentiment.sentiment_metrics(t, 20)), *_SENTIMENT_TABLES),
    "sentiment_worst": _query(lambda t: follow_ups.worst_reviewed(sentiment.sentiment_metrics(t, 20)), *_SENTIMENT_TABLES),
    "report_top_categories": _query(lambda t: revenue.report_top_categories(t, 10), *_CATEGORY),
    "report_payment_methods": _query(payments.report_payment_methods, "order_payments"),
    "report_shipping_delays": _query(lambda t: delivery.report_shipping_delays(t, MIN_DELAY_DAYS), *_DELAY_TABLES),
    "fn_order_total": _query(_fn_order_total, "order_items"),
    "fn_delivery_delay": _query(_fn_delivery_delay, "orders"),
    "fn_review_sentiment": _query(_fn_review_sentiment, "order_reviews"),
}


_TOTAL = "cast(coalesce(price, 0) + coalesce(freight_value, 0) as decimal(10,2))"
_UNITS_REVENUE = f"""cast(count(i.order_id) as bigint) as "Total_Units_Sold",
    cast(sum({_TOTAL}) as decimal(20,2)) as "Total_Revenue" """
_DELAY = """case when order_delivered_customer_date is null or order_estimated_delivery_date is null then 0
    else cast(datediff('day', order_estimated_delivery_date, order_delivered_customer_date) as int) end"""
_SENTIMENT = """case when review_score is null then 'Unknown' when review_score > 3 then 'Positive'
    when review_score < 3 then 'Negative' else 'Neutral' end"""


def _half_up(numerator: str, denominator: str, places: int) -> str:
    """Whole-number ratio rounded half up without floating point (for non-negative values)."""
    n, d = f"cast({numerator} as hugeint)", f"cast({denominator} as hugeint)"
    return (
        f"case when {denominator} = 0 then null "
        f"else cast((2*{n}*{10**places} + {d}) // (2*{d}) as double) / {10**places} end"
    )


def _category_revenue(where: str = "") -> str:
    return f"""select product_category_name as "Category", {_UNITS_REVENUE}
        from x_order_items i join x_products p on i.product_id = p.product_id
        where product_category_name is not null {where} group by product_category_name"""


def _payment_metrics(where: str = "") -> str:
    return f"""select payment_type as "Payment_Type", cast(count(order_id) as bigint) as "Total_Transactions",
        cast(sum(payment_value) as decimal(20,2)) as "Total_Cash_Flow",
        avg(payment_installments) as "Avg_Installments" from x_order_payments {where} group by payment_type"""


def _location_revenue(where: str = "") -> str:
    return f"""select customer_state as "State", customer_city as "City", {_UNITS_REVENUE}
        from x_order_items i join x_orders o on i.order_id = o.order_id
        join x_customers c on o.customer_id = c.customer_id {where} group by customer_state, customer_city"""


def _seller_revenue(where: str = "") -> str:
    return f"""select i.seller_id as "Seller_ID", seller_state as "Seller_State", seller_city as "Seller_City",
        {_UNITS_REVENUE} from x_order_items i join x_sellers s on i.seller_id = s.seller_id
        {where} group by i.seller_id, seller_state, seller_city"""


def _sentiment_metrics(at_least: int) -> str:
    return f"""select product_category_name as "Category",
        cast(sum(case when {_SENTIMENT} = 'Positive' then 1 else 0 end) as bigint) as "Positive_Review_Count",
        cast(sum(case when {_SENTIMENT} = 'Negative' then 1 else 0 end) as bigint) as "Negative_Review_Count",
        cast(count(review_id) as bigint) as "Total_Review_Count",
        {_half_up("sum(review_score)", "count(review_score)", 2)} as "Avg_Review_Score"
        from x_order_reviews r join x_order_items i on r.order_id = i.order_id
        join x_products p on i.product_id = p.product_id
        where product_category_name is not null group by product_category_name
        having count(review_id) >= {at_least}"""


_DELIVERED = f"""(select *, {_DELAY} days_late from x_orders where order_status = 'delivered')"""
_DELAYS = f"""select order_id, o.customer_id, customer_state, customer_city, order_purchase_timestamp, days_late
    from {_DELIVERED} o join x_customers c on o.customer_id = c.customer_id
    where days_late >= {MIN_DELAY_DAYS}"""
_IS_LATE = f"days_late >= {MIN_DELAY_DAYS}"

ORACLES = {
    name: oracle(text)
    for name, text in {
        "category_revenue": _category_revenue(),
        "category_revenue_filtered": _category_revenue(f"and product_category_name = '{CATEGORY}'"),
        "payment_metrics": _payment_metrics(),
        "payment_metrics_filtered": _payment_metrics(f"where payment_type = '{PAYMENT_TYPE}'"),
        "location_revenue": _location_revenue(),
        "location_revenue_state": _location_revenue(f"where customer_state = '{STATE}'"),
        "location_revenue_city": _location_revenue(f"where customer_state = '{STATE}' and customer_city = '{CITY}'"),
        "seller_revenue": _seller_revenue(),
        "seller_revenue_one": _seller_revenue(f"where i.seller_id = '{SELLER_ID}'"),
        "shipping_delays": _DELAYS,
        "sentiment_metrics": _sentiment_metrics(MIN_REVIEWS),
        "top_categories_10": _category_revenue() + ' order by "Total_Revenue" desc, "Category" limit 10',
        "slow_categories": f"""select * from ({_category_revenue()}) t where "Total_Units_Sold" < {SLOW_UNITS}
            order by "Total_Units_Sold", "Category" """,
        "category_avg_item_value": f"""select "Category",
            cast("Total_Revenue" as double) / cast("Total_Units_Sold" as double) as "Avg_Value_Per_Item"
            from ({_category_revenue()}) t""",
        "payment_popularity": f"""select "Payment_Type", "Total_Transactions" from ({_payment_metrics()}) t
            order by "Total_Transactions" desc, "Payment_Type" """,
        "payment_cash_flow": f"""select "Payment_Type", "Total_Cash_Flow" from ({_payment_metrics()}) t
            order by "Total_Cash_Flow" desc, "Payment_Type" """,
        "delays_by_state": f"""select customer_state, cast(count(*) as bigint) as delayed_orders,
            avg(days_late) as avg_days_late from ({_DELAYS}) t group by customer_state""",
        "delays_by_city": f"""select customer_city, cast(count(*) as bigint) as delayed_orders
            from ({_DELAYS}) t group by customer_city""",
        "sentiment_best": f"""select "Category", "Positive_Review_Count", "Avg_Review_Score"
            from ({_sentiment_metrics(20)}) t order by "Avg_Review_Score" desc, "Category" """,
        "sentiment_worst": f"""select "Category", "Negative_Review_Count", "Avg_Review_Score"
            from ({_sentiment_metrics(20)}) t order by "Avg_Review_Score", "Category" """,
        "report_top_categories": f"""select product_category_name as "Category",
            cast(count(order_item_id) as bigint) as "Total_Units_Sold",
            cast(sum({_TOTAL}) as decimal(20,2)) as "Total_Revenue"
            from x_order_items i join x_products p on i.product_id = p.product_id
            group by product_category_name having product_category_name is not null
            order by "Total_Revenue" desc, "Category" limit 10""",
        "report_payment_methods": f"""select payment_type as "Payment_Method",
            cast(count(distinct order_id) as bigint) as "Transaction_Count",
            cast(sum(payment_value) as decimal(20,2)) as "Total_Collected",
            {_half_up("sum(payment_installments)", "count(payment_installments)", 1)} as "Avg_Installments"
            from x_order_payments group by payment_type order by "Transaction_Count" desc, "Payment_Method" """,
        "report_shipping_delays": f"""select customer_state as "Customer_State",
            cast(sum(case when {_IS_LATE} then 1 else 0 end) as bigint) as "Total_Delayed_Orders",
            {_half_up(f"sum(case when {_IS_LATE} then days_late end)", f"count(case when {_IS_LATE} then 1 end)", 1)}
                as "Avg_Days_Late",
            {_half_up(f"100 * sum(case when {_IS_LATE} then 1 else 0 end)", "count(order_id)", 2)}
                as "Delay_Percentage"
            from {_DELIVERED} o join x_customers c on o.customer_id = c.customer_id
            group by customer_state order by "Total_Delayed_Orders" desc, "Customer_State" """,
        "fn_order_total": f"select order_id, order_item_id, {_TOTAL} as order_total from x_order_items",
        "fn_delivery_delay": f"select order_id, {_DELAY} as delivery_delay from x_orders",
        "fn_review_sentiment": f"select review_id, order_id, {_SENTIMENT} as sentiment from x_order_reviews",
    }.items()
}
