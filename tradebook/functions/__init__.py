from tradebook.functions.scalar import (
    delivery_delay,
    order_total,
    register_sql_functions,
    review_sentiment,
    rounded_ratio,
)

__all__ = [
    "delivery_delay",
    "order_total",
    "register_sql_functions",
    "review_sentiment",
    "rounded_ratio",
]
