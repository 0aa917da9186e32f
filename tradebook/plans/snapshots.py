"""Prepared metrics as session views, ready for follow-up queries in SQL or Python."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tradebook import fixed
from tradebook.operators import delivery, payments, revenue, sentiment
from tradebook.schema import Tables
from tradebook.sources.files import checkpoint_dir

LAZY, CACHED, DURABLE = "lazy", "cached", "durable"
#: Cached metrics by session and view, to be released when the view is replaced.
_HELD: dict[tuple[str, str], DataFrame] = {}


def publish_view(metric: DataFrame, name: str, keep: str = LAZY) -> DataFrame:
    """Register ``metric`` under ``name``, replacing an earlier one.

    ``lazy`` recomputes it on every use and follows the tables; ``cached`` computes it once and
    can rebuild lost parts from the tables; ``durable`` is a snapshot written to the shared
    checkpoint folder, which later changes and lost executors leave as it is.
    """
    here = (metric.sparkSession.sparkContext.applicationId, name)
    if keep == CACHED:
        metric = metric.persist()
    elif keep == DURABLE:
        checkpoint_dir(metric.sparkSession)
        metric = metric.checkpoint(eager=True)
    elif keep != LAZY:
        raise ValueError(f"keep must be {LAZY}, {CACHED} or {DURABLE}, not {keep!r}")
    metric.createOrReplaceTempView(name)
    replaced = _HELD.pop(here, None)
    if replaced is not None and replaced is not metric:
        replaced.unpersist()
    if keep == CACHED:
        _HELD[here] = metric
    return metric


def prepare_category_revenue(tables: Tables, category: str | None = None, keep: str = LAZY) -> DataFrame:
    return publish_view(revenue.category_revenue(tables, category), fixed.VIEW_CATEGORY_REVENUE, keep)


def prepare_payment_metrics(tables: Tables, payment_type: str | None = None, keep: str = LAZY) -> DataFrame:
    return publish_view(payments.payment_metrics(tables, payment_type), fixed.VIEW_PAYMENT_METRICS, keep)


def prepare_location_revenue(
    tables: Tables, state: str | None = None, city: str | None = None, keep: str = LAZY
) -> DataFrame:
    return publish_view(revenue.location_revenue(tables, state, city), fixed.VIEW_LOCATION_REVENUE, keep)


def prepare_seller_revenue(tables: Tables, seller_id: str | None = None, keep: str = LAZY) -> DataFrame:
    return publish_view(revenue.seller_revenue(tables, seller_id), fixed.VIEW_SELLER_REVENUE, keep)


def prepare_shipping_delays(tables: Tables, min_delay_days: int | None, keep: str = LAZY) -> DataFrame:
    return publish_view(delivery.shipping_delays(tables, min_delay_days), fixed.VIEW_SHIPPING_DELAYS, keep)


def prepare_sentiment_metrics(tables: Tables, min_review_count: int | None = None, keep: str = LAZY) -> DataFrame:
    return publish_view(sentiment.sentiment_metrics(tables, min_review_count), fixed.VIEW_SENTIMENT_METRICS, keep)
