"""Scalar functions as native Column expressions, and as SQL functions Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tradebook import fixed
from tradebook.schema import MONEY


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def order_total(price: Column | str, freight: Column | str) -> Column:
    """Price plus freight, a missing part counting as zero."""
    zero = F.lit(0).cast(MONEY)
    parts = [F.coalesce(_col(part).cast(MONEY), zero) for part in (price, freight)]
    return (parts[0] + parts[1]).cast(MONEY)


def delivery_delay(estimated: Column | str, actual: Column | str) -> Column:
    """Whole days from the estimated to the actual date; 0 while either is unknown."""
    return F.coalesce(F.datediff(_col(actual), _col(estimated)), F.lit(0))


def review_sentiment(score: Column | str) -> Column:
    score = _col(score)
    return (
        F.when(score >= 4, F.lit(fixed.POSITIVE))
        .when(score == 3, F.lit(fixed.NEUTRAL))
        .when(score <= 2, F.lit(fixed.NEGATIVE))
        .otherwise(F.lit(fixed.UNKNOWN))
    )


def rounded_ratio(numerator: Column, denominator: Column, places: int, scale: int = 1) -> Column:
    """``scale * numerator / denominator`` of whole numbers, rounded half up as decimals.

    Dividing decimals keeps exact ties such as 601/200 = 3.005, which a double holds as
    slightly less. NULL where the denominator is 0.
    """
    whole = "decimal(20,0)"
    ratio = F.try_divide((numerator * F.lit(scale)).cast(whole), denominator.cast(whole))
    return F.round(ratio, places).cast("double")


def register_sql_functions(spark: SparkSession) -> None:
    """Make the three functions callable from SQL text in this session."""
    spark.sql(
        f"""create or replace temporary function {fixed.SQL_ORDER_TOTAL}(
                price decimal(10,2), freight decimal(10,2)) returns decimal(10,2)
            return cast(coalesce(price, 0) + coalesce(freight, 0) as decimal(10,2))"""
    )
    spark.sql(
        f"""create or replace temporary function {fixed.SQL_DELIVERY_DELAY}(
                estimated timestamp_ntz, actual timestamp_ntz) returns int
            return coalesce(datediff(actual, estimated), 0)"""
    )
    spark.sql(
        f"""create or replace temporary function {fixed.SQL_REVIEW_SENTIMENT}(score int) returns string
            return case when score >= 4 then '{fixed.POSITIVE}' when score = 3 then '{fixed.NEUTRAL}'
                        when score <= 2 then '{fixed.NEGATIVE}' else '{fixed.UNKNOWN}' end"""
    )
