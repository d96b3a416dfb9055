"""Sales by month, week and year: in total, by product and by category.

Product and category reports first reduce the fact to (bucket, product). That is the only shuffle
of fact rows; a best-seller is combined on the map side, and names join the reduced rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlake.functions import bucket, exact_mean, mean, since
from merchlake.plans.facts import money_columns, paid_lines
from merchlake.sources.shop import Shop

Day = dt.date | dt.datetime


def _in_range(lines: DataFrame, start: Day | None, end: Day | None) -> DataFrame:
    """Inclusive range, applied only if both ends are given."""
    if start is None or end is None:
        return lines
    return lines.filter(F.col("created_at").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def _last_weeks(shop: Shop, as_of: Day | None, weeks: int) -> DataFrame:
    return paid_lines(shop).filter(since(F.col("created_at"), as_of, weeks=weeks))


def totals(lines: DataFrame, unit: str) -> DataFrame:
    """Per bucket: lines, items, revenue (decimal) and distinct customers.

    A line id occurs once, so lines are counted plainly and one distinct count is left: Spark
    first reduces to (bucket, customer) and then counts.
    """
    return lines.groupBy(bucket(unit, F.col("created_at")).alias(unit)).agg(
        F.count("*").alias("order_count"),
        F.sum("quantity").alias("items_sold"),
        F.sum("amount").alias("revenue"),
        F.countDistinct("user_id").alias("unique_customers"),
    )


def by_product(lines: DataFrame, unit: str) -> DataFrame:
    """Per bucket and product id: quantity, revenue (decimal) and lines."""
    return lines.groupBy(bucket(unit, F.col("created_at")).alias(unit), F.col("product_id")).agg(
        F.sum("quantity").alias("quantity_sold"),
        F.sum("amount").alias("revenue"),
        F.count("*").alias("order_count"),
    )


def with_names(shop: Shop, sold: DataFrame, *, category: bool = False) -> DataFrame:
    products = shop.products.select(
        F.col("id").alias("_product"), F.col("name").alias("product_name"), "category_id"
    )
    named = sold.join(products, F.col("product_id") == F.col("_product"))
    if category:
        categories = shop.categories.select(F.col("id").alias("_category"), F.col("name").alias("category_name"))
        named = named.join(categories, F.col("category_id") == F.col("_category"))
    return named


def _by_name(shop: Shop, lines: DataFrame, unit: str) -> DataFrame:
    """Per bucket and product name: products of one name are added up."""
    named = with_names(shop, by_product(lines, unit))
    summed = named.groupBy(unit, "product_name").agg(
        F.sum("quantity_sold").alias("quantity_sold"), F.sum("revenue").alias("revenue")
    )
    return money_columns(summed, "revenue").orderBy(unit, F.desc("revenue"), "product_name")


def _by_category(shop: Shop, lines: DataFrame, unit: str, *keys: str) -> DataFrame:
    named = with_names(shop, by_product(lines, unit), category=True)
    return named.groupBy(unit, *keys).agg(
        F.sum("order_count").alias("order_count"),
        F.sum("quantity_sold").alias("items_sold"),
        F.sum("revenue").alias("revenue"),
    )


def monthly_sales(shop: Shop, start: Day | None = None, end: Day | None = None) -> DataFrame:
    months = totals(_in_range(paid_lines(shop), start, end), "month")
    average = mean(F.col("revenue"), F.col("order_count"))
    return money_columns(months.withColumn("average_order_value", average), "revenue").orderBy("month")


def monthly_product_sales(shop: Shop, start: Day | None = None, end: Day | None = None) -> DataFrame:
    sold = by_product(_in_range(paid_lines(shop), start, end), "month")
    named = with_names(shop, sold).select(
        "month", "product_name", "product_id", "quantity_sold", "revenue", "order_count"
    )
    return money_columns(named, "revenue").orderBy("month", F.desc("revenue"), "product_id")


def monthly_category_sales(shop: Shop, start: Day | None = None, end: Day | None = None) -> DataFrame:
    summed = _by_category(
        shop, _in_range(paid_lines(shop), start, end), "month", "category_name", "category_id"
    )
    return money_columns(summed, "revenue").orderBy("month", F.desc("revenue"), "category_id")


def monthly_summary(shop: Shop, start: Day | None = None, end: Day | None = None) -> DataFrame:
    """Totals over the months, and the unweighted mean of the monthly averages.

    Both means are decimals of twelve places, so they depend neither on the order of the months nor on a cut.
    """
    lines = _in_range(paid_lines(shop), start, end)
    months = lines.groupBy(bucket("month", F.col("created_at")).alias("month")).agg(
        F.count("*").alias("order_count"),
        F.sum("quantity").alias("items_sold"),
        F.sum("amount").alias("revenue"),
    )
    average = exact_mean(F.col("revenue"), F.col("order_count"))
    summary = months.agg(
        F.count("*").alias("total_months"),
        F.sum("order_count").alias("total_orders"),
        F.sum("items_sold").alias("total_items_sold"),
        F.sum("revenue").alias("total_revenue"),
        exact_mean(F.sum(average), F.count(average)).alias("overall_average_order_value"),
    )
    return money_columns(summary, "total_revenue", "overall_average_order_value")


def weekly_sales(shop: Shop, as_of: Day | None = None, weeks: int = 12) -> DataFrame:
    return money_columns(totals(_last_weeks(shop, as_of, weeks), "week"), "revenue").orderBy("week")


def weekly_product_sales(shop: Shop, as_of: Day | None = None, weeks: int = 12) -> DataFrame:
    return _by_name(shop, _last_weeks(shop, as_of, weeks), "week")


def yearly_sales(shop: Shop) -> DataFrame:
    return money_columns(totals(paid_lines(shop), "year"), "revenue").orderBy("year")


def yearly_product_sales(shop: Shop) -> DataFrame:
    return _by_name(shop, paid_lines(shop), "year")


def yearly_category_sales(shop: Shop) -> DataFrame:
    summed = _by_category(shop, paid_lines(shop), "year", "category_name")
    return money_columns(summed, "revenue").orderBy("year", F.desc("revenue"), "category_name")


def daily_product_sales(shop: Shop, condition: Column | None = None) -> DataFrame:
    """The roll-up base by (day, product): sums and counts of any longer bucket add up from it."""
    lines = paid_lines(shop) if condition is None else paid_lines(shop).filter(condition)
    return lines.groupBy(F.col("created_at").cast("date").alias("day"), "product_id").agg(
        F.sum("quantity").alias("quantity_sold"),
        F.sum("amount").alias("revenue"),
        F.count("*").alias("order_count"),
    )
