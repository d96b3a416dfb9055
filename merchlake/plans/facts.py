"""Shared inputs of the reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlake.functions import as_double
from merchlake.sources.shop import Shop

PRODUCT_COLUMNS = [
    "product_id", "product_name", "category_id", "price", "status", "total_stock", "description",
    "benefits", "howtouse", "ingredients", "created_at",
]


def paid_lines(shop: Shop) -> DataFrame:
    """Lines of successful orders."""
    return shop.order_lines.filter(F.col("status") == "success")


def sold_per_product(lines: DataFrame) -> DataFrame:
    """Units, line count and revenue by product: one row per product before any join.

    A product that holds a large part of all lines is reduced on the map side.
    """
    return lines.groupBy(F.col("product_id").alias("sold_product_id")).agg(
        F.sum("quantity").alias("units"),
        F.count("*").alias("line_count"),
        F.sum("amount").alias("revenue"),
    )


def categorised(shop: Shop, keep: Column | None = None) -> DataFrame:
    """Products that have a category, with its name, under the report's column names."""
    products = shop.products if keep is None else shop.products.filter(keep)
    renamed = products.withColumnsRenamed({"id": "product_id", "name": "product_name"}).select(PRODUCT_COLUMNS)
    names = shop.categories.select(F.col("id").alias("_category"), F.col("name").alias("category_name"))
    return renamed.join(names, F.col("category_id") == F.col("_category")).drop("_category")


def newest_first(created: str = "created_at", key: str = "id") -> list[Column]:
    return [F.col(created).desc_nulls_last(), F.col(key)]


def oldest_first(created: str = "created_at", key: str = "id") -> list[Column]:
    return [F.col(created).asc_nulls_last(), F.col(key)]


def money_columns(df: DataFrame, *names: str) -> DataFrame:
    """Decimal results as double, at the edge of a report."""
    return df.withColumns({name: as_double(F.col(name)) for name in names})
