"""The dashboard's figures and short lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchlake.functions import mean, money
from merchlake.operators import as_document, one_row, rows_as_list
from merchlake.plans.facts import money_columns, paid_lines, sold_per_product
from merchlake.sources.shop import Shop


def dashboard(shop: Shop, low: int = 5) -> DataFrame:
    """One row of product, category and sales figures."""
    products = shop.products.agg(
        F.count("*").alias("total_products"),
        F.sum("total_stock").alias("total_stock"),
        F.count_if(F.col("total_stock") <= low).alias("low_stock_count"),
        F.count_if("status").alias("active_products"),
        mean(F.sum(money(F.col("price"))), F.count("price")).alias("average_price"),
    )
    categories = shop.categories.agg(
        F.count("*").alias("total_categories"),
        F.count_if("status").alias("active_categories"),
    )
    sales = paid_lines(shop).agg(
        F.count("*").alias("total_orders"),
        F.sum("quantity").alias("total_items_sold"),
        F.sum("amount").alias("total_revenue"),
        F.countDistinct("user_id").alias("unique_customers"),
        mean(F.sum("amount"), F.count("amount")).alias("average_order_value"),
    )
    return one_row(products, categories, money_columns(sales, "total_revenue"))


def top_products(shop: Shop, k: int = 5) -> DataFrame:
    """Products by units sold; unsold products count as zero and come last."""
    sold = sold_per_product(paid_lines(shop))
    joined = shop.products.join(sold, F.col("id") == F.col("sold_product_id"), "left")
    ranked = joined.select(
        "id", "name", "price",
        F.col("total_stock").alias("stock"),
        F.coalesce("units", F.lit(0).cast("long")).alias("total_sold"),
        F.coalesce(F.col("revenue").cast("double"), F.lit(0.0)).alias("total_revenue"),
    )
    return ranked.orderBy(F.desc("total_sold"), "id").limit(k)


def low_stock(shop: Shop, k: int = 5, low: int = 5) -> DataFrame:
    """Products of the lowest stock with their category's name."""
    names = shop.categories.select(F.col("id").alias("_category"), F.col("name").alias("category_name"))
    scarce = shop.products.filter(F.col("total_stock") <= low)
    joined = scarce.join(names, F.col("category_id") == F.col("_category"))
    listed = joined.select("id", "name", F.col("total_stock").alias("stock"), "category_name")
    return listed.orderBy("stock", "id").limit(k)


def category_sales(shop: Shop) -> DataFrame:
    """All categories with lines, items and revenue, also those without a sale."""
    sold = sold_per_product(paid_lines(shop))
    products = shop.products.select(F.col("id").alias("_product"), F.col("category_id").alias("_category"))
    per_category = (
        sold.join(products, F.col("sold_product_id") == F.col("_product"))
        .groupBy("_category")
        .agg(
            F.sum("line_count").alias("n"), F.sum("units").alias("units"), F.sum("revenue").alias("paid")
        )
    )
    zero = F.lit(0).cast("long")
    joined = shop.categories.join(per_category, F.col("id") == F.col("_category"), "left").select(
        "id", "name",
        F.coalesce("n", zero).alias("order_count"),
        F.coalesce("units", zero).alias("items_sold"),
        F.coalesce(F.col("paid").cast("double"), F.lit(0.0)).alias("revenue"),
    )
    return joined.orderBy(F.desc("revenue"), "id")


def dashboard_document(shop: Shop, low: int = 5, k: int = 5) -> DataFrame:
    """The dashboard as one JSON document. Category sales are included: one entry per category."""
    figures = dashboard(shop, low)
    groups = {
        "productMetrics": [
            "total_products", "total_stock", "low_stock_count", "active_products", "average_price"],
        "categoryMetrics": ["total_categories", "active_categories"],
        "salesMetrics": [
            "total_orders", "total_items_sold", "total_revenue", "unique_customers", "average_order_value"],
    }
    parts = {name: F.struct(*columns) for name, columns in groups.items()}
    return figures.select(as_document(
        **parts,
        topProducts=rows_as_list(top_products(shop, k), -F.col("total_sold"), F.col("id")),
        lowStockProducts=rows_as_list(low_stock(shop, k, low), F.col("stock"), F.col("id")),
        categorySales=rows_as_list(category_sales(shop), -F.col("revenue"), F.col("id")),
    ).alias("document"))
