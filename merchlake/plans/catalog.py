"""Product and category lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlake.functions import timestamp_text
from merchlake.operators import attach_images, computed_once, page
from merchlake.plans.facts import (
    PRODUCT_COLUMNS, categorised, newest_first, oldest_first, paid_lines, sold_per_product,
)
from merchlake.sources.shop import Shop


def _any_of(column: str, keys: Sequence | None) -> Column | None:
    return None if keys is None else F.col(column).isin(list(keys))


def product_catalog(shop: Shop, page_no: int = 1, size: int = 10) -> DataFrame:
    """A page of products with category name and images, newest first."""
    order = newest_first(key="product_id")
    shown = page(categorised(shop), order, page_no, size)
    return attach_images(shown, shop.images, "product_id", few=True).orderBy(*order)


def category_products(shop: Shop, category_id: str | None = None) -> DataFrame:
    """All products of a category (or of each) with images, newest first."""
    keep = None if category_id is None else F.col("category_id") == category_id
    columns = [
        "product_id", "product_name", "category_id", "price", "status", "total_stock", "description",
        "created_at", "category_name",
    ]
    listed = categorised(shop, keep).select(columns)
    return attach_images(listed, shop.images, "product_id").orderBy(*newest_first(key="product_id"))


def product_detail(shop: Shop, product_ids: Sequence | None = None) -> DataFrame:
    """The given products (or all) with category name and images."""
    found = categorised(shop, _any_of("id", product_ids))
    return attach_images(found, shop.images, "product_id")


def product_with_images(shop: Shop, product_ids: Sequence | None = None) -> DataFrame:
    """Whole product rows of the given products (or all) with images."""
    keep = _any_of("id", product_ids)
    return attach_images(shop.products if keep is None else shop.products.filter(keep), shop.images)


def best_selling(shop: Shop, k: int = 10) -> DataFrame:
    """Active products by units sold; products without a sale are left out."""
    sold = sold_per_product(paid_lines(shop)).filter(F.col("units") > 0)
    ranked = categorised(shop, F.col("status")).join(sold, F.col("product_id") == F.col("sold_product_id"))
    order = [F.desc("total_sold"), F.desc("order_count"), F.col("product_id")]
    top = ranked.select(
        *PRODUCT_COLUMNS, "category_name",
        F.col("units").alias("total_sold"), F.col("line_count").alias("order_count"),
    ).orderBy(*order).limit(k)
    return attach_images(top, shop.images, "product_id", distinct=True, few=True).orderBy(*order)


def new_products(shop: Shop, k: int = 10) -> DataFrame:
    """The newest active products with units sold."""
    order = newest_first(key="product_id")
    top = computed_once(categorised(shop, F.col("status")).orderBy(*order).limit(k))
    # Only the short list's lines are counted: a semi join filters the fact where it is read.
    wanted = top.select(F.col("product_id").alias("_wanted"))
    lines = paid_lines(shop).join(wanted, F.col("product_id") == F.col("_wanted"), "left_semi")
    with_sales = _with_units(top, lines)
    return attach_images(with_sales, shop.images, "product_id", distinct=True, few=True).orderBy(*order)


def almost_sold_out(shop: Shop, max_stock: int = 10, low: int = 5) -> DataFrame:
    """Active products of little stock with units sold, scarcest first."""
    stock = F.col("total_stock")
    scarce = _with_units(categorised(shop, F.col("status") & (stock <= max_stock)), paid_lines(shop))
    label = F.when(stock <= low, "Low Stock").when(stock <= 10, "Medium Stock").otherwise("In Stock")
    listed = attach_images(scarce.withColumn("stock_status", label), shop.images, "product_id", distinct=True)
    return listed.orderBy(F.col("total_stock"), F.desc("total_sold"), F.col("product_id"))


def _with_units(products: DataFrame, lines: DataFrame) -> DataFrame:
    sold = sold_per_product(lines).select("sold_product_id", "units")
    joined = products.join(sold, F.col("product_id") == F.col("sold_product_id"), "left")
    return joined.withColumn("total_sold", F.coalesce("units", F.lit(0).cast("long"))).drop(
        "sold_product_id", "units"
    )


def _category_rows(shop: Shop, categories: DataFrame) -> DataFrame:
    counts = shop.products.groupBy(F.col("category_id").alias("_category")).agg(F.count("id").alias("n"))
    joined = categories.join(counts, F.col("id") == F.col("_category"), "left")
    return joined.select(
        F.col("id").alias("category_id"),
        F.col("name").alias("category_name"),
        "status",
        F.coalesce("n", F.lit(0).cast("long")).alias("product_count"),
        timestamp_text(F.col("created_at")).alias("created_at"),
    )


def category_counts(shop: Shop) -> DataFrame:
    """All categories with their number of products, newest first."""
    return _category_rows(shop, shop.categories).orderBy(*newest_first(key="category_id"))


def category_page(shop: Shop, page_no: int = 1, size: int = 10) -> DataFrame:
    """A page of categories with their number of products, oldest first."""
    shown = page(shop.categories, oldest_first(), page_no, size)
    return _category_rows(shop, shown).orderBy(*oldest_first(key="category_id"))


def products_json_images(
    shop: Shop, category_id: str | None = None, limit: int = 10, offset: int = 0
) -> DataFrame:
    """Products, oldest first, each with an array of its image ids and addresses."""
    products = shop.products
    if category_id is not None:
        products = products.filter(F.col("category_id") == category_id)
    shown = products.orderBy(*oldest_first()).offset(offset).limit(limit)
    image = F.struct(F.col("id").alias("image_id"), F.col("image_url").alias("image_url"))
    listed = attach_images(shown, shop.images, value=image, few=True)
    return listed.orderBy(*oldest_first()).select(
        F.col("id").alias("product_id"),
        F.col("name").alias("product_name"),
        F.col("price").alias("product_price"),
        F.col("description").alias("product_description"),
        F.col("status").alias("product_status"),
        timestamp_text(F.col("created_at")).alias("created_at"),
        "images",
    )
