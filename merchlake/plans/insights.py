"""The insights report: one long table of (type, category, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlake.plans.facts import money_columns, sold_per_product
from merchlake.sources.shop import Shop


def sales_by_product(shop: Shop) -> DataFrame:
    """Sales and quantity of each product, over all order states."""
    sold = sold_per_product(shop.order_lines)
    products = shop.products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"))
    named = sold.join(products, F.col("sold_product_id") == F.col("product_id")).select(
        "product_id", "product_name", F.col("revenue").alias("total_sales"), F.col("units").alias("total_quantity")
    )
    return money_columns(named, "total_sales")


def _entry(kind: str, category: Column, value: Column, owner: Column | None = None) -> Column:
    return F.struct(
        F.lit(kind).alias("type"),
        category.cast("string").alias("category"),
        value.cast("decimal(38,2)").alias("value"),
        (F.lit(None) if owner is None else owner).cast("string").alias("owner"),
    )


def insights(shop: Shop) -> DataFrame:
    """Sales by date, product, user and category over all states, totals of the successful ones,
    and the number of lines by state.

    One pass over the fact: grouping sets reduce it by product, by user and by (day, status) at
    once. The reduced rows get their names in one join and then become the entries of all parts.
    """
    lines = shop.order_lines.select(
        "product_id", "user_id", F.col("created_at").cast("date").alias("day"), "status", "amount"
    )
    keys = ["product_id", "user_id", "day", "status"]
    reduced = lines.groupingSets([["product_id"], ["user_id"], ["day", "status"]], *keys).agg(
        F.sum("amount").alias("paid"), F.count("*").alias("n"),
        F.grouping("product_id").alias("no_product"), F.grouping("user_id").alias("no_user"),
    )
    kind = F.when(F.col("no_product") == 0, "product").when(F.col("no_user") == 0, "user")
    key = F.coalesce(F.col("product_id").cast("string"), F.col("user_id").cast("string"))
    small = reduced.select(kind.alias("kind"), key.alias("key"), "day", "status", "paid", "n")

    categories = shop.categories.select(F.col("id").alias("_category"), F.col("name").alias("category_name"))
    products = shop.products.join(categories, F.col("category_id") == F.col("_category"), "left").select(
        F.lit("product").alias("kind"), F.col("id").cast("string").alias("key"), "name", "category_name"
    )
    users = shop.users.select(
        F.lit("user").alias("kind"), F.col("id").cast("string").alias("key"), "name",
        F.lit(None).cast("string").alias("category_name"),
    )
    names = products.unionByName(users).withColumn("known", F.lit(True))
    paid, done = F.col("paid"), F.col("status") == "success"
    # Products and users of one name stay apart, so the entry carries their key.
    entries = F.when(F.col("kind") == "product", F.when(F.col("known"), F.array(
        _entry("sales_by_product", F.col("name"), paid, F.col("key")),
        _entry("sales_by_category", F.col("category_name"), paid),
    ))).when(F.col("kind") == "user", F.when(F.col("known"), F.array(
        _entry("sales_by_user", F.col("name"), paid, F.col("key")),
    ))).otherwise(F.array(
        _entry("sales_by_date", F.col("day"), paid),
        _entry("status_distribution", F.col("status"), F.col("n")),
        _entry("order_summary", F.lit("Total Orders"), F.when(done, F.col("n")).otherwise(0)),
        _entry("order_summary", F.lit("Total Revenue"), F.when(done, paid)),
    ))
    named = small.join(names, ["kind", "key"], "left").select(F.inline(entries)).filter(
        (F.col("type") != "sales_by_category") | F.col("category").isNotNull()
    )
    # The two totals exist even where there is no order at all.
    totals = lines.sparkSession.range(1).select(F.inline(F.array(
        _entry("order_summary", F.lit("Total Orders"), F.lit(0)),
        _entry("order_summary", F.lit("Total Revenue"), F.lit(None)),
    )))
    summed = named.unionByName(totals).groupBy("type", "category", "owner").agg(F.sum("value").alias("value"))
    return money_columns(summed.drop("owner"), "value")
