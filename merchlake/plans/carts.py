"""Cart views, checkout quotes and the pricing of JSON orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchlake.functions import first_reason, line_total, to_minor
from merchlake.operators import asked_for, attach_images, written_once
from merchlake.plans.facts import money_columns, newest_first
from merchlake.sources.payments import expand_lines
from merchlake.sources.shop import Shop


def _priced(shop: Shop, carts: DataFrame) -> DataFrame:
    """Cart rows whose product exists, with the product's data."""
    products = shop.products.select(
        F.col("id").alias("_product"), F.col("name").alias("product_name"), "price", "description",
        "total_stock", "status",
    )
    return carts.join(products, F.col("product_id") == F.col("_product")).drop("_product")


def cart_view(shop: Shop, user_id=None) -> DataFrame:
    """Cart lines of a user (or of all) with product data, images and the cart's total.

    The total is a grouping joined back by user, not a window: a window would sort all lines of
    one cart in one task.
    """
    carts, images = shop.carts, shop.images
    if user_id is not None:
        # Only the images of the cart's products are collected. A cart may be long, so it is written once.
        carts = written_once(carts.filter(F.col("user_id") == F.lit(user_id)), "asked-cart")
        images = asked_for(carts, "product_id", images, "product_id")
    priced = _priced(shop, carts)
    totals = priced.groupBy(F.col("user_id").alias("_owner")).agg(
        F.sum(line_total(F.col("price"), F.col("quantity"))).alias("cart_total")
    )
    joined = priced.join(totals, F.col("user_id") == F.col("_owner"))
    viewed = attach_images(joined, images, "product_id").select(
        F.col("id").alias("cart_id"), "quantity", "created_at", "updated_at", "product_id", "product_name",
        "price", "description", "total_stock", "status", "images", "cart_total",
    )
    return money_columns(viewed, "cart_total").orderBy(*newest_first(key="cart_id"))


def checkout_quote(shop: Shop, requests: DataFrame | None = None) -> DataFrame:
    """Per checkout request: total in minor units, lines and delivery address, or a reason.

    ``requests`` holds ``(user_id, address_id)``; a null address means the default one. Without
    requests, every user is quoted with the default address.
    """
    if requests is None:
        requests = shop.users.select(
            F.col("id").alias("user_id"), F.lit(None).cast(shop.key_type("customers", "id")).alias("address_id")
        )
    places = shop.customers.select(
        F.col("user_id").alias("_owner"), F.col("id").alias("_address"), "address", "city", "state", "country",
        "is_default_address",
    )
    wanted = F.when(F.col("address_id").isNull(), F.col("is_default_address")).otherwise(
        F.col("address_id") == F.col("_address")
    )
    placed = requests.join(places, (F.col("user_id") == F.col("_owner")) & wanted, "left")

    total = line_total(F.col("price"), F.col("quantity"))
    short = F.col("total_stock") < F.col("quantity")
    line = F.struct(
        "product_id", "product_name", "quantity", F.col("price"), total.cast("double").alias("product_total")
    )
    carts = _priced(shop, shop.carts).groupBy(F.col("user_id").alias("_buyer")).agg(
        F.sum(total).alias("total"),
        F.sort_array(F.collect_list(line)).alias("lines"),
        # The first short line by product, as the message names one product.
        F.min_by(F.when(short, F.col("product_name")), F.when(short, F.col("product_id"))).alias("short_product"),
        F.count_if(short).alias("short_lines"),
    )
    quoted = placed.join(carts, F.col("user_id") == F.col("_buyer"), "left")
    no_address = F.col("_address").isNull()
    reason = F.coalesce(
        first_reason(
            (no_address & F.col("address_id").isNotNull(), "Address not found"),
            (no_address, "No default address found. Please add an address first."),
            (F.col("_buyer").isNull(), "Cart is empty"),
        ),
        F.when(F.col("short_lines") > 0, F.concat(F.lit("Not enough stock for "), F.col("short_product"))),
    )
    good = F.col("reason").isNull()
    return quoted.withColumn("reason", reason).select(
        "user_id",
        F.when(good, to_minor(F.col("total"))).alias("amount_minor"),
        F.when(good, F.col("lines")).alias("lines"),
        *[F.when(good, F.col(part)).alias(part) for part in ("address", "city", "state", "country")],
        "reason",
    )


def json_order_quote(shop: Shop, orders: DataFrame, json_column: str = "lines") -> DataFrame:
    """Orders of ``(order_key, JSON lines)`` priced against the products.

    Lines of unknown products drop out. The order's total is a grouping joined back by key.
    """
    lines = expand_lines(orders, json_column, shop.key_type("products", "id"))
    products = shop.products.select(F.col("id").alias("_product"), "name", "description", "price")
    priced = (
        lines.join(products, F.col("product_id") == F.col("_product"))
        .drop("_product")
        .withColumn("product_total", line_total(F.col("price"), F.col("quantity")))
    )
    totals = priced.groupBy(F.col("order_key").alias("_key")).agg(F.sum("product_total").alias("total_price"))
    quoted = priced.join(totals, F.col("order_key") == F.col("_key")).select(
        "order_key", "product_id", "name", "description", "price", "quantity", "product_total", "total_price"
    )
    return money_columns(quoted, "product_total", "total_price")
