"""Customer and address lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchlake.operators import computed_once, page
from merchlake.plans.facts import newest_first
from merchlake.sources.shop import Shop


def customers_page(shop: Shop, page_no: int = 1, size: int = 10) -> DataFrame:
    """A page of address rows with the user's name, e-mail and number of order lines."""
    users = shop.users.select(F.col("id").alias("_user"), F.col("name").alias("user_name"), F.col("email").alias("user_email"))
    order = newest_first(key="customer_id")
    rows = shop.customers.join(users, F.col("user_id") == F.col("_user")).select(
        F.col("id").alias("customer_id"), "user_id", F.col("phonenumber").alias("phone_number"), "address",
        "created_at", "user_name", "user_email",
    )
    shown = computed_once(page(rows, order, page_no, size))
    # The fact is filtered by the page's users where it is read, then counted.
    wanted = shown.select(F.col("user_id").alias("_wanted")).distinct()
    lines = shop.order_lines.select(F.col("user_id").alias("_buyer"))
    counts = (
        lines.join(wanted, F.col("_buyer") == F.col("_wanted"), "left_semi")
        .groupBy("_buyer").agg(F.count("*").alias("n"))
    )
    joined = shown.join(counts, F.col("user_id") == F.col("_buyer"), "left")
    with_count = joined.withColumn("order_count", F.coalesce("n", F.lit(0).cast("long"))).drop("_buyer", "n")
    return with_count.orderBy(*order)


def addresses(shop: Shop, user_id=None) -> DataFrame:
    """Addresses of a user (or of all), default first, then newest."""
    rows = shop.customers if user_id is None else shop.customers.filter(F.col("user_id") == F.lit(user_id))
    columns = ["id", "address", "city", "state", "country", "is_default_address", "created_at"]
    return rows.select(columns).orderBy(F.desc_nulls_last("is_default_address"), *newest_first())
