"""Data-quality rules and checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlake.functions import missing, missing_number, normalise_email, trimmed
from merchlake.operators import Rule, not_empty
from merchlake.schemas import DELIVERY_STATUSES, ORDER_STATUSES, USER_STATUSES
from merchlake.sources.payments import signature_is_valid
from merchlake.sources.shop import Shop

# Fixed patterns: a ten-digit phone number, and the shape local@domain.tld without blanks.
_PHONE = r"^[0-9]{10}$"
_EMAIL = r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$"


def normalised(forms: DataFrame) -> DataFrame:
    """Forms with the e-mail as it is stored, in small letters; what the rules refuse stays as it was sent."""
    email = F.col("email")
    return forms.withColumn("email", F.when(email.rlike(_EMAIL), normalise_email(email)).otherwise(email))


def customer_rules() -> list[Rule]:
    """A sign-up form; all failures are listed, in this order."""
    password = F.coalesce(F.col("password"), F.lit(""))
    return [
        not_empty("name", "Customer name is empty"),
        Rule("Customer name must be at least 3 characters long", F.length(trimmed(F.col("name"))) < 3),
        Rule("Invalid email address", ~F.coalesce(F.col("email"), F.lit("")).rlike(_EMAIL)),
        not_empty("address", "Address is required"),
        not_empty("phonenumber", "Phone number is required"),
        Rule("Phone number must be a valid 10-digit number", ~trimmed(F.col("phonenumber")).rlike(_PHONE)),
        Rule("Password must be at least 8 characters long", F.length(password) < 8),
        not_empty("confirm_password", "Confirm password is required"),
        Rule("Passwords do not match", trimmed(F.col("confirm_password")) != password),
    ]


def blog_rules() -> list[Rule]:
    return [
        not_empty("title", "Customer title is empty"),
        Rule("title  must be at least 3 characters long", F.length(trimmed(F.col("title"))) < 3),
        not_empty("cover_image", "coverImage is empty"),
        not_empty("text_content", "textContent is required"),
    ]


def product_rules() -> list[Rule]:
    """The first failing rule ends the check, so the second one applies to complete forms only."""
    fields = ["product_name", "price", "description", "category_id", "total_stock"]
    incomplete = reduce(lambda left, right: left | right, [missing(F.col(name)) for name in fields])
    no_image = F.coalesce(F.size("images"), F.lit(0)) <= 0
    return [
        Rule(
            "Please enter all required fields (productName, price, description, categoryId, totalStock)",
            incomplete,
        ),
        Rule("Please provide at least one image", ~incomplete & no_image),
    ]


def line_is_complete(line: Column) -> Column:
    """A payment line names product, quantity and total, none of them zero."""
    absent = (
        line["product_id"].isNull() | missing(line["product_name"])
        | missing_number(line["quantity"]) | missing_number(line["product_total"])
    )
    return ~absent


def payment_line_rules() -> list[Rule]:
    return [
        Rule("productId is missing", F.col("product_id").isNull()),
        Rule("productName is missing", missing(F.col("product_name"))),
        Rule("quantity is missing", missing_number(F.col("quantity"))),
        Rule("productTotal is missing", missing_number(F.col("product_total"))),
    ]


def address_is_incomplete() -> Column:
    parts = [missing(F.col(part)) for part in ("address", "city", "state", "country")]
    return reduce(lambda left, right: left | right, parts)


def delivery_address_rules() -> list[Rule]:
    return [Rule(
        "Delivery address details are incomplete. Please provide complete address information.",
        address_is_incomplete(),
    )]


def _count(df: DataFrame, check: str) -> DataFrame:
    return df.agg(F.count("*").alias("row_count")).select(F.lit(check).alias("check"), "row_count")


def orphans(shop: Shop) -> DataFrame:
    """Number of child rows without a parent, by relation.

    Children are first reduced to a count per key, so a popular key is one row in the join.
    """

    def relation(check: str, child: DataFrame, key: str, parent: DataFrame) -> DataFrame:
        per_key = child.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n"))
        alone = per_key.join(parent.select(F.col("id").alias("_id")), F.col("_key") == F.col("_id"), "left_anti")
        total = F.coalesce(F.sum("_n"), F.lit(0).cast("long"))
        return alone.agg(total.alias("row_count")).select(F.lit(check).alias("check"), "row_count")

    return reduce(DataFrame.unionByName, [
        relation("images without product", shop.images, "product_id", shop.products),
        relation("orders without product", shop.order_lines, "product_id", shop.products),
        relation("orders without user", shop.order_lines, "user_id", shop.users),
        relation("products without category", shop.products, "category_id", shop.categories),
    ])


def enum_domain(shop: Shop) -> DataFrame:
    """Number of rows per table whose status is not an allowed one. A null status is not allowed."""

    def outside(check: str, df: DataFrame, allowed: list[str]) -> DataFrame:
        wrong = F.col("status").isNull() | ~F.col("status").isin(allowed)
        return _count(df.filter(wrong), check)

    return reduce(DataFrame.unionByName, [
        outside("orders", shop.order_lines, ORDER_STATUSES),
        outside("deliveries", shop.deliveries, DELIVERY_STATUSES),
        outside("users", shop.users, USER_STATUSES),
    ])


def signature_check(events: DataFrame, secret: str) -> DataFrame:
    """Each event with the verdict on its signature."""
    return events.select(
        "event_id", signature_is_valid(F.col("body"), F.col("signature"), secret).alias("signature_ok")
    )


def duplicate_emails(users: DataFrame) -> DataFrame:
    """E-mails that occur more than once, with their number."""
    counts = users.groupBy("email").agg(F.count("*").alias("row_count"))
    return counts.filter(F.col("row_count") > 1)
