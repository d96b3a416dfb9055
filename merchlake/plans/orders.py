"""Order lists and order details."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchlake.functions import from_minor
from merchlake.operators import (
    DIRECT_RANKS, asked_for, attach_images, computed_once, deep_page, envelope, first_rows, look_up, page, page_per, written_once,
)
from merchlake.plans.facts import money_columns, newest_first
from merchlake.sources.shop import Shop

_LINE = ["id", "reference", "product_id", "product_name", "customer_name", "amount"]
_PLACE = ["address", "city", "state", "country"]
# What a payment gives to the lines of its checkout.
PAYMENT_FIELDS = ["reference", "payment_status", "paid_at", "channel", "amount_minor", "customer_email", "card_type", "bank", "last4"]


def _deliveries(shop: Shop) -> DataFrame:
    return shop.deliveries.select(
        F.col("order_id").alias("_order"), *_PLACE, F.col("status").alias("delivery_status")
    )


def _emails(shop: Shop) -> DataFrame:
    return shop.users.select(F.col("id").alias("_user"), F.col("email").alias("user_email"))


def _page_lines(lines: DataFrame, page_no: int, size: int, direct: int) -> tuple[DataFrame, int]:
    """The lines to build a page from, a short list, and the number that the page has in this list.

    Up to ``direct`` rows deep it is the list's beginning, found as a top-k; deeper, the page alone.
    """
    if page_no * size <= direct:
        return computed_once(first_rows(lines, newest_first(), page_no, size)), page_no
    return computed_once(deep_page(lines, "created_at", "id", page_no, size).limit(size)), 1


def orders_page(shop: Shop, page_no: int = 1, size: int = 10, direct: int = DIRECT_RANKS) -> DataFrame:
    """A page of order lines with buyer's e-mail and delivery, newest first.

    The fact is read once for its first rows, or by day counts for a page deeper than ``direct`` rows;
    users and deliveries are filtered by those rows.
    """
    order = newest_first()
    columns = [*_LINE, "user_id", "quantity", "status", "created_at"]
    head, page_no = _page_lines(shop.order_lines.select(columns), page_no, size, direct)
    joined = look_up(head, _emails(shop), "user_id", "_user")
    joined = look_up(joined, _deliveries(shop), "reference", "_order", keys=head)
    shown = page(joined.select(*columns, "user_email", *_PLACE, "delivery_status"), order, page_no, size)
    return money_columns(shown, "amount")


def my_orders(shop: Shop, user_id=None, page_no: int = 1, size: int = 10, direct: int = DIRECT_RANKS) -> DataFrame:
    """A page of a user's order lines with their delivery; without a user, the same page of each.

    A page deeper than ``direct`` rows is found by day counts, so no user's list is sorted in one task.
    """
    columns = [*_LINE, "quantity", "status", "created_at"]
    lines = shop.order_lines.select(*columns, "user_id")
    if user_id is not None:
        head, page_no = _page_lines(lines.filter(F.col("user_id") == F.lit(user_id)), page_no, size, direct)
        joined = look_up(head, _deliveries(shop), "reference", "_order")
        shown = page(joined, newest_first(), page_no, size)
    else:
        if page_no * size <= direct:
            cut = page_per(lines, "user_id", newest_first(), page_no, size)
        else:
            cut = deep_page(lines, "created_at", "id", page_no, size, "user_id")
        # A checkout has one delivery, so the page can be cut before the join.
        shown = cut.join(_deliveries(shop), F.col("reference") == F.col("_order"), "left")
    return money_columns(shown.select(*columns, *_PLACE, "delivery_status"), "amount")


def order_details(shop: Shop, order_ids: Sequence | DataFrame | None = None) -> DataFrame:
    """The given order lines (or all) with user, delivery, product and images.

    With ids, a list or a table with a column ``id``, only the rows that the lines ask for go on of every
    other table. The lines are written once to the shared folder, since very many may be asked for.
    """
    lines = shop.order_lines.select(*_LINE, "quantity", "status", "created_at", "user_id")
    items, images, deliveries, emails = shop.products, shop.images, _deliveries(shop), _emails(shop)
    if order_ids is not None:
        if isinstance(order_ids, DataFrame):
            lines = asked_for(order_ids, "id", lines, "id")
        else:
            lines = lines.filter(F.col("id").isin(list(order_ids)))
        lines = written_once(lines, "asked-lines")
        items, images = asked_for(lines, "product_id", items, "id"), asked_for(lines, "product_id", images, "product_id")
        deliveries, emails = asked_for(lines, "reference", deliveries, "_order"), asked_for(lines, "user_id", emails, "_user")
    products = attach_images(items.select(F.col("id").alias("_product"), "description", "total_stock"), images, "_product")
    joined = (
        lines
        .join(deliveries, F.col("reference") == F.col("_order"), "left")
        .join(emails, F.col("user_id") == F.col("_user"), "left")
        .join(products, F.col("product_id") == F.col("_product"), "left")
    )
    detail = joined.select(
        *_LINE, "quantity", "status", "created_at", "user_email", *_PLACE, "delivery_status",
        "description", "total_stock",
        F.coalesce("images", F.array().cast("array<string>")).alias("images"),
    )
    return money_columns(detail, "amount")


def orders_by_reference(shop: Shop, references: Sequence | None = None) -> DataFrame:
    """Order lines of the given checkouts (or all) with product, images and delivery.

    With references, only the rows that the lines of those checkouts ask for go on of every other table.
    One reference may hold very many lines, so they are written once to the shared folder.
    """
    return _by_reference(shop, references)


def _by_reference(shop: Shop, references: Sequence | None, paid: DataFrame | None = None) -> DataFrame:
    """Lines with product, images and delivery; with ``paid`` only the lines of its checkouts, and its columns.

    What has the checkout as its key is joined first, so images are shuffled by their products alone.
    """
    lines = shop.order_lines.drop("product_name")
    items, images, deliveries = shop.products, shop.images, _deliveries(shop)
    if references is not None:
        lines = written_once(lines.filter(F.col("reference").isin(list(references))), "asked-lines")
        items, images = asked_for(lines, "product_id", items, "id"), asked_for(lines, "product_id", images, "product_id")
        deliveries = asked_for(lines, "reference", deliveries, "_order")
    products = attach_images(
        items.select(F.col("id").alias("_product"), F.col("name").alias("product_name"), "total_stock"), images, "_product",
    )
    if paid is not None:
        lines = lines.join(paid, F.col("reference") == F.col("_paid_reference"))
    joined = (
        lines
        .join(deliveries, F.col("reference") == F.col("_order"), "left")
        .join(products, F.col("product_id") == F.col("_product"))
    )
    detail = joined.select(
        "id", "reference", "product_id", "product_name", "customer_name", "amount", "status", "created_at",
        "updated_at", "total_stock", "images", *_PLACE, "delivery_status",
        *([] if paid is None else [name for name in paid.columns if name != "_paid_reference"]),
    )
    return money_columns(detail, "amount")


def order_payment_details(shop: Shop, payments: DataFrame, references: Sequence | None = None) -> DataFrame:
    """Order lines by checkout with fields of its successful payment.

    ``payments`` are parsed events, one per reference.
    """
    paid = payments.filter(F.col("payment_status") == "success").select(
        F.col("reference").alias("_paid_reference"), "payment_status", "paid_at", "channel",
        from_minor(F.col("amount_minor")).cast("double").alias("paid_amount"),
        "customer_email", "card_type", "bank", "last4",
    )
    return _by_reference(shop, references, paid)


def page_envelopes(shop: Shop, page_no: int = 1, size: int = 10) -> DataFrame:
    """Page arithmetic of every paged list; ``my_orders`` has one row per user."""

    def count(df: DataFrame, entity: str) -> DataFrame:
        return df.agg(F.count("*").alias("total_items")).select(F.lit(entity).alias("entity"), "total_items")

    per_user = shop.order_lines.groupBy("user_id").agg(F.count("*").alias("total_items")).select(
        F.concat(F.lit("my_orders:"), F.col("user_id").cast("string")).alias("entity"), "total_items"
    )
    counts = (
        count(shop.order_lines, "orders").unionByName(per_user).unionByName(count(shop.customers, "customers"))
        .unionByName(count(shop.categories, "categories")).unionByName(count(shop.blogs, "blogs"))
    )
    return envelope(counts, page_no, size, ~F.col("entity").isin("categories", "blogs"))
