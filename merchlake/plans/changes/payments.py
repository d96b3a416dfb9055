"""From payment events to orders, stock, carts and deliveries."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchlake.functions import first_reason, stable_id
from merchlake.plans.changes.carts import clear_carts
from merchlake.plans.quality import address_is_incomplete, line_is_complete
from merchlake.sources.payments import parse_payment_events, payment_lines, signature_is_valid
from merchlake.sources.shop import Shop
from merchlake.sources.snapshots import with_defaults

_PLACE = ["address", "city", "state", "country"]


class Payments(NamedTuple):
    """Accepted payments (one per new reference), their complete lines, and rejected events."""

    accepted: DataFrame
    lines: DataFrame
    rejects: DataFrame


def signed_payments(events: DataFrame, secret: str, key_type: str) -> DataFrame:
    """Parsed events with the verdict on their signature in ``signature_ok``."""
    verdict = signature_is_valid(F.col("body"), F.col("signature"), secret)
    return parse_payment_events(events.select("event_id", "body", verdict.alias("signature_ok")), key_type)


def paid():
    """Genuine, successful, and with a reference that fits the shop's keys."""
    return F.col("signature_ok") & F.col("payment_status").eqNullSafe("success") & F.col("reference").isNotNull()


def valid_payments(parsed: DataFrame) -> DataFrame:
    """The first sending of each reference among the genuine, successful payments, by one grouping."""
    fields = [name for name in parsed.columns if name not in ("reference", "lines")]
    first = F.min_by(F.struct(*fields), F.col("event_id")).alias("_first")
    return parsed.filter(paid()).groupBy("reference").agg(first).select("reference", "_first.*")


def faulted_payments(shop: Shop, parsed: DataFrame) -> DataFrame:
    """Parsed events with their complete lines, the customer's name, and ``fault``: what is wrong with the order itself."""
    users = shop.users.select(F.col("id").alias("_user"), F.col("name").alias("customer_name"))
    fault = first_reason(
        (~F.col("has_products"), "Invalid payment metadata"),
        (F.col("lines").isNull(), "Invalid product descriptions"),
        (
            address_is_incomplete(),
            "Delivery address details are incomplete. Please provide complete address information.",
        ),
        (F.col("_user").isNull(), "User not found"),
        (F.size("lines") == 0, "No valid orders were created"),
    )
    complete = parsed.withColumn("lines", F.filter("lines", line_is_complete))
    return complete.join(users, F.col("user_id") == F.col("_user"), "left").withColumn("fault", fault).drop("_user")


def refusal():
    """Why an event is refused whatever else is sent for its reference; null if that decides."""
    failure = F.concat(F.lit("Payment verification failed: "), F.coalesce("gateway_response", F.lit("Unknown error")))
    return F.coalesce(
        F.when(~F.col("signature_ok"), "Invalid signature"),
        F.when(~F.col("payment_status").eqNullSafe("success"), failure),
        F.when(F.col("reference").isNull(), "Invalid payment reference"),
    )


def judge_payments(shop: Shop, parsed: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Parsed events with ``is_new`` and, where they are refused, a ``reason``.

    Every event is judged for itself; of the acceptable ones of a reference the first counts. A bad
    sending before it is refused and does not stand in its way. What comes after it, or for a
    reference that already has orders, is passed over, so the same events can be applied any number
    of times, in one batch or in many. ``stored`` are the references with orders; by default those of
    ``shop.order_lines``.

    The events are read several times here, so write the result of :func:`signed_payments` to the
    shared folder first (``write_snapshot``): the passes then read columns instead of JSON.
    """
    if stored is None:
        stored = shop.order_lines.select("reference")
    events = faulted_payments(shop, parsed)
    # One row per reference still to be booked, so that the stored ones are joined once and to narrow rows.
    sound = F.when(F.col("fault").isNull(), F.col("event_id"))
    asked = events.filter(paid()).groupBy(F.col("reference").alias("_reference")).agg(F.min(sound).alias("_first"))
    unbooked = asked.join(stored.select(F.col("reference").alias("_stored")), F.col("_reference") == F.col("_stored"), "left_anti")
    # Events without a reference find none: kept out of the join, they do not meet in one task.
    named = events.filter(F.col("reference").isNotNull()).join(unbooked, F.col("reference") == F.col("_reference"), "left")
    nameless = events.filter(F.col("reference").isNull()).withColumns({
        name: F.lit(None).cast(unbooked.schema[name].dataType) for name in unbooked.columns
    })
    judged = named.unionByName(nameless)
    is_open = paid() & F.col("_reference").isNotNull()
    is_new = is_open & F.col("fault").isNull() & F.col("event_id").eqNullSafe(F.col("_first"))
    before = F.col("_first").isNull() | (F.col("event_id") < F.col("_first"))
    # Everything else passed over is a repeat: neither new nor refused.
    reason = F.coalesce(refusal(), F.when(is_open & before, F.col("fault")))
    return judged.withColumns({"is_new": is_new, "reason": reason}).drop("_first", "fault", "_reference")


def split_payments(judged: DataFrame) -> Payments:
    """What becomes orders, and what was refused."""
    accepted = judged.filter(F.col("is_new") & F.col("reason").isNull())
    rejects = judged.filter(F.col("reason").isNotNull()).select(F.col("event_id").alias("request_id"), "reason")
    lines = payment_lines(accepted, "reference", "user_id", "customer_name", "paid_at")
    return Payments(accepted, lines, rejects)


def new_payments(shop: Shop, parsed: DataFrame, stored: DataFrame | None = None) -> Payments:
    """Judge and split in one go. For several outputs, store the judged events in between."""
    return split_payments(judge_payments(shop, parsed, stored))


def order_rows(shop: Shop, lines: DataFrame) -> DataFrame:
    """One successful order per payment line, dated by the payment."""
    rows = lines.select(
        "reference", "product_id", "product_name", "customer_name", "user_id", "quantity",
        F.col("product_total").alias("amount"), F.lit("success").alias("status"),
        F.col("paid_at").alias("created_at"), F.col("paid_at").alias("updated_at"), "line_no",
    )
    row_id = stable_id(F.col("reference"), F.col("line_no"), key_type=shop.key_type("order_lines", "id"))
    return with_defaults(rows, "order_lines", row_id)


def delivery_rows(accepted: DataFrame) -> DataFrame:
    """One pending delivery per accepted payment, under its reference."""
    rows = accepted.select(
        F.col("reference").alias("order_id"), *_PLACE, F.lit("pending").alias("status"),
        F.col("paid_at").alias("created_at"),
    )
    return with_defaults(rows, "deliveries")


def decrement_stock(products: DataFrame, lines: DataFrame) -> DataFrame:
    """Products with the ordered quantities taken off, and a flag for stock below zero.

    Quantities are summed per product first: a product in very many lines is one row in the join.
    """
    taken = lines.groupBy(F.col("product_id").alias("_product")).agg(F.sum("quantity").alias("_taken"))
    kind = products.schema["total_stock"].dataType
    left = F.col("total_stock").cast("long") - F.coalesce("_taken", F.lit(0).cast("long"))
    joined = products.join(taken, F.col("id") == F.col("_product"), "left")
    # The stored type stays; an amount beyond it is left as null and stands out, since stock is never null.
    return joined.withColumn("total_stock", left.try_cast(kind)).withColumn("oversold", F.coalesce(F.col("total_stock") < 0, F.lit(True))).select(
        *products.columns, "oversold"
    )


def apply_payments(shop: Shop, payments: Payments) -> dict[str, DataFrame]:
    """All that a batch of payment events changes: new orders and deliveries to append, the new
    state of products and carts, and rejects.
    """
    orders = order_rows(shop, payments.lines)
    return {
        "order_lines": orders,
        "deliveries": delivery_rows(payments.accepted),
        "products": decrement_stock(shop.products, orders),
        "carts": clear_carts(shop, payments.accepted.select("user_id")).state["carts"],
        "rejects": payments.rejects,
    }
