"""Cart changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchlake.functions import first_reason, missing_number, stable_id
from merchlake.operators import first_request, reject_split
from merchlake.plans.changes.outcome import Outcome, rejected
from merchlake.sources.shop import Shop
from merchlake.sources.snapshots import with_defaults

# What the events of a cart log mean.
SET, REMOVE, PAYMENT = "click", "error", "purchase"


def last_payments(log: DataFrame) -> DataFrame:
    """Time and id of each user's last payment, which cleared the cart."""
    return log.filter(F.col("event_type") == PAYMENT).groupBy(F.col("user_id").alias("_payer")).agg(
        F.max(F.struct("ts", "event_id")).alias("_paid")
    )


def last_settings(log: DataFrame) -> DataFrame:
    """The last set or remove per (user, product).

    A maximum of (time, id) with the values attached combines on the map side, where a window over
    the log of a busy user would gather it in one task.
    """
    at = F.struct("ts", "event_id")
    return log.filter(F.col("event_type").isin(SET, REMOVE)).groupBy("user_id", "product_id").agg(
        F.max(at).alias("_at"),
        F.max_by(F.struct("event_type", "quantity"), at).alias("_last"),
    )


def carts_from(settings: DataFrame, payments: DataFrame) -> DataFrame:
    """Cart rows: what was set last and after the user's last payment, and not removed."""
    joined = settings.filter(F.col("_last.event_type") == SET).join(
        payments, F.col("user_id") == F.col("_payer"), "left"
    )
    kept = joined.filter(F.col("_paid").isNull() | (F.col("_at") > F.col("_paid")))
    key = F.concat(F.lit("c"), F.col("user_id").cast("string"), F.lit("-"), F.col("product_id").cast("string"))
    return kept.select(
        key.alias("id"), "user_id", "product_id", F.col("_last.quantity").alias("quantity"),
        F.col("_at.ts").alias("created_at"), F.col("_at.ts").alias("updated_at"),
    )


def cart_state(log: DataFrame) -> DataFrame:
    """The carts after a whole log."""
    return carts_from(last_settings(log), last_payments(log))


def merge_settings(one: DataFrame, other: DataFrame) -> DataFrame:
    """The last settings of two pieces of a log. The order of the pieces does not matter."""
    return one.unionByName(other).groupBy("user_id", "product_id").agg(
        F.max("_at").alias("_at"), F.max_by("_last", "_at").alias("_last")
    )


def merge_payments(one: DataFrame, other: DataFrame) -> DataFrame:
    return one.unionByName(other).groupBy("_payer").agg(F.max("_paid").alias("_paid"))


def apply_adds(shop: Shop, requests: DataFrame) -> Outcome:
    """Put products into carts: a product already there gets the new quantity, not the sum."""
    products = shop.products.select(F.col("id").alias("_product"), "total_stock")
    looked_up = requests.join(products, F.col("product_id") == F.col("_product"), "left")
    accepted, refused = reject_split(looked_up, first_reason(
        (F.col("product_id").isNull() | missing_number(F.col("quantity")), "Product ID and quantity are required"),
        (F.col("_product").isNull(), "Product not found"),
        (F.col("total_stock") < F.col("quantity"), "Not enough stock available"),
    ))
    order = F.struct("request_id", "requested_at", "quantity")
    latest = accepted.groupBy("user_id", "product_id").agg(F.max(order).alias("_new"))
    # Full join: changed rows, untouched rows and new rows in one pass over both sides.
    key_type = shop.key_type("carts", "id")
    state = shop.carts.join(latest, ["user_id", "product_id"], "full").select(
        F.coalesce("id", stable_id(F.lit("cart"), F.col("user_id"), F.col("product_id"), key_type=key_type)).alias("id"),
        "user_id", "product_id",
        F.coalesce("_new.quantity", "quantity").alias("quantity"),
        F.coalesce("created_at", "_new.requested_at").alias("created_at"),
        F.coalesce("_new.requested_at", "updated_at").alias("updated_at"),
    )
    written = state.join(latest.select("user_id", "product_id"), ["user_id", "product_id"], "left_semi").select(state.columns)
    return Outcome({"carts": state}, refused.select("request_id", "reason"), written)


def set_quantities(shop: Shop, requests: DataFrame) -> Outcome:
    """Change the quantity of own cart rows; the last accepted request counts."""
    products = shop.products.select(F.col("id").alias("_product"), "total_stock")
    rows = shop.carts.join(products, F.col("product_id") == F.col("_product")).select(
        F.col("id").alias("_cart"), F.col("user_id").alias("_owner"), "total_stock"
    )
    own = (F.col("cart_id") == F.col("_cart")) & (F.col("user_id") == F.col("_owner"))
    accepted, refused = reject_split(requests.join(rows, own, "left"), first_reason(
        (missing_number(F.col("quantity")) | (F.col("quantity") < 1), "Valid quantity is required"),
        (F.col("_cart").isNull(), "Cart item not found"),
        (F.col("total_stock") < F.col("quantity"), "Not enough stock available"),
    ))
    latest = accepted.groupBy("_cart").agg(F.max(F.struct("request_id", "requested_at", "quantity")).alias("_new"))
    state = shop.carts.join(latest, F.col("id") == F.col("_cart"), "left").select(
        "id", "user_id", "product_id",
        F.coalesce("_new.quantity", "quantity").alias("quantity"),
        "created_at",
        F.coalesce("_new.requested_at", "updated_at").alias("updated_at"),
    )
    written = state.join(latest.select("_cart"), F.col("id") == F.col("_cart"), "left_semi")
    return Outcome({"carts": state}, refused.select("request_id", "reason"), written)


def remove_rows(shop: Shop, requests: DataFrame) -> Outcome:
    """Remove own cart rows. A second removal of the same row finds nothing."""
    rows = shop.carts.select(F.col("id").alias("_cart"), F.col("user_id").alias("_owner"))
    own = (F.col("cart_id") == F.col("_cart")) & (F.col("user_id") == F.col("_owner"))
    done = first_request(requests, "cart_id", "user_id").join(rows, own, "left_semi")
    gone = done.select(F.col("cart_id").alias("_gone"))
    refused = requests.join(done.select("request_id"), "request_id", "left_anti")
    state = shop.carts.join(gone, F.col("id") == F.col("_gone"), "left_anti")
    removed = shop.carts.join(gone, F.col("id") == F.col("_gone"), "left_semi")
    return Outcome({"carts": state}, rejected(refused, "Cart item not found"), removed)


def clear_carts(shop: Shop, paying_users: DataFrame) -> Outcome:
    """Remove all cart rows of users who paid."""
    payers = paying_users.select(F.col("user_id").alias("_payer")).distinct()
    state = shop.carts.join(payers, F.col("user_id") == F.col("_payer"), "left_anti")
    none = paying_users.sparkSession.createDataFrame([], "request_id string, reason string")
    cleared = shop.carts.join(payers, F.col("user_id") == F.col("_payer"), "left_semi")
    return Outcome({"carts": state}, none, cleared)


def orders_from_carts(shop: Shop, payments: DataFrame, as_of=None) -> Outcome:
    """One successful order line per cart row of each payment ``(reference, user_id, status)``.

    The paid rows leave the cart. A payment that failed is rejected and changes nothing.
    """
    paid, failed = reject_split(
        payments, F.when(~F.col("status").eqNullSafe("success"), "Payment verification failed")
    )
    products = shop.products.select(F.col("id").alias("_product"), F.col("name").alias("product_name"), "price")
    buyers = shop.users.select(F.col("id").alias("_buyer"), F.col("name").alias("customer_name"))
    lines = (
        shop.carts.select("user_id", "product_id", "quantity")
        .join(paid.select("reference", F.col("user_id").alias("_payer")), F.col("user_id") == F.col("_payer"))
        .join(products, F.col("product_id") == F.col("_product"))
        .join(buyers, F.col("user_id") == F.col("_buyer"), "left")
    )
    amount = F.col("price").cast("decimal(18,2)") * F.col("quantity").cast("decimal(12,0)")
    rows = lines.select(
        "reference", "product_id", "product_name", "customer_name", "user_id", "quantity",
        amount.cast("decimal(18,2)").alias("amount"), F.lit("success").alias("status"),
    )
    row_id = stable_id(F.col("reference"), F.col("product_id"), key_type=shop.key_type("order_lines", "id"))
    orders = with_defaults(rows, "order_lines", row_id, as_of)
    left = clear_carts(shop, paid).state["carts"]
    rejects = failed.select(F.col("reference").alias("request_id"), "reason")
    return Outcome({"order_lines": orders, "carts": left}, rejects, orders)
