"""Payment events and JSON order lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlake.functions import hmac_sha512

# The gateway's event fields. A line comes in one of two spellings.
_LINE = """struct<
    productId: string, productName: string, productTotal: decimal(18,2), quantity: bigint,
    product_id: string, name: string, product_total: decimal(18,2)>"""
_ADDRESS = "struct<address: string, city: string, state: string, country: string>"
EVENT_BODY = f"""struct<data: struct<
    reference: string, status: string, gateway_response: string, paid_at: string, channel: string,
    amount: bigint,
    customer: struct<email: string>,
    authorization: struct<card_type: string, bank: string, last4: string>,
    metadata: struct<userId: string,
        products: struct<productDescriptions: array<{_LINE}>, deliveryDetails: {_ADDRESS}>>>>"""
ORDER_LINES_JSON = "array<struct<productId: string, quantity: int>>"


def signature_is_valid(body: Column, signature: Column, secret: str) -> Column:
    """Never null: an absent signature is not valid."""
    return F.coalesce(hmac_sha512(body, secret) == signature, F.lit(False))


def parse_payment_events(events: DataFrame, key_type: str = "string") -> DataFrame:
    """Flat columns of events with a JSON ``body``; lines stay an array of one spelling. Other
    columns of the events are kept.

    The body is parsed in a generator: its result is a column like any other, so neither the
    fields nor the filters on them make Spark parse the text again.

    ``key_type`` is the type of the shop's keys. A key that does not fit it becomes null and is
    handled as missing by the rules on lines and users.
    """
    kept = [name for name in events.columns if name != "body"]
    parsed = events.select(*kept, F.inline_outer(F.array(F.from_json("body", EVENT_BODY))))
    data, meta = F.col("data"), F.col("data.metadata")
    address = meta["products"]["deliveryDetails"]

    def one_spelling(line: Column) -> Column:
        return F.struct(
            F.coalesce(line["product_id"], line["productId"]).try_cast(key_type).alias("product_id"),
            F.coalesce(line["name"], line["productName"]).alias("product_name"),
            line["quantity"].alias("quantity"),
            F.coalesce(line["product_total"], line["productTotal"]).alias("product_total"),
        )

    return parsed.select(
        *kept,
        data["reference"].try_cast(key_type).alias("reference"),
        data["status"].alias("payment_status"),
        data["gateway_response"].alias("gateway_response"),
        data["paid_at"].try_cast("timestamp").alias("paid_at"),
        data["channel"].alias("channel"),
        data["amount"].alias("amount_minor"),
        data["customer"]["email"].alias("customer_email"),
        data["authorization"]["card_type"].alias("card_type"),
        data["authorization"]["bank"].alias("bank"),
        data["authorization"]["last4"].alias("last4"),
        meta["userId"].try_cast(key_type).alias("user_id"),
        meta["products"].isNotNull().alias("has_products"),
        F.transform(meta["products"]["productDescriptions"], one_spelling).alias("lines"),
        *[address[part].alias(part) for part in ("address", "city", "state", "country")],
    )


def payment_lines(parsed: DataFrame, *keep: str) -> DataFrame:
    """One row per line of each event, numbered from 0."""
    return parsed.select(*keep, F.posexplode("lines").alias("line_no", "line")).select(
        *keep, "line_no", "line.*"
    )


def expand_lines(df: DataFrame, json_column: str, key_type: str = "string") -> DataFrame:
    """One row per element of a JSON array of ``{productId, quantity}``."""
    rest = [name for name in df.columns if name != json_column]
    return df.select(*rest, F.inline(F.from_json(json_column, ORDER_LINES_JSON))).select(
        *rest, F.col("productId").try_cast(key_type).alias("product_id"), F.col("quantity").cast("long")
    )
