"""Declared tables of the shop: columns, types, defaults and allowed values."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

# Allowed states per table, and the two roles.
ORDER_STATUSES = ["success", "declined", "pending", "initiated"]
DELIVERY_STATUSES = ["sentout", "delivered", "pending", "initiated"]
USER_STATUSES = [
    "approved", "declined", "pending", "suspended", "false", "true",
    "activate", "deactivate", "deactivated", "activated", "reactivate",
]
ROLE_NAMES = {1: "ADMIN", 2: "USER"}

_string, _long, _int = T.StringType(), T.LongType(), T.IntegerType()
_bool, _double, _ts = T.BooleanType(), T.DoubleType(), T.TimestampType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


SCHEMAS: dict[str, T.StructType] = {
    "products": _table(
        id=_long, category_id=_string, name=_string, description=_string, howtouse=_string,
        ingredients=_string, benefits=_string, price=_double, user_id=_long, total_stock=_int,
        status=_bool, created_at=_ts, updated_at=_ts,
    ),
    "categories": _table(id=_string, name=_string, status=_bool, created_at=_ts, updated_at=_ts),
    "images": _table(id=_string, product_id=_long, image_url=_string),
    "order_lines": _table(
        id=_string, reference=_long, product_id=_long, product_name=_string, customer_name=_string,
        amount=MONEY, user_id=_long, quantity=_long, status=_string, created_at=_ts, updated_at=_ts,
    ),
    "deliveries": _table(
        order_id=_long, address=_string, city=_string, state=_string, country=_string,
        postal_code=_string, delivery_fee=_double, status=_string, created_at=_ts,
    ),
    "users": _table(
        id=_long, name=_string, email=_string, role_id=_int, role_name=_string,
        verified=_bool, status=_string, created_at=_ts,
    ),
    "customers": _table(
        id=_string, user_id=_long, phonenumber=_string, address=_string, city=_string,
        state=_string, country=_string, is_default_address=_bool, created_at=_ts,
    ),
    "carts": _table(
        id=_string, user_id=_long, product_id=_long, quantity=_long, created_at=_ts, updated_at=_ts,
    ),
    "blogs": _table(
        id=_long, title=_string, cover_image=_string, text_content=_string, status=_bool,
        likes=_int, unlikes=_int, created_at=_ts, updated_at=_ts,
    ),
    "cart_log": _table(
        event_id=_long, ts=_ts, user_id=_long, event_type=_string, product_id=_long, quantity=_long,
    ),
}

# What a missing column is filled with; columns not listed become null.
DEFAULTS: dict[str, dict[str, object]] = {
    "products": {"howtouse": "Apply this product", "price": 0.0, "total_stock": 1, "status": True},
    "categories": {"status": True},
    "order_lines": {"quantity": 1, "status": "initiated"},
    "deliveries": {"delivery_fee": 0.0, "status": "initiated"},
    "users": {"verified": False, "status": "deactivated"},
    "customers": {"is_default_address": False},
    "carts": {"quantity": 1},
    "blogs": {"status": True, "likes": 0, "unlikes": 0},
}

# A table without these columns cannot be used at all.
REQUIRED: dict[str, list[str]] = {
    "products": ["id", "category_id", "name"],
    "categories": ["id", "name"],
    "images": ["id", "product_id", "image_url"],
    "order_lines": ["id", "reference", "product_id", "user_id", "amount"],
    "deliveries": ["order_id"],
    "users": ["id", "name", "email"],
    "customers": ["id", "user_id"],
    "carts": ["id", "user_id", "product_id"],
    "blogs": ["id", "title"],
    "cart_log": ["event_id", "ts", "user_id", "event_type"],
}
