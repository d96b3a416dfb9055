"""A hand-made shop with the cases the test files lack."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from merchlake.schemas import SCHEMAS
from merchlake.sources.shop import Shop

T0 = dt.datetime(2024, 1, 31, 12)
LAYOUT = {
    "categories": ["id", "name", "status", "created_at"],
    "products": ["id", "category_id", "name", "price", "total_stock", "status", "created_at"],
    "images": ["id", "product_id", "image_url"],
    "order_lines": ["id", "reference", "product_id", "user_id", "quantity", "amount", "status", "created_at"],
    "users": ["id", "name", "email", "role_id"],
    "customers": ["id", "user_id", "address", "city", "state", "country", "is_default_address", "created_at"],
    "deliveries": ["order_id", "address", "city", "state", "country", "status"],
    "carts": ["id", "user_id", "product_id", "quantity", "created_at", "updated_at"],
    "blogs": ["id", "title", "cover_image", "text_content", "status", "created_at"],
}
ROWS: dict[str, list[tuple]] = {
    "categories": [("c1", "Care", True, T0), ("c2", "Empty", True, T0), ("c3", "Hair", False, T0)],
    # p3 is never sold, p4 has no category, p5 is inactive; all were created at the same time.
    "products": [
        (1, "c1", "soap", 2.50, 9, True, T0), (2, "c1", "soap", 3.00, 4, True, T0),
        (3, "c3", "comb", 1.00, 0, True, T0), (4, "none", "lost", 5.00, 3, True, T0),
        (5, "c3", "old", 9.99, 1, False, T0),
    ],
    "images": [("i1", 1, "b.png"), ("i2", 1, "a.png"), ("i3", 1, "c.png"), ("i4", 2, None)],
    "order_lines": [
        ("o1", 10, 1, 1, 2, Decimal("5.00"), "success", T0),
        ("o2", 10, 2, 1, 1, Decimal("3.00"), "success", T0),
        ("o3", 11, 1, 2, 4, Decimal("10.00"), "pending", T0 - dt.timedelta(days=30)),
        ("o4", 12, 5, 2, 1, Decimal("9.99"), "success", T0 - dt.timedelta(days=31)),
        ("o5", 13, 1, 3, 3, None, "success", T0 - dt.timedelta(days=62)),
        ("o6", 14, 99, 1, 1, Decimal("7.00"), "success", T0),
    ],
    "users": [(1, "Ann", "ann@x.com", 1), (2, "Bob", "bob@x.com", 2), (3, "Cid", "cid@x.com", 2)],
    "customers": [
        ("a1", 1, "Road 1", "Here", "S", "N", True, T0),
        ("a2", 1, "Road 2", "Here", "S", "N", False, T0 + dt.timedelta(days=1)),
        ("a3", 2, "Road 3", "There", "S", "N", False, T0),
    ],
    "deliveries": [(10, "Road 1", "Here", "S", "N", "pending")],
    "carts": [("k1", 1, 1, 2, T0, T0), ("k2", 1, 2, 9, T0, T0), ("k3", 3, 1, 1, T0, T0)],
    "blogs": [(1, "First", "c.png", "text", True, T0)],
}


def frame(spark, table: str, rows: list[tuple] | None = None):
    names = LAYOUT[table]
    kinds = [f"{name} {SCHEMAS[table][name].dataType.simpleString()}" for name in names]
    return spark.createDataFrame(ROWS[table] if rows is None else rows, ", ".join(kinds))


def small_shop(spark, **rows: list[tuple]) -> Shop:
    return Shop.of(**{table: frame(spark, table, rows.get(table)) for table in LAYOUT})


def empty_shop(spark) -> Shop:
    return small_shop(spark, **{table: [] for table in LAYOUT})
