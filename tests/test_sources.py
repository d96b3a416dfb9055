import datetime as dt

import pytest
from pyspark.sql import functions as F
from small_shop import small_shop

from merchlake.functions import (
    bucket, from_minor, month_label, normalise_email, role_name, stable_id, timestamp_text, to_minor, week_label,
)
from merchlake.plans import catalog, quality
from merchlake.sources import Shop, changed, conform, publish, published, with_defaults, write_snapshot
from merchlake.sources.snapshots import last_batch


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_conform_fills_and_refuses(spark):
    old = spark.createDataFrame([("a", 1, "R")], "id string, user_id bigint, address string")
    row = conform(old, "customers").first()
    assert (row.address, row.city, row.is_default_address) == ("R", None, False)
    with pytest.raises(ValueError, match="user_id"):
        conform(old.drop("user_id"), "customers")


def test_conform_reads_zoneless_times(spark):
    df = spark.sql("select 1 as id, 't' as title, timestamp_ntz '2024-01-01 10:00:00' as created_at")
    assert conform(df, "blogs").schema["created_at"].dataType.simpleString() == "timestamp"
    assert conform(df, "blogs").first().created_at == dt.datetime(2024, 1, 1, 10)


def test_shop_from_files(spark, tmp_path):
    small = small_shop(spark)
    for table in ("products", "categories", "images", "order_lines"):
        getattr(small, table).write.parquet(f"{tmp_path}/{table}")
    shop = Shop.load(spark, str(tmp_path))
    assert catalog.best_selling(shop).collect() == catalog.best_selling(small).collect()


def test_defaults_on_insert(spark):
    now = dt.datetime(2024, 2, 2)
    df = spark.createDataFrame([(1, "x", None), (2, "y", 7)], "n bigint, name string, total_stock int")
    rows = {r.name: r for r in with_defaults(df, "products", stable_id(F.col("n")), now).collect()}
    assert (rows["x"].total_stock, rows["y"].total_stock, rows["x"].price, rows["x"].status) == (1, 7, 0.0, True)
    assert rows["x"].howtouse == "Apply this product" and rows["x"].created_at == rows["x"].updated_at == now
    assert len(rows["x"].id) == 36 and rows["x"].id != rows["y"].id


def test_snapshots_become_visible_together(spark, tmp_path):
    base = str(tmp_path / "shop")
    assert last_batch(spark, base) is None and published(spark, base, "t") is None
    publish(base, 1, {"t": spark.range(3), "u": spark.range(1)})
    spark.range(9).write.parquet(f"{base}/batch=2/t")  # batch 2 was not finished
    assert published(spark, base, "t").count() == 3
    publish(base, 2, {"t": spark.range(5), "u": spark.range(2)})
    publish(base, 2, {"t": spark.range(5), "u": spark.range(2)})  # a retry
    assert (published(spark, base, "t").count(), published(spark, base, "u").count()) == (5, 2)
    assert write_snapshot(spark.range(4), f"{base}/one").count() == 4


def test_changed_rows(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 1, 3))], "id bigint, updated_at timestamp")
    assert [r.id for r in changed(df, dt.datetime(2024, 1, 2)).collect()] == [2]


def test_functions(spark):
    day = F.lit("2024-12-29 13:00:00").cast("timestamp")
    assert one(spark, bucket("week", day), bucket("month", day), bucket("year", day)) == (
        dt.date(2024, 12, 23), dt.date(2024, 12, 1), dt.date(2024, 1, 1))
    assert one(spark, week_label(day), month_label(day), timestamp_text(day)) == ("52", "Dec", "2024-12-29 13:00:00")
    assert one(spark, to_minor(F.lit("12.34").cast("decimal(18,2)")), from_minor(F.lit(1234)).cast("string")) == (1234, "12.34")
    assert one(spark, role_name(F.lit(1)), role_name(F.lit(2)), role_name(F.lit(3)), normalise_email(F.lit(" A@X.com\n"))) == (
        "ADMIN", "USER", None, "a@x.com")


def test_quality_counts(spark):
    shop = small_shop(spark)
    assert {r["check"]: r.row_count for r in quality.orphans(shop).collect()} == {
        "images without product": 0, "orders without product": 1, "orders without user": 0, "products without category": 1}
    odd = shop.replace(order_lines=shop.order_lines.withColumn(
        "status", F.when(F.col("id") == "o1", "lost").when(F.col("id") != "o2", F.col("status"))))
    assert {r["check"]: r.row_count for r in quality.enum_domain(odd).collect()} == {"orders": 2, "deliveries": 0, "users": 0}
    twice = shop.users.unionByName(shop.users.filter("id = 1"))
    assert [(r.email, r.row_count) for r in quality.duplicate_emails(twice).collect()] == [("ann@x.com", 2)]


def test_columns_of_another_kind_are_refused(spark):
    rows = spark.createDataFrame([(1, "c1", "soap", "cheap", 3)], "id bigint, category_id string, name string, price string, total_stock int")
    with pytest.raises(ValueError, match="price is string, not double"):
        conform(rows, "products")
