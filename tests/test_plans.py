"""What the plans must look like to hold on large data."""

import datetime as dt
import re

import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from small_shop import small_shop
from test_payments import CAMEL, SECRET, event

from merchlake import registry, session
from merchlake.operators import deep_page
from merchlake.plans import carts, catalog, orders, sales
from merchlake.plans.changes import payments
from merchlake.registry import QUERIES
from merchlake.sources import Shop, testdata
from merchlake.streaming import jobs

STREAMS = {key for key in QUERIES if key.startswith("st_")}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(set(QUERIES) - STREAMS))
def test_no_product_of_tables_and_no_python_per_row(spark, key):
    text = plan(QUERIES[key](spark, SMALL))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "InPandas", "LocalTableScan ["):
        assert node not in text, node


def test_filters_and_columns_reach_the_files(spark, tmp_path):
    small = small_shop(spark)
    for table in ("products", "categories", "order_lines"):
        getattr(small, table).write.parquet(f"{tmp_path}/{table}")
    shop = Shop.load(spark, str(tmp_path))
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    text = plan(sales.weekly_sales(shop, "2001-08-01"))
    assert "EqualTo(status,success)" in text and "GreaterThanOrEqual(created_at," in text
    assert re.findall(r"ReadSchema: struct<([^>]*)", text) == [
        "amount:decimal(18,2),user_id:bigint,quantity:bigint,status:string,created_at:timestamp"]
    # The binding's state is a CASE over the file's column; it still folds to a filter at the scan.
    bound = plan(sales.monthly_sales(testdata.bind(spark, SMALL)))
    assert re.search(r"Filter \(?\(+o_orderstatus#\d+ = F\)", bound)


def test_lists_are_cut_before_they_are_shuffled(spark):
    shop = testdata.bind(spark, SMALL)
    assert "WindowGroupLimit" in plan(orders.my_orders(shop))
    assert "TakeOrderedAndProject" in plan(orders.orders_page(shop))
    assert "TakeOrderedAndProject" in plan(catalog.best_selling(shop))


def test_a_deep_page_reads_its_days_only(spark, tmp_path):
    small = small_shop(spark)
    small.order_lines.write.parquet(f"{tmp_path}/order_lines")
    lines = spark.read.parquet(f"{tmp_path}/order_lines").select("id", "created_at", "amount")
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    text = plan(deep_page(lines, "created_at", "id", 2, 4))
    assert re.search(r"PushedFilters: [^\n]*GreaterThanOrEqual\(created_at,2023-11-30", text), text
    assert re.search(r"LessThan\(created_at,2024-01-01", text)
    assert "TakeOrdered" not in text and "collect_list" not in text


def test_a_hot_checkout_is_split(spark):
    """Half of all lines share one order: its partition is joined in pieces, with the same result."""
    lines = spark.range(200_000).select(
        F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id") % 5000).alias("k"), (F.col("id") % 50_000).alias("p"))
    days = spark.range(5000).select(F.col("id").alias("d"), (F.col("id") % 7).alias("w"))
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        joined = lines.join(days.hint("merge"), F.col("k") == F.col("d")).groupBy("k", "p", "w").agg(F.count("*").alias("n"))
        rows = joined.collect()
        text = plan(joined)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert "skew=true" in text
    assert sum(r.n for r in rows) == 200_000 and len({(r.k, r.p) for r in rows}) == len(rows)


@pytest.mark.parametrize("report, semi_joins", [
    (lambda shop: orders.order_details(shop, order_ids=["1-2"]), 4), (lambda shop: orders.orders_by_reference(shop, references=[1]), 3),
    (lambda shop: carts.cart_view(shop, user_id=1), 1),
])
def test_keyed_reports_read_only_what_they_ask_for(spark, report, semi_joins):
    text = plan(report(testdata.bind(spark, SMALL)))
    # Each large table is cut down by the short list, which is sent to it.
    assert len(re.findall(r"BroadcastHashJoin [^\n]*LeftSemi", text)) >= semi_joins


@pytest.mark.parametrize("report", [
    lambda shop: orders.orders_by_reference(shop, references=[1]), lambda shop: carts.cart_view(shop, user_id=1),
    lambda shop: orders.order_details(shop, order_ids=["1-2"]),
    lambda shop: orders.order_details(shop, order_ids=shop.order_lines.filter("reference = 1").select("id")),
])
def test_keyed_lines_are_never_one_value(spark, report):
    """A reference or user may hold a third of all rows; only a product's images are gathered."""
    text = plan(report(testdata.bind(spark, SMALL)))
    assert "scalar-subquery" not in text and "Subquery" not in text
    assert len(re.findall(r"keys=\[[^\]]*\], functions=\[collect_list", text)) == text.count("functions=[collect_list")
    assert "keys=[], functions=[collect_list" not in text


def test_details_of_ids_in_a_table(spark):
    shop = testdata.bind(spark, SMALL)
    ids = shop.order_lines.filter("reference <= 3").select("id")
    listed = orders.order_details(shop, order_ids=[row.id for row in ids.collect()]).collect()
    assert listed and sorted(orders.order_details(shop, order_ids=ids.union(ids)).collect()) == sorted(listed)


def test_shuffles_begin_with_partitions_by_the_size_of_the_tables(spark, monkeypatch):
    """A task's share of a join or grouping is bounded, however large the tables are."""
    monkeypatch.setattr(session, "PARTITION_BYTES", 10_000)
    wanted = -(-testdata.size(spark, SMALL) // 10_000)
    assert wanted > 20
    try:
        text = plan(QUERIES["rp_orders_by_reference"](spark, SMALL))
        assert re.search(rf"hashpartitioning\(l_orderkey#\d+L, {wanted}\)", text), text
        # A small folder takes the cluster's own number again.
        monkeypatch.setattr(session, "PARTITION_BYTES", 1 << 40)
        assert re.search(r"hashpartitioning\(l_orderkey#\d+L, 8\)", plan(QUERIES["rp_orders_by_reference"](spark, SMALL)))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.initialPartitionNum")


def test_pieces_of_the_payment_feed_are_written_by_many_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        feeds = registry._event_pieces(spark, SMALL, str(tmp_path / "events"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(feeds) == 2 and all(feed.isStreaming for feed in feeds)
    for number in range(2):
        assert len(list((tmp_path / "events" / f"piece={number}").glob("part-*"))) > 2
    sent = spark.read.json(str(tmp_path / "events"))
    assert sorted(row[0] for row in sent.select("event_id").collect()) == sorted(
        row[0] for row in testdata.payment_events(spark, SMALL).select("event_id").collect())


@pytest.mark.parametrize("drop", ["_event_files", "_event_pieces"])
def test_the_feed_is_packed_in_files_of_bounded_size(spark, tmp_path, monkeypatch, drop):
    """As plain text it took twenty times the space of the tables that it is made of."""
    sent = [event(f"p{n}", n, [CAMEL] * 5, user=str(n)) for n in range(300)]
    rows = spark.createDataFrame(sent, "event_id string, signature string, body string").withColumn("sent_at", F.lit("2024-05-01").cast("timestamp"))
    monkeypatch.setattr(testdata, "payment_events", lambda *_: rows.coalesce(1))
    whole = jobs.drop_events
    monkeypatch.setattr(jobs, "drop_events", lambda *parts: whole(*parts, records=60))
    getattr(registry, drop)(spark, SMALL, str(tmp_path / "events"))
    files = list((tmp_path / "events").rglob("part-*"))
    assert len(files) >= 5 and sum(path.stat().st_size for path in files) < sum(len(one[2]) for one in sent) / 3
    read = spark.read.schema(jobs.EVENT_SCHEMA).json(str(tmp_path / "events")).select("event_id", "signature", "body", "sent_at")
    assert sorted(read.collect()) == sorted(rows.select("event_id", "signature", "body", "sent_at").collect())
    assert read.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] <= 60


def test_events_are_made_where_their_lines_lie(spark, monkeypatch):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(testdata.payment_events(spark, SMALL))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "Exchange" not in text[:text.index("collect_list(")], text


def test_events_of_repeated_keys(spark, tmp_path):
    """A reference of two users, a user with two homes, an order that comes twice: each checkout is sent to each home."""
    at = dt.datetime(1999, 1, 1)
    tables = {
        "region": [(0, "R")], "nation": [(0, "N", 0)],
        "customer": [(5, "c5", 0, 1.0, "s"), (5, "c5 again", 0, 1.0, "s"), (6, "c6", 0, 1.0, "s"), (None, "none", 0, 1.0, "s")],
        "orders": [(1, 5, "F", 1.0, at, "1"), (1, 6, "F", 1.0, at, "1"), (2, 6, "O", 1.0, at, "1"), (2, 6, "O", 1.0, at, "1"),
                   (3, None, "F", 1.0, at, "1"), (4, 8, "F", 1.0, at, "1")],
        "lineitem": [(key, part, 1, 1, 2.0, 3.5, 0.0, 0.0, "R", "O", at) for key in (1, 2, 3, 4, None) for part in (7, 9)],
    }
    for name, rows in tables.items():
        spark.createDataFrame(rows, testdata.FILES[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    body = "data struct<amount: bigint, metadata: struct<userId: string, products: struct<deliveryDetails: struct<address: string>>>>"
    sent = testdata.payment_events(spark, str(tmp_path)).select("event_id", F.from_json("body", body)["data"].alias("d"))
    assert sorted(map(tuple, sent.select("event_id", "d.metadata.userId", "d.metadata.products.deliveryDetails.address", "d.amount").collect())) == [
        ("1#1", "5", "c5 again street", 700), ("1#1", "5", "c5 street", 700), ("1#1", "6", "c6 street", 700), ("2#1", "6", "c6 street", 1400)]


def test_payment_details_join_by_checkout_before_images_are_attached(spark):
    shop = testdata.bind(spark, SMALL)
    paid = spark.range(3).select(
        F.col("id").alias("reference"), F.lit("success").alias("payment_status"), F.col("id").alias("amount_minor"),
        *[F.lit(None).cast("string").alias(name) for name in ("paid_at", "channel", "customer_email", "card_type", "bank", "last4")])
    text = orders.order_payment_details(shop, paid)._jdf.queryExecution().optimizedPlan().toString()
    top = next(line for line in text.splitlines() if "Join" in line)
    assert "_product" in top and "_paid_reference" not in top, top


@pytest.mark.parametrize("name", ["rp_my_orders", "rp_orders_by_reference", "rp_order_details", "rp_sales_by_product", "rp_json_order_quote",
                                  "rp_page_envelope", "dq_delivery_address", "dq_payment_line", "dq_signature"])
def test_queries_on_order_lines_begin_with_partitions_by_size(spark, monkeypatch, name):
    monkeypatch.setattr(session, "PARTITION_BYTES", 10_000)
    wanted = -(-testdata.size(spark, SMALL) // 10_000)
    try:
        found = re.findall(r"hashpartitioning\(l_orderkey#\d+L, (\d+)\)", plan(QUERIES[name](spark, SMALL)))
        assert found and set(found) == {str(wanted)}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.initialPartitionNum")


def test_stored_orders_are_joined_once_to_judge_payments(spark):
    """Their grouping and sorts lie in the stage that judges: a second copy doubles what its tasks hold."""
    text = QUERIES["ch_delivery_create"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[l_orderkey", text)) == 1, text


def test_payments_without_reference_do_not_meet_in_one_task(spark):
    sent = [event(f"n{n}", f"no-key-{n}", [CAMEL], user=str(n)) for n in range(200)]
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    kept = {name: spark.conf.get(name) for name in off}
    for name, value in off.items():
        spark.conf.set(name, value)
    try:
        feed = spark.createDataFrame(sent, "event_id string, signature string, body string")
        judged = payments.judge_payments(small_shop(spark), payments.signed_payments(feed, SECRET, "bigint"))
        rows = judged.select("event_id", "is_new", "reason", F.spark_partition_id().alias("part")).collect()
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)
    assert sorted(row.event_id for row in rows) == sorted(one[0] for one in sent)
    assert {(row.is_new, row.reason) for row in rows} == {(False, "Invalid payment reference")}
    assert len({row.part for row in rows}) > 1
