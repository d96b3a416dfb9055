"""Every report, flow, rule set and stream as a query over one folder of test files.

The library functions return typed columns. Here they are shaped for comparison by value: arrays and
timestamps become text, decimals doubles, and the outcome of a change flow becomes rows of
``(section, key, value)`` for the whole new state and the number of rejects by reason.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merchlake.functions import timestamp_text
from merchlake.operators import with_errors
from merchlake.plans import blogs, carts, catalog, charts, customers, dashboard, insights, orders, quality, sales
from merchlake.plans.changes import accounts, addresses, payments
from merchlake.plans.changes import blogs as blog_changes
from merchlake.plans.changes import carts as cart_changes
from merchlake.plans.changes import catalog as catalog_changes
from merchlake.plans.changes.outcome import Outcome
from merchlake.plans.facts import paid_lines
from merchlake.session import configure, remove_folder, shuffles_removed, work_folder
from merchlake.sources import testdata
from merchlake.sources.shop import Shop
from merchlake.sources.snapshots import write_snapshot
from merchlake.sources.tables import conform
from merchlake.streaming import jobs, rollup
from merchlake.streaming.rollup import SalesRollUp

AS_OF = dt.datetime(2001, 8, 1)
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# --- shaping -------------------------------------------------------------------------------------


def _flat(df: DataFrame) -> DataFrame:
    def shape(field: T.StructField) -> Column:
        column, kind = F.col(field.name), field.dataType
        if isinstance(kind, T.TimestampType):
            column = timestamp_text(column)
        elif isinstance(kind, T.DecimalType):
            column = column.cast("double")
        elif isinstance(kind, T.ArrayType):
            if isinstance(kind.elementType, T.StructType):
                column = F.transform(column, lambda row: F.concat_ws(
                    ":", *[_text(row[part.name], part.dataType) for part in kind.elementType.fields]))
            column = F.array_join(column, "|")
        return column.alias(field.name)

    return df.select([shape(field) for field in df.schema.fields])


def _text(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampType):
        column = timestamp_text(column)
    elif isinstance(kind, T.DoubleType):
        column = column.cast("decimal(18,2)")
    return F.coalesce(column.cast("string"), F.lit("~"))


def _state(table: str, df: DataFrame, key: str, *columns: str) -> DataFrame:
    kinds = {field.name: field.dataType for field in df.schema.fields}
    return df.select(
        F.lit(table).alias("section"),
        F.col(key).cast("string").alias("key"),
        F.concat_ws("|", *[_text(F.col(name), kinds[name]) for name in columns]).alias("value"),
    )


def _rejects(rejects: DataFrame) -> DataFrame:
    counts = rejects.groupBy("reason").agg(F.count("*").alias("n"))
    return counts.select(F.lit("rejected").alias("section"), F.col("reason").alias("key"), F.col("n").cast("string").alias("value"))


def _digest(outcome: Outcome, **tables: list[str]) -> DataFrame:
    """Per table the key column and the columns to show; the rejects by reason."""
    parts = [_state(table, outcome.state[table], *columns) for table, columns in tables.items()]
    return reduce(DataFrame.unionByName, [*parts, _rejects(outcome.rejects)])


def _query(key: str) -> Callable[[Callable[[SparkSession, str], DataFrame]], Query]:
    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(configure(spark, testdata.size(spark, sf_dir)), sf_dir)

        QUERIES[key] = run
        return build

    return register


def _report(key: str, report: Callable[..., DataFrame], **params) -> None:
    _query(key)(lambda spark, sf_dir: _flat(report(testdata.bind(spark, sf_dir), **params)))


# --- reports -------------------------------------------------------------------------------------

_report("rp_product_catalog", catalog.product_catalog)
_report("rp_category_products", catalog.category_products)
_report("rp_product_detail", catalog.product_detail)
_report("rp_product_with_images", catalog.product_with_images)
_report("rp_best_selling", catalog.best_selling)
_report("rp_new_products", catalog.new_products)
_report("rp_almost_sold_out", catalog.almost_sold_out)
_report("rp_insights", insights.insights)
_report("rp_sales_by_product", insights.sales_by_product)
_report("rp_dashboard", dashboard.dashboard)
_report("rp_dashboard_top_products", dashboard.top_products)
_report("rp_dashboard_low_stock", dashboard.low_stock)
_report("rp_dashboard_category_sales", dashboard.category_sales)
_report("rp_monthly_sales", sales.monthly_sales)
_report("rp_monthly_product_sales", sales.monthly_product_sales)
_report("rp_monthly_category_sales", sales.monthly_category_sales)
_report("rp_monthly_summary", sales.monthly_summary)
_report("rp_weekly_sales", sales.weekly_sales, as_of=AS_OF)
_report("rp_weekly_product_sales", sales.weekly_product_sales, as_of=AS_OF)
_report("rp_yearly_sales", sales.yearly_sales)
_report("rp_yearly_product_sales", sales.yearly_product_sales)
_report("rp_yearly_category_sales", sales.yearly_category_sales)
_report("rp_chart_monthly", charts.chart_monthly, as_of=AS_OF)
_report("rp_chart_product_performance", charts.chart_product_performance, as_of=AS_OF)
_report("rp_chart_category_share", charts.chart_category_share)
_report("rp_category_counts", catalog.category_counts)
_report("rp_category_page", catalog.category_page, page_no=2, size=10)
_report("rp_products_json_images", catalog.products_json_images, limit=10, offset=5)
_report("rp_orders_page", orders.orders_page, page_no=2, size=10)
_report("rp_order_details", orders.order_details)
_report("rp_my_orders", orders.my_orders, page_no=1, size=10)
_report("rp_customers_page", customers.customers_page)
_report("rp_addresses", customers.addresses)
_report("rp_cart_view", carts.cart_view)
_report("rp_checkout_quote", carts.checkout_quote)
_report("rp_orders_by_reference", orders.orders_by_reference)
_report("rp_page_envelope", orders.page_envelopes)
_report("rp_blogs_page", blogs.blogs_page)
_report("rp_blogs_all", blogs.blogs_all)



# --- documents, read back into one row per value -------------------------------------------------

_ENTRY = "map<string,string>"
_SERIES = "struct<labels:array<string>,datasets:array<struct<label:string,data:array<string>>>>"


def _values(entries: DataFrame) -> DataFrame:
    """Numbers as numbers, other values as text."""
    number = F.expr("try_cast(value as double)")
    return entries.select("section", "field", "place", F.when(number.isNull(), F.col("value")).alias("text"), number.alias("number"))


@_query("rp_dashboard_document")
def _dashboard_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    single, listed = ["productMetrics", "categoryMetrics", "salesMetrics"], ["topProducts", "lowStockProducts", "categorySales"]
    kinds = [*(f"{name} {_ENTRY}" for name in single), *(f"{name} array<{_ENTRY}>" for name in listed)]
    document = dashboard.dashboard_document(testdata.bind(spark, sf_dir))
    parts = document.select(F.from_json("document", ", ".join(kinds)).alias("d"))

    def entries(name: str) -> Column:
        rows = F.array(f"d.{name}") if name in single else F.col(f"d.{name}")
        return F.transform(rows, lambda row, place: F.struct(F.lit(name).alias("section"), place.alias("place"), row.alias("row")))

    rows = parts.select(F.inline(F.concat(*[entries(name) for name in (*single, *listed)])))
    return _values(rows.select("section", "place", F.explode("row").alias("field", "value")))


@_query("rp_charts_document")
def _charts_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = f"monthlySales {_SERIES}, productPerformance {_SERIES}, categoryDistribution struct<labels:array<string>,data:array<string>>"
    document = charts.charts_document(testdata.bind(spark, sf_dir), AS_OF)
    parts = document.select(F.from_json("document", kinds).alias("d"))

    def series(section: str, field: Column, data: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), field.alias("field"), data.alias("data"))

    listed = [series("categoryDistribution", F.lit(name), F.col(f"d.categoryDistribution.{name}")) for name in ("labels", "data")]
    for section in ("monthlySales", "productPerformance"):
        listed.append(series(section, F.lit("labels"), F.col(f"d.{section}.labels")))

    def datasets(section: str) -> Column:
        return F.transform(F.col(f"d.{section}.datasets"), lambda one: series(section, one["label"], one["data"]))

    drawn = [datasets("monthlySales"), datasets("productPerformance")]
    rows = parts.select(F.inline(F.concat(F.array(*listed), *drawn)))
    return _values(rows.select("section", "field", F.posexplode("data").alias("place", "value")))


# --- reports for given keys, which the tables themselves provide -----------------------------------


def _keyed(key: str, report: Callable[..., DataFrame], pick: Callable[[Shop], dict]) -> None:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        shop = testdata.bind(spark, sf_dir)
        return _flat(report(shop, **pick(shop)))

    _query(key)(build)


def _ends(df: DataFrame, column: str) -> list:
    """The smallest and the largest key."""
    return list(df.agg(F.min(column), F.max(column)).first())


def _last_order(shop: Shop) -> dict:
    last = _ends(shop.order_lines, "reference")[1]
    return {"order_ids": shop.order_lines.filter(F.col("reference") == last).select("id")}


_RANGE = {"start": dt.datetime(1996, 3, 10), "end": dt.datetime(1998, 8, 20)}
_keyed("rp_category_products_one", catalog.category_products, lambda shop: {"category_id": _ends(shop.products, "category_id")[1]})
_keyed("rp_products_json_images_one", catalog.products_json_images,
       lambda shop: {"category_id": _ends(shop.products, "category_id")[1], "limit": 10, "offset": 2})
_keyed("rp_product_detail_keys", catalog.product_detail, lambda shop: {"product_ids": _ends(shop.products, "id")})
_keyed("rp_product_with_images_keys", catalog.product_with_images, lambda shop: {"product_ids": _ends(shop.products, "id")})
_keyed("rp_order_details_keys", orders.order_details, _last_order)
_keyed("rp_orders_by_reference_keys", orders.orders_by_reference, lambda shop: {"references": _ends(shop.order_lines, "reference")})
_keyed("rp_my_orders_one", orders.my_orders, lambda shop: {"user_id": _ends(shop.order_lines, "user_id")[1], "page_no": 2, "size": 5})
_keyed("rp_orders_deep_page", orders.orders_page,
       lambda shop: {"page_no": shop.order_lines.count() // 20 + 1, "size": 10, "direct": 0})
_keyed("rp_my_orders_deep", orders.my_orders,
       lambda shop: {"user_id": _ends(shop.order_lines, "user_id")[1], "page_no": 3, "size": 4, "direct": 0})
_report("rp_my_orders_deep_all", orders.my_orders, page_no=4, size=6, direct=0)
_keyed("rp_addresses_one", customers.addresses, lambda shop: {"user_id": _ends(shop.customers.filter("not is_default_address"), "user_id")[1]})
_keyed("rp_cart_view_one", carts.cart_view, lambda shop: {"user_id": _ends(shop.carts, "user_id")[1]})
_report("rp_monthly_sales_range", sales.monthly_sales, **_RANGE)
_report("rp_monthly_product_sales_range", sales.monthly_product_sales, **_RANGE)
_report("rp_monthly_category_sales_range", sales.monthly_category_sales, **_RANGE)
_report("rp_monthly_summary_range", sales.monthly_summary, **_RANGE)


def _parsed_events(spark: SparkSession, sf_dir: str, shop: Shop) -> DataFrame:
    """The payment feed, checked and parsed once into a table in the shared folder."""
    events = testdata.payment_events(spark, sf_dir)
    parsed = payments.signed_payments(events, testdata.TEST_SECRET, shop.key_type("order_lines", "reference"))
    return write_snapshot(parsed, work_folder(spark, "parsed-events"))


@_query("rp_order_payment_details")
def _payment_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    shop = testdata.bind(spark, sf_dir)
    paid = payments.valid_payments(_parsed_events(spark, sf_dir, shop).select("event_id", "signature_ok", *orders.PAYMENT_FIELDS))
    return _flat(orders.order_payment_details(shop, paid))


@_query("rp_json_order_quote")
def _json_order_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carts.json_order_quote(testdata.bind(spark, sf_dir), testdata.order_json(spark, sf_dir))


# --- change flows --------------------------------------------------------------------------------


def _flow(key: str, flow: Callable[..., Outcome], requests: Callable[[SparkSession, str], DataFrame],
          tables: dict[str, list[str]], **params) -> None:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _digest(flow(testdata.bind(spark, sf_dir), requests(spark, sf_dir), **params), **tables)

    _query(key)(build)


_PRODUCT = [
    "id", "name", "price", "description", "category_id", "total_stock", "howtouse", "status", "updated_at"]
_ADDRESS = ["id", "user_id", "address", "city", "state", "country", "is_default_address"]
_CATEGORY = ["id", "name", "status", "updated_at"]

_flow("ch_signup", accounts.signup, testdata.signup_requests, {
    "users": ["id", "name", "email", "role_id", "role_name", "verified", "status"],
    "customers": ["id", "user_id", "phonenumber", "address", "city", "is_default_address"],
}, as_of=AS_OF)
_flow("ch_category_create", catalog_changes.create_categories, testdata.category_requests,
      {"categories": _CATEGORY}, as_of=AS_OF)
_flow("ch_category_update", catalog_changes.update_categories, testdata.category_updates,
      {"categories": _CATEGORY}, as_of=AS_OF)
_flow("ch_category_delete", catalog_changes.delete_categories, testdata.category_deletes, {
    "categories": ["id", "name"], "products": ["id", "category_id"], "images": ["id", "product_id"],
})
_flow("ch_product_create", catalog_changes.create_products, testdata.product_requests, {
    "products": _PRODUCT, "images": ["id", "product_id", "image_url"],
}, as_of=AS_OF)
_flow("ch_product_update", catalog_changes.update_products, testdata.product_updates, {
    "products": _PRODUCT, "images": ["id", "product_id", "image_url"],
}, as_of=AS_OF)
_flow("ch_product_replace", catalog_changes.replace_products, testdata.product_replacements,
      {"products": _PRODUCT}, as_of=AS_OF)
_flow("ch_product_delete", catalog_changes.delete_products, testdata.product_deletes, {"products": ["id", "name"]})
_flow("ch_cart_apply", cart_changes.apply_adds, testdata.cart_adds,
      {"carts": ["id", "user_id", "product_id", "quantity", "created_at", "updated_at"]})
_flow("ch_cart_set_quantity", cart_changes.set_quantities, testdata.cart_quantities,
      {"carts": ["id", "user_id", "product_id", "quantity", "created_at", "updated_at"]})
_flow("ch_cart_remove", cart_changes.remove_rows, testdata.cart_removals,
      {"carts": ["id", "user_id", "product_id", "quantity"]})
_flow("ch_address_add", addresses.add_addresses, testdata.address_adds, {"customers": _ADDRESS})
_flow("ch_address_update", addresses.update_addresses, testdata.address_updates, {"customers": _ADDRESS})
_flow("ch_address_delete", addresses.delete_addresses, testdata.address_deletes, {"customers": _ADDRESS})
_flow("ch_blog_create", blog_changes.create_blogs, testdata.blog_forms,
      {"blogs": ["id", "title", "cover_image", "text_content", "status", "likes"]}, as_of=AS_OF)
_flow("ch_blog_toggle", blog_changes.toggle_blogs, testdata.blog_toggles, {"blogs": ["id", "status"]})


def _change_rows(key: str, flow: Callable[..., Outcome], requests: Callable[[SparkSession, str], DataFrame], table: str,
                 columns: list[str], **params) -> None:
    """What a flow did to one table, row by row."""
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        shop = testdata.bind(spark, sf_dir)
        found = flow(shop, requests(spark, sf_dir), **params).changes(shop, table)
        kinds = {field.name: field.dataType for field in getattr(shop, table).schema.fields}

        def shown(side: str) -> Column:
            values = F.concat_ws("|", *[_text(F.col(f"{side}.{name}"), kinds[name]) for name in columns[1:]])
            return F.when(F.col(side).isNotNull(), values).alias(side)

        return found.select("operation", F.col("key").cast("string").alias("key"), shown("before"), shown("after"))

    _query(key)(build)


_change_rows("ch_rows_users", accounts.signup, testdata.signup_requests, "users",
             ["id", "name", "email", "role_id", "role_name", "verified", "status"], as_of=AS_OF)
_change_rows("ch_rows_categories", catalog_changes.update_categories, testdata.category_updates, "categories", _CATEGORY, as_of=AS_OF)
_change_rows("ch_rows_products", catalog_changes.update_products, testdata.product_updates, "products", _PRODUCT, as_of=AS_OF)
_change_rows("ch_rows_images", catalog_changes.delete_categories, testdata.category_deletes, "images", ["id", "product_id"])
_change_rows("ch_rows_carts", cart_changes.set_quantities, testdata.cart_quantities, "carts",
             ["id", "user_id", "product_id", "quantity", "created_at", "updated_at"])
_change_rows("ch_rows_customers", addresses.delete_addresses, testdata.address_deletes, "customers", _ADDRESS)
_change_rows("ch_rows_blogs", blog_changes.toggle_blogs, testdata.blog_toggles, "blogs", ["id", "status"])


def _replayed(spark: SparkSession, sf_dir: str) -> Shop:
    """The shop with its early orders only, to which all payments are fed again."""
    shop = testdata.bind(spark, sf_dir)
    return shop.replace(order_lines=testdata.stored_orders(shop))


_ORDER = ["reference", "product_id", "product_name", "customer_name", "amount", "user_id", "quantity", "status", "created_at"]


@_query("ch_orders_from_payment")
def _orders_from_payment(spark: SparkSession, sf_dir: str) -> DataFrame:
    shop = _replayed(spark, sf_dir)
    taken = payments.new_payments(shop, _parsed_events(spark, sf_dir, shop))
    created = payments.order_rows(shop, taken.lines)
    return _state("order_lines", created, "reference", *_ORDER[1:]).unionByName(_rejects(taken.rejects))


@_query("ch_stock_decrement")
def _stock_decrement(spark: SparkSession, sf_dir: str) -> DataFrame:
    shop = testdata.bind(spark, sf_dir)
    paid = shop.order_lines.filter(F.col("status") == "success")
    return payments.decrement_stock(shop.products, paid).select("id", "total_stock", "oversold")


@_query("ch_cart_clear")
def _cart_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    shop = testdata.bind(spark, sf_dir)
    # The payments of half a year, as nearly all users have paid at some time.
    payers = shop.order_lines.filter((F.col("status") == "success") & (F.col("created_at") >= F.lit(dt.datetime(2001, 2, 1))))
    left = cart_changes.clear_carts(shop, payers.select("user_id")).state["carts"]
    return _flat(left.select("id", "user_id", "product_id", "quantity", "created_at"))


@_query("ch_delivery_create")
def _delivery_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    shop = _replayed(spark, sf_dir)
    taken = payments.new_payments(shop, _parsed_events(spark, sf_dir, shop))
    created = payments.delivery_rows(taken.accepted)
    return _flat(created.select("order_id", "address", "city", "state", "country", "delivery_fee", "status", "created_at"))


@_query("ch_orders_from_cart")
def _orders_from_cart(spark: SparkSession, sf_dir: str) -> DataFrame:
    shop = testdata.bind(spark, sf_dir)
    # One payment per user; every fourth fails.
    user = F.col("id")
    paid = shop.users.select(
        (user + testdata.UNKNOWN).alias("reference"), user.alias("user_id"),
        F.when(user % 4 == 3, "failed").otherwise("success").alias("status"),
    )
    outcome = cart_changes.orders_from_carts(shop, paid, AS_OF)
    return _digest(outcome, order_lines=["reference", *_ORDER[1:]], carts=["id", "quantity"])


@_query("ch_conform_customers")
def _conform_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = testdata.bind(spark, sf_dir).customers.drop("city", "state", "country", "is_default_address")
    return _flat(conform(old, "customers"))


# --- data quality --------------------------------------------------------------------------------


def _verdicts(df: DataFrame, rules: list, *keys: str) -> DataFrame:
    return with_errors(df, rules).select(*keys, F.array_join("errors", "; ").alias("errors"))


_query("dq_customer")(lambda spark, sf_dir: _verdicts(
    quality.normalised(testdata.customer_forms(spark, sf_dir)), quality.customer_rules(), "form_id", "email"))
_query("dq_blog")(lambda spark, sf_dir: _verdicts(
    testdata.blog_forms(spark, sf_dir), quality.blog_rules(), "request_id"))
_query("dq_product")(lambda spark, sf_dir: _verdicts(
    testdata.product_requests(spark, sf_dir), quality.product_rules(), "request_id"))


@_query("dq_payment_line")
def _payment_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = payments.parse_payment_events(testdata.payment_events(spark, sf_dir), "bigint")
    lines = payments.payment_lines(parsed, "event_id")
    return _verdicts(lines, quality.payment_line_rules(), "event_id", "product_id")


@_query("dq_delivery_address")
def _delivery_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = payments.parse_payment_events(testdata.payment_events(spark, sf_dir), "bigint")
    return _verdicts(parsed, quality.delivery_address_rules(), "event_id")


_report("dq_orphans", quality.orphans)
_report("dq_enum_domain", quality.enum_domain)
_query("dq_signature")(lambda spark, sf_dir: quality.signature_check(
    testdata.payment_events(spark, sf_dir), testdata.TEST_SECRET))


@_query("dq_unique_email")
def _unique_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mails asked for more than once, among users and sign-ups together."""
    emails = testdata.bind(spark, sf_dir).users.select("email")
    asked = testdata.signup_requests(spark, sf_dir).select("email").filter(F.col("email").isNotNull())
    return quality.duplicate_emails(emails.unionByName(asked))


# --- streams -------------------------------------------------------------------------------------


def _event_files(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    jobs.drop_events(testdata.payment_events(spark, sf_dir), folder)
    return jobs.payment_feed(spark, folder)


def _event_pieces(spark: SparkSession, sf_dir: str, folder: str) -> list[DataFrame]:
    """The events out of order, in two pieces of any number of files, each a feed and a batch."""
    events = testdata.payment_events(spark, sf_dir)
    piece = F.pmod(F.xxhash64("event_id", F.lit("order")), F.lit(2))
    jobs.drop_events(events.withColumn("piece", piece), folder, "piece")
    return [jobs.payment_feed(spark, f"{folder}/piece={number}") for number in range(2)]


@_query("st_payment_ingest")
def _payment_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = work_folder(spark, "payment-ingest")
    shop = _replayed(spark, sf_dir)
    with shuffles_removed(spark):
        for number, feed in enumerate(_event_pieces(spark, sf_dir, f"{base}/events")):
            jobs.run_to_end(jobs.ingest_payments(feed, shop, testdata.TEST_SECRET, f"{base}/out"), f"{base}/checkpoint-{number}")
            remove_folder(spark, f"{base}/events/piece={number}")
    after = jobs.payment_state(spark, shop, f"{base}/out")
    parts = [
        _state("order_lines", after["order_lines"], "reference", *_ORDER[1:]),
        _state("deliveries", after["deliveries"], "order_id", "address", "city", "state", "country", "status"),
        _state("products", after["products"], "id", "total_stock", "oversold"), _state("carts", after["carts"], "id", "user_id", "product_id", "quantity"),
    ]
    return reduce(DataFrame.unionByName, [*parts, _rejects(after["rejects"])])


@_query("st_payment_dedup")
def _payment_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = work_folder(spark, "payment-dedup")
    shop = _replayed(spark, sf_dir)
    stored = shop.order_lines.select("reference")
    with shuffles_removed(spark):
        feed = _event_files(spark, sf_dir, f"{base}/events")
        writer = jobs.dedup_payments(feed, stored, testdata.TEST_SECRET, "bigint", f"{base}/out")
        jobs.run_to_end(writer, f"{base}/checkpoint")
        remove_folder(spark, f"{base}/events")
    return spark.read.parquet(f"{base}/out").drop("stream", "batch_id")


@_query("st_cart_state")
def _cart_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = work_folder(spark, "cart-state")
    log = testdata.cart_log_rows(testdata.stream(spark, sf_dir, "events"))
    jobs.run_to_end(jobs.cart_feed(log, f"{base}/state"), f"{base}/checkpoint")
    state = jobs.cart_store(spark, log.schema, f"{base}/state").read("carts")
    return _flat(state.select("user_id", "product_id", "quantity", "created_at"))


def _rolled(spark: SparkSession, sf_dir: str) -> tuple[Shop, SalesRollUp]:
    """The orders rolled up in two batches, of which the first is sent again."""
    shop = testdata.bind(spark, sf_dir)
    rolled = SalesRollUp(spark, work_folder(spark, "sales-rollup"), shop.key_type("order_lines", "product_id"), buckets=8)
    for batch in (0, 1, 0):
        rolled.add(f"lines-{batch}", shop.order_lines.filter(F.col("reference") % 2 == batch))
    return shop, rolled


@_query("st_rollup_product_sales")
def _rollup_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(rollup.product_sales(*_rolled(spark, sf_dir), "month"))


@_query("st_rollup_category_sales")
def _rollup_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(rollup.category_sales(*_rolled(spark, sf_dir), "year"))


@_query("st_rollup_customers")
def _rollup_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weeks of the roll-up, and whether their customers by sketch are within 2 % of the exact number."""
    shop, rolled = _rolled(spark, sf_dir)
    exact = sales.totals(paid_lines(shop), "week").select("week", "unique_customers")
    error = F.abs(F.col("approx_customers") - F.col("unique_customers")) / F.col("unique_customers")
    weeks = rolled.totals("week").join(exact, "week").withColumn("sketch_is_close", error < 0.02)
    return _flat(weeks.drop("approx_customers"))


@_query("st_daily_sales")
def _daily_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = work_folder(spark, "daily-sales")
    days = testdata.order_days(spark, sf_dir)
    lines = testdata.stream(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_extendedprice").cast("decimal(12,2)").alias("amount"))
    dated = lines.join(days, F.col("l_orderkey") == F.col("o_orderkey"))
    jobs.run_to_end(jobs.daily_sales(dated.select("created_at", "amount"), f"{base}/out"), f"{base}/checkpoint")
    return _flat(jobs.latest_days(spark, f"{base}/out"))
