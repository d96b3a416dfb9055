import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from small_shop import ROWS, T0, empty_shop, frame, small_shop

from merchlake.operators import deep_page, page_after, page_per
from merchlake.plans import blogs, carts, catalog, charts, customers, dashboard, insights, orders, sales


@pytest.fixture(scope="module")
def small(spark):
    return small_shop(spark)


def test_best_selling_skips_unsold_inactive_and_uncategorised(small):
    rows = catalog.best_selling(small).collect()
    assert [(r.product_id, r.total_sold, r.order_count, r.images) for r in rows] == [
        (1, 5, 2, ["a.png", "b.png", "c.png"]), (2, 1, 1, [])]


def test_images_do_not_multiply_units(spark, small):
    more = frame(spark, "images", ROWS["images"] + [(f"x{n}", 1, f"x{n}.png") for n in range(20)])
    sold = {r.product_id: r.total_sold for r in catalog.best_selling(small.replace(images=more)).collect()}
    assert sold == {1: 5, 2: 1}


def test_new_products_break_ties_by_id(small):
    assert [r.product_id for r in catalog.new_products(small, 2).collect()] == [1, 2]
    assert {r.product_id: r.total_sold for r in catalog.new_products(small).collect()} == {1: 5, 2: 1, 3: 0}


def test_stock_labels(small):
    rows = catalog.almost_sold_out(small).collect()
    assert [(r.product_id, r.stock_status) for r in rows] == [
        (3, "Low Stock"), (2, "Low Stock"), (1, "Medium Stock")]


def test_pages_cover_the_list_once(shop):
    whole = [r.product_id for r in catalog.category_products(shop).collect()]
    paged = [r.product_id for n in range(1, 22) for r in catalog.product_catalog(shop, n, 10).collect()]
    assert sorted(paged) == sorted(whole) and len(set(paged)) == len(paged)


def test_key_pages_equal_offset_pages(shop):
    lines = shop.order_lines.select("id", "created_at")
    last, seen = None, []
    for _ in range(3):
        rows = page_after(lines, "created_at", "id", last, 7).collect()
        seen += [r.id for r in rows]
        last = (rows[-1].created_at, rows[-1].id)
    top = lines.orderBy(F.desc("created_at"), "id").limit(21).collect()
    assert seen == [r.id for r in top]


@pytest.fixture(scope="module")
def crowded(spark):
    """Most lines on one day, many at one time, some without a time, one owner with nearly all of them."""
    lines = spark.range(1500).select(
        F.format_string("k%05d", F.col("id")).alias("key"), F.when(F.col("id") % 9 == 0, 2).when(F.col("id") == 1, None).otherwise(1).alias("owner"),
        F.when(F.col("id") % 50 == 0, None).when(F.col("id") % 3 == 0, F.lit("2024-02-01 10:00:00"))
        .when(F.col("id") % 3 == 1, F.format_string("2024-02-01 %02d:00:00", F.col("id") % 24))
        .otherwise(F.format_string("2024-01-%02d 23:59:59", F.col("id") % 20 + 1)).cast("timestamp").alias("at"),
    )
    return lines.persist()


@pytest.mark.parametrize("page_no, size", [(1, 10), (37, 20), (2, 700), (75, 20), (76, 20), (10**9, 50), (1, 5000)])
def test_deep_pages_equal_sorted_list(crowded, page_no, size):
    order = [F.col("at").desc_nulls_last(), F.col("key")]
    whole = [r.key for r in crowded.orderBy(*order).collect()]
    found = {r.key for r in deep_page(crowded, "at", "key", page_no, size).collect()}
    assert found == set(whole[(page_no - 1) * size:page_no * size])


@pytest.mark.parametrize("page_no, size", [(1, 3), (2, 100), (9, 100), (40, 4), (1, 2000)])
def test_deep_pages_of_every_owner(crowded, page_no, size):
    order = [F.col("at").desc_nulls_last(), F.col("key")]
    ours = sorted(deep_page(crowded, "at", "key", page_no, size, "owner").collect(), key=repr)
    assert ours == sorted(page_per(crowded, "owner", order, page_no, size).collect(), key=repr)


def test_deep_pages_of_nothing(spark, crowded):
    none = crowded.filter("key is null")
    assert deep_page(none, "at", "key", 3, 10).count() == 0 and deep_page(none, "at", "key", 3, 10, "owner").count() == 0
    with pytest.raises(ValueError):
        deep_page(crowded, "at", "key", 0, 10)


def test_reports_take_either_way_to_a_page(shop):
    for report in (lambda **way: orders.orders_page(shop, 60, 7, **way), lambda **way: orders.my_orders(shop, None, 3, 4, **way)):
        shallow, deep = (sorted(report(direct=depth).collect(), key=repr) for depth in (10**6, 0))
        assert shallow == deep and shallow


def test_dashboard_keeps_unsold_rows_last(small):
    tops = dashboard.top_products(small).collect()
    assert [(r.id, r.total_sold) for r in tops] == [(1, 5), (2, 1), (5, 1), (3, 0), (4, 0)]
    by_category = {r.name: (r.order_count, r.items_sold, r.revenue) for r in dashboard.category_sales(small).collect()}
    assert by_category == {"Care": (3, 6, 8.0), "Hair": (1, 1, 9.99), "Empty": (0, 0, 0.0)}


def test_null_amount_counts_as_line_but_not_in_mean(small):
    row = dashboard.dashboard(small).first()
    assert (row.total_orders, row.total_revenue, row.unique_customers) == (5, 24.99, 3)
    assert row.average_order_value == pytest.approx(24.99 / 4)


def test_totals_agree_across_buckets(shop):
    months = sales.monthly_sales(shop).agg(F.sum("order_count"), F.sum("items_sold"), F.round(F.sum("revenue"), 2)).first()
    years = sales.yearly_sales(shop).agg(F.sum("order_count"), F.sum("items_sold"), F.round(F.sum("revenue"), 2)).first()
    figures = dashboard.dashboard(shop).first()
    assert tuple(months) == tuple(years)
    assert months[0] == figures.total_orders and months[1] == figures.total_items_sold
    assert months[2] == pytest.approx(figures.total_revenue)
    by_category = dashboard.category_sales(shop).agg(F.sum("items_sold"), F.sum("revenue")).first()
    assert by_category[0] == figures.total_items_sold and by_category[1] == pytest.approx(figures.total_revenue)


def test_days_roll_up_to_months(shop):
    rolled = sales.daily_product_sales(shop).groupBy(F.trunc("day", "month").alias("month"), "product_id").agg(
        F.sum("quantity_sold").alias("quantity_sold"), F.sum("order_count").alias("order_count"))
    direct = sales.monthly_product_sales(shop).select("month", "product_id", "quantity_sold", "order_count")
    assert rolled.exceptAll(direct).count() == 0 and direct.exceptAll(rolled).count() == 0


def test_date_range_needs_both_ends(small):
    assert sales.monthly_sales(small, start=T0).count() == sales.monthly_sales(small).count() == 3
    day = dt.datetime(2023, 12, 31)
    inside = sales.monthly_sales(small, day, day + dt.timedelta(days=1)).collect()
    assert [(r.month, r.order_count) for r in inside] == [(dt.date(2023, 12, 1), 1)]


def test_months_before_a_month_end_are_clamped(spark):
    rows = [("o1", 1, 1, 1, 1, None, "success", dt.datetime(2024, 2, 28, 23)),
            ("o2", 2, 1, 1, 1, None, "success", dt.datetime(2024, 2, 29, 0))]
    recent = charts.chart_monthly(small_shop(spark, order_lines=rows), dt.date(2024, 8, 31)).collect()
    assert [(r.month, r.order_count) for r in recent] == [("Feb", 1)]


def test_chart_fills_weeks_without_sales(spark):
    def line(n, product, day):
        return (f"o{n}", n, product, 1, n, None, "success", dt.datetime(2024, 1, day))

    shop = small_shop(spark, order_lines=[line(1, 1, 2), line(2, 3, 9), line(3, 3, 16)])
    rows = charts.chart_product_performance(shop, dt.date(2024, 1, 20)).collect()
    assert [(r.product_name, r.week_number, r.quantity_sold) for r in rows] == [
        ("comb", "01", 0), ("comb", "02", 2), ("comb", "03", 3),
        ("soap", "01", 1), ("soap", "02", 0), ("soap", "03", 0)]


def test_shares_add_up(shop):
    total = charts.chart_category_share(shop).agg(F.sum("percentage")).first()[0]
    assert total == pytest.approx(100, abs=0.2)


def test_insights_keep_equal_names_apart(small):
    rows = [(r.type, r.category, r.value) for r in insights.insights(small).collect()]
    assert sorted(v for t, c, v in rows if t == "sales_by_product" and c == "soap") == [3.0, 15.0]
    assert ("sales_by_category", "Care", 18.0) in rows
    assert ("order_summary", "Total Orders", 5.0) in rows and ("order_summary", "Total Revenue", 24.99) in rows
    assert ("status_distribution", "pending", 1.0) in rows


def test_my_orders_of_one_user_and_of_all(shop):
    one = {r.id for r in orders.my_orders(shop, 7, 2, 5).collect()}
    lines = shop.order_lines.filter("user_id = 7").orderBy(F.desc("created_at"), "id").collect()
    assert one == {r.id for r in lines[5:10]}
    mine = orders.my_orders(shop, None, 2, 5).join(shop.order_lines.select("id", "user_id"), "id").filter("user_id = 7")
    assert {r.id for r in mine.collect()} == one


def test_orders_page_with_two_deliveries_of_one_checkout(spark):
    rows = ROWS["deliveries"] + [(10, "Road 9", "Far", "S", "N", "sentout")]
    shop = small_shop(spark, deliveries=rows)
    first = orders.orders_page(shop, 1, 3).collect()
    second = orders.orders_page(shop, 2, 3).collect()
    assert [r.id for r in first + second] == ["o1", "o1", "o2", "o2", "o6", "o3"]


def test_order_details_keep_lines_of_unknown_products(small):
    row = {r.id: r for r in orders.order_details(small).collect()}
    assert row["o6"].description is None and row["o6"].images == [] and len(row) == 6
    assert {r.id for r in orders.orders_by_reference(small, [10, 14]).collect()} == {"o1", "o2"}


def test_envelope(small):
    rows = {r.entity: r for r in orders.page_envelopes(small, 2, 2).collect()}
    assert (rows["orders"].total_pages, rows["orders"].has_next_page, rows["orders"].has_prev_page) == (3, True, True)
    assert rows["my_orders:2"].total_items == 2 and rows["blogs"].has_next_page is None


def test_customers_page_counts_lines_per_user(small):
    assert [(r.customer_id, r.order_count) for r in customers.customers_page(small).collect()] == [
        ("a2", 3), ("a1", 3), ("a3", 2)]
    assert [r.id for r in customers.addresses(small, 1).collect()] == ["a1", "a2"]


def test_cart_total(small):
    assert [(r.cart_id, r.cart_total) for r in carts.cart_view(small).collect()] == [("k1", 32.0), ("k2", 32.0), ("k3", 2.5)]


def test_checkout_reasons_and_chosen_address(spark, small):
    reasons = {r.user_id: r.reason for r in carts.checkout_quote(small).collect()}
    assert reasons == {
        1: "Not enough stock for soap",
        2: "No default address found. Please add an address first.",
        3: "No default address found. Please add an address first.",
    }
    asked = spark.createDataFrame([(1, "a3"), (2, "a3")], "user_id bigint, address_id string")
    assert {r.user_id: r.reason for r in carts.checkout_quote(small, asked).collect()} == {
        1: "Address not found", 2: "Cart is empty"}
    stocked = small.replace(products=small.products.withColumn("total_stock", F.lit(50)))
    row = carts.checkout_quote(stocked, spark.createDataFrame([(1, "a2")], "user_id bigint, address_id string")).first()
    assert (row.amount_minor, row.address, len(row.lines)) == (3200, "Road 2", 2)


def test_json_orders_drop_unknown_products(spark, small):
    text = '[{"productId":"1","quantity":2},{"productId":"77","quantity":1},{"productId":"x","quantity":1}]'
    posted = spark.createDataFrame([("j1", text), ("j2", "[]"), ("j3", "not json")], "order_key string, lines string")
    rows = carts.json_order_quote(small, posted).collect()
    assert [(r.order_key, r.product_id, r.product_total, r.total_price) for r in rows] == [("j1", 1, 5.0, 5.0)]


def test_mean_of_monthly_means_is_exact(spark, small):
    rows = [(f"o{n}", n, 1, 1, 1, Decimal(amount), "success", T0 - dt.timedelta(days=31 * month))
            for n, (month, amount) in enumerate([(0, "1.00"), (0, "1.00"), (0, "0.00"), (1, "0.10"), (2, "0.20")])]
    summary = sales.monthly_summary(small.replace(order_lines=frame(spark, "order_lines", rows))).first()
    assert summary.overall_average_order_value == float((Decimal("0.666666666667") + Decimal("0.3")) / 3 // Decimal("1e-12") * Decimal("1e-12"))


def test_documents(shop):
    board = json.loads(dashboard.dashboard_document(shop).first().document)
    assert board["productMetrics"]["total_products"] == 200 and len(board["topProducts"]) == 5
    sold = [row["total_sold"] for row in board["topProducts"]]
    assert sold == sorted(sold, reverse=True) and len(board["categorySales"]) == 25
    chart = json.loads(charts.charts_document(shop, dt.datetime(2001, 8, 1)).first().document)
    assert chart["monthlySales"]["labels"][-1] == "Aug"
    series = chart["productPerformance"]
    assert len(series["datasets"]) == 3
    assert all(len(s["data"]) == len(series["labels"]) for s in series["datasets"])


def test_empty_tables(spark):
    shop = empty_shop(spark)
    for report in (
        catalog.product_catalog, catalog.best_selling, catalog.new_products, catalog.almost_sold_out,
        sales.monthly_sales, sales.yearly_category_sales, dashboard.top_products, dashboard.category_sales,
        charts.chart_product_performance, charts.chart_category_share, orders.orders_page, orders.my_orders,
        customers.customers_page, carts.cart_view, carts.checkout_quote, blogs.blogs_page,
    ):
        assert report(shop).count() == 0, report
    assert {(r.category, r.value) for r in insights.insights(shop).collect()} == {
        ("Total Orders", 0.0), ("Total Revenue", None)}
    assert dashboard.dashboard(shop).first().total_products == 0
    assert sales.monthly_summary(shop).first().total_months == 0
