"""Change flows against one-by-one replays of the same requests."""

import datetime as dt
import random

import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from small_shop import T0, small_shop

from merchlake.plans.changes import accounts, addresses, blogs, carts, catalog, payments
from merchlake.plans.changes.outcome import row_changes
from merchlake.sources import testdata

NOW = dt.datetime(2024, 6, 1)


def reasons(outcome):
    return {r.request_id: r.reason for r in outcome.rejects.collect()}


def test_signup_takes_the_first_of_a_batch(spark):
    rows = [(1, "Dan", "dan@x.com", "p", "1", "R"), (2, "Eve", "dan@x.com", "p", "2", "R"),
            (3, "Ann", "ann@x.com", "p", "3", "R"), (4, "", "f@x.com", "p", "4", "R"), (5, "Gil", "g@x.com", None, "5", "R")]
    asked = spark.createDataFrame(rows, "request_id bigint, name string, email string, password string, phonenumber string, address string")
    done = accounts.signup(small_shop(spark), asked, NOW)
    assert reasons(done) == {2: "User already exists", 3: "User already exists",
                             4: "Please enter all fields", 5: "Please enter all fields"}
    new = done.changed.collect()
    assert [(u.name, u.role_id, u.role_name, u.status) for u in new] == [("Dan", 2, "USER", "deactivated")]
    place = done.state["customers"].filter(F.col("user_id") == new[0].id).collect()
    assert len(place) == 1 and place[0].city is None and place[0].is_default_address is False
    assert "password" not in done.state["users"].columns


def test_categories_by_batch(spark):
    shop = small_shop(spark)
    made = catalog.create_categories(shop, spark.createDataFrame(
        [(1, "Nails"), (2, "Nails"), (3, "care"), (4, "Care"), (5, "")], "request_id bigint, name string"), NOW)
    assert reasons(made) == {2: "category name already exists", 4: "category name already exists", 5: "category name is empty"}
    assert {r.name for r in made.changed.collect()} == {"Nails", "care"}
    asked = spark.createDataFrame([
        (1, "c1", "Skin", None), (2, "c2", "Skin", True), (3, "c1", "Skin", False), (4, "c3", "Care", None),
        (5, "c9", "New", None), (6, "c3", "Hair", True), (7, "c2", None, True),
    ], "request_id bigint, category_id string, name string, status boolean")
    done = catalog.update_categories(shop, asked, NOW)
    assert reasons(done) == {2: "Category name already exists", 4: "Category name already exists",
                             5: "Category not found", 7: "Category name is required"}
    state = {r.id: (r.name, r.status, r.updated_at == NOW) for r in done.state["categories"].collect()}
    assert state == {"c1": ("Skin", False, True), "c2": ("Empty", True, False), "c3": ("Hair", True, True)}
    assert {r.id for r in done.changed.collect()} == {"c1", "c3"}


def test_category_delete_cascades_but_keeps_orders(spark):
    shop = small_shop(spark)
    done = catalog.delete_categories(shop, spark.createDataFrame(
        [(1, "c1"), (2, "c9"), (3, "c1"), (4, "c9"), (5, None)], "request_id bigint, category_id string"))
    assert {r.id for r in done.state["categories"].collect()} == {"c2", "c3"}
    assert {r.id for r in done.state["products"].collect()} == {3, 4, 5}
    assert done.state["images"].count() == 0 and "order_lines" not in done.state
    # Every request gets its answer: the second one for a category finds it gone.
    assert reasons(done) == {at: "Category not found" for at in (2, 3, 4, 5)}


def test_product_forms(spark):
    shop = small_shop(spark)
    kinds = "request_id bigint, product_name string, price string, description string, category_id string, total_stock string, howtouse string, benefits string, ingredients string, images array<string>"
    rows = [(1, "gel", "4.5", "d", "c1", "7.9", "", None, None, ["u", "v"]), (2, "gel", "x", "d", "c1", "y", "rub", "b", None, ["u"]),
            (3, None, "1", "d", "c1", "1", None, None, None, ["u"]), (4, "gel", "1", "d", "c1", "1", None, None, None, [])]
    done = catalog.create_products(shop, spark.createDataFrame(rows, kinds), NOW)
    made = {r.howtouse: (r.price, r.total_stock, r.status, r.benefits) for r in done.changed.collect()}
    assert made == {"Apply this product": (4.5, 7, True, None), "rub": (0.0, 1, True, "b")}
    assert done.state["images"].count() == shop.images.count() + 3
    assert set(reasons(done)) == {3, 4}


def test_product_updates_take_the_last_given_value(spark):
    shop = small_shop(spark)
    kinds = "request_id bigint, product_id bigint, name string, price double, total_stock int, status boolean, image_url string"
    rows = [(1, 1, "A", None, 0, None, None), (2, 1, "", 7.0, None, False, "n.png"), (3, 1, "B", 0.0, None, None, None), (4, 77, "Z", None, None, None, "z.png")]
    done = catalog.update_products(shop, spark.createDataFrame(rows, kinds), NOW)
    row = done.state["products"].filter("id = 1").first()
    assert (row.name, row.price, row.total_stock, row.status, row.updated_at) == ("B", 7.0, 9, False, NOW)
    assert reasons(done) == {4: "Product not found"}
    assert done.state["images"].count() == shop.images.count() + 1


def test_product_replacement_needs_all_fields_and_only_activates(spark):
    kinds = "request_id bigint, product_id bigint, name string, price double, description string, category_id string, total_stock int, status boolean"
    rows = [(1, 5, "N", 1.0, "d", "c1", 2, True), (2, 1, "N", 0.0, "d", "c1", 2, None), (3, 2, "M", 1.0, "d", "c1", 2, False)]
    done = catalog.replace_products(small_shop(spark), spark.createDataFrame(rows, kinds), NOW)
    state = {r.id: (r.name, r.status) for r in done.state["products"].collect()}
    assert state[5] == ("N", True) and state[1] == ("soap", True) and state[2] == ("M", True)
    assert reasons(done) == {2: "Please enter all fields"}


def test_product_delete_keeps_images_and_orders(spark):
    done = catalog.delete_products(small_shop(spark), spark.createDataFrame(
        [(1, 1), (2, 8), (3, 8), (4, 1)], "request_id bigint, product_id bigint"))
    assert {r.id for r in done.state["products"].collect()} == {2, 3, 4, 5} and set(done.state) == {"products"}
    assert reasons(done) == {at: "Product not found" for at in (2, 3, 4)}


def test_cart_adds_replace_quantities(spark):
    kinds = "request_id bigint, requested_at timestamp, user_id bigint, product_id bigint, quantity bigint"
    rows = [(1, NOW, 1, 1, 5), (2, NOW, 1, 1, 3), (3, NOW, 2, 1, 9), (4, NOW, 2, 1, 10), (5, NOW, 2, 50, 1), (6, NOW, 2, None, 1), (7, NOW, 2, 2, 0)]
    done = carts.apply_adds(small_shop(spark), spark.createDataFrame(rows, kinds))
    state = {(r.user_id, r.product_id): (r.quantity, r.created_at) for r in done.state["carts"].collect()}
    assert state == {(1, 1): (3, T0), (1, 2): (9, T0), (3, 1): (1, T0), (2, 1): (9, NOW)}
    assert reasons(done) == {4: "Not enough stock available", 5: "Product not found",
                             6: "Product ID and quantity are required", 7: "Product ID and quantity are required"}


def test_cart_quantities_and_removals(spark):
    shop = small_shop(spark)
    kinds = "request_id bigint, requested_at timestamp, user_id bigint, cart_id string, quantity bigint"
    rows = [(1, NOW, 1, "k1", 4), (2, NOW, 1, "k1", 6), (3, NOW, 2, "k1", 1), (4, NOW, 1, "k1", 0), (5, NOW, 1, "k1", 99)]
    done = carts.set_quantities(shop, spark.createDataFrame(rows, kinds))
    assert {r.id: r.quantity for r in done.state["carts"].collect()} == {"k1": 6, "k2": 9, "k3": 1}
    assert reasons(done) == {3: "Cart item not found", 4: "Valid quantity is required", 5: "Not enough stock available"}
    gone = carts.remove_rows(shop, spark.createDataFrame(
        [(1, 1, "k1"), (2, 1, "k1"), (3, 2, "k2")], "request_id bigint, user_id bigint, cart_id string"))
    assert {r.id for r in gone.state["carts"].collect()} == {"k2", "k3"} and set(reasons(gone)) == {2, 3}


def test_cart_log_pieces_merge_in_any_order(spark):
    rng = random.Random(5)
    rows = [(n, T0 + dt.timedelta(minutes=rng.randrange(200)), rng.randrange(4),
             rng.choice(["click", "click", "error", "purchase", "view"]), rng.randrange(5), rng.randrange(1, 9)) for n in range(300)]
    kinds = "event_id bigint, ts timestamp, user_id bigint, event_type string, product_id bigint, quantity bigint"
    state = {}
    for _, _, user, kind, product, quantity in sorted(rows, key=lambda r: (r[1], r[0])):
        if kind == "click":
            state[user, product] = quantity
        elif kind == "error":
            state.pop((user, product), None)
        elif kind == "purchase":
            state = {key: value for key, value in state.items() if key[0] != user}
    log = spark.createDataFrame(rows, kinds)

    def as_dict(df):
        return {(r.user_id, r.product_id): r.quantity for r in df.collect()}

    assert as_dict(carts.cart_state(log)) == state
    one, two = log.filter("event_id % 2 = 0"), log.filter("event_id % 2 = 1")
    merged = carts.carts_from(
        carts.merge_settings(carts.last_settings(two), carts.last_settings(one)),
        carts.merge_payments(carts.last_payments(two), carts.last_payments(one)))
    assert as_dict(merged) == state


def test_orders_from_carts(spark):
    paid = spark.createDataFrame([(90, 1, "success"), (91, 3, "failed")], "reference bigint, user_id bigint, status string")
    done = carts.orders_from_carts(small_shop(spark), paid, NOW)
    made = {(r.product_id, float(r.amount), r.customer_name, r.status) for r in done.state["order_lines"].collect()}
    assert made == {(1, 5.0, "Ann", "success"), (2, 27.0, "Ann", "success")}
    assert {r.id for r in done.state["carts"].collect()} == {"k3"}
    assert reasons(done) == {91: "Payment verification failed"}


# --- addresses: random logs replayed one by one ----------------------------------------------------


def address_book(rng):
    rows = []
    for user in range(12):
        count = rng.randrange(4)
        default = rng.randrange(count + 1) if count else None
        for n in range(count):
            rows.append((f"u{user}n{n}", user, f"Road {n}", "C", "S", "N", n == default, T0 + dt.timedelta(days=rng.randrange(5))))
    return rows


def replay_add(rows, requests):
    rows, failed = [list(r) for r in rows], {}
    for rid, user, address, country, flag in requests:
        if not country:
            failed[rid] = "All address fields are required"
            continue
        default = bool(flag) or not any(r[1] == user for r in rows)
        if default:
            for r in rows:
                if r[1] == user:
                    r[6] = False
        rows.append([f"new{rid}", user, address, "C", "S", country, default, T0])
    return rows, failed


def replay_update(rows, requests):
    rows, failed = [list(r) for r in rows], {}
    for rid, user, place, address, country, flag in requests:
        own = [r for r in rows if r[0] == place and r[1] == user]
        if not country:
            failed[rid] = "All address fields are required"
        elif not own:
            failed[rid] = "Address not found"
        else:
            if flag:
                for r in rows:
                    if r[1] == user:
                        r[6] = False
            own[0][2], own[0][5], own[0][6] = address, country, bool(flag)
    return rows, failed


def replay_delete(rows, requests):
    rows, failed = [list(r) for r in rows], {}
    for rid, user, place in requests:
        own = [r for r in rows if r[0] == place and r[1] == user]
        if not own:
            failed[rid] = "Address not found"
        elif sum(r[1] == user for r in rows) <= 1:
            failed[rid] = "Cannot delete the only address. Please add another address first."
        else:
            if own[0][6]:
                others = [r for r in rows if r[1] == user and r[0] != place]
                newest = sorted(others, key=lambda r: (-r[7].timestamp(), r[0]))[0]
                newest[6] = True
            rows.remove(own[0])
    return rows, failed


def picture(rows):
    return sorted((r[1], r[2], r[5], r[6]) for r in rows)


def state_of(outcome):
    return sorted((r.user_id, r.address, r.country, r.is_default_address) for r in outcome.state["customers"].collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_address_flows_equal_replay(spark, seed):
    rng = random.Random(seed)
    rows = address_book(rng)
    shop = small_shop(spark, customers=rows)
    adds = [(n, rng.randrange(14), f"New {n}", rng.choice(["N", "N", "N", ""]), rng.choice([True, False, None])) for n in range(40)]
    df = spark.createDataFrame(adds, "request_id bigint, user_id bigint, address string, country string, is_default boolean").select(
        "*", F.lit("C").alias("city"), F.lit("S").alias("state"), F.lit(T0).alias("requested_at"))
    done = addresses.add_addresses(shop, df)
    want, failed = replay_add(rows, adds)
    assert state_of(done) == picture(want) and reasons(done) == failed

    ids = [r[0] for r in rows] + ["none"]
    changes = []
    for n in range(60):
        place = rng.choice(ids)
        own = place != "none" and rng.random() < 0.9
        user = int(place[1:].split("n")[0]) if own else 5
        changes.append((n, user, place, f"Moved {n}", rng.choice(["M", "M", None]), rng.choice([True, False, None])))
    df = spark.createDataFrame(changes, "request_id bigint, user_id bigint, address_id string, address string, country string, is_default boolean").select(
        "*", F.lit("C").alias("city"), F.lit("S").alias("state"))
    done = addresses.update_addresses(shop, df)
    want, failed = replay_update(rows, changes)
    assert state_of(done) == picture(want) and reasons(done) == failed

    removals = [(c[0], c[1], c[2]) for c in changes]
    done = addresses.delete_addresses(shop, spark.createDataFrame(removals, "request_id bigint, user_id bigint, address_id string"))
    want, failed = replay_delete(rows, removals)
    assert state_of(done) == picture(want) and reasons(done) == failed


def test_stock_may_go_below_zero_and_is_flagged(spark):
    shop = small_shop(spark)
    lines = spark.createDataFrame([(1, 5), (1, 4), (2, 9), (3, 1)], "product_id bigint, quantity bigint")
    rows = {r.id: (r.total_stock, r.oversold) for r in payments.decrement_stock(shop.products, lines).collect()}
    assert rows == {1: (0, False), 2: (-5, True), 3: (-1, True), 4: (3, False), 5: (1, False)}


def test_blog_flows(spark):
    shop = small_shop(spark)
    kinds = "request_id bigint, title string, cover_image string, text_content string"
    made = blogs.create_blogs(shop, spark.createDataFrame([(1, "\tGood one\n", "c", "t"), (2, " a ", "", None)], kinds), NOW)
    assert [(r.title, r.status, r.likes) for r in made.changed.collect()] == [("Good one", True, 0)]
    assert reasons(made) == {2: "title  must be at least 3 characters long; coverImage is empty; textContent is required"}
    odd = blogs.toggle_blogs(shop, spark.createDataFrame(
        [(1, 1), (2, 1), (3, 1), (4, 9), (5, 9)], "request_id bigint, blog_id bigint"))
    assert odd.state["blogs"].first().status is False and reasons(odd) == {4: "blog not found", 5: "blog not found"}


def test_odd_numbers_in_product_forms(spark):
    kinds = "request_id bigint, product_name string, price string, description string, category_id string, total_stock string, howtouse string, benefits string, ingredients string, images array<string>"
    odd = [("NaN", "99999999999"), ("Infinity", "-99999999999"), ("-Infinity", "NaN"), ("1e400", "Infinity"), ("2.5", "2147483647")]
    rows = [(at, "gel", price, "d", "c1", stock, None, None, None, ["u"]) for at, (price, stock) in enumerate(odd)]
    done = catalog.create_products(small_shop(spark), spark.createDataFrame(rows, kinds), NOW)
    made = sorted((r.price, r.total_stock) for r in done.changed.collect())
    assert made == [(0.0, 1)] * 4 + [(2.5, 2147483647)] and reasons(done) == {}


def test_flows_return_the_rows_they_wrote(spark):
    shop = small_shop(spark)
    ids = lambda df: sorted(row.id for row in df.collect())
    update = spark.createDataFrame([(1, 1, "new"), (2, 99, "none")], "request_id bigint, product_id bigint, name string")
    changed = catalog.update_products(shop, update, NOW).changed
    assert [(r.id, r.name, r.updated_at) for r in changed.collect()] == [(1, "new", NOW)]
    gone = spark.createDataFrame([(1, 1), (2, 99)], "request_id bigint, product_id bigint")
    assert ids(catalog.delete_products(shop, gone).changed) == [1]
    toggles = spark.createDataFrame([(1, 1)], "request_id bigint, blog_id bigint")
    assert ids(blogs.toggle_blogs(shop, toggles).changed) == [1]
    payers = spark.createDataFrame([(row.user_id,) for row in shop.carts.collect()], "user_id bigint")
    assert ids(carts.clear_carts(shop, payers).changed) == ids(shop.carts)


def test_row_changes_by_hand(spark):
    kinds = "id string, a int, b string"
    old = spark.createDataFrame([("1", 1, "x"), ("2", None, "y"), ("3", 3, None), (None, 4, "z"), ("5", 5, "e")], kinds)
    new = spark.createDataFrame([("1", 1, "x", 9), ("2", 2, "y", None), ("3", 3, None, None), (None, 4, "zz", None), ("6", 6, "f", None)], f"{kinds}, c int")
    found = {r.key: (r.operation, r.before and tuple(r.before), r.after and tuple(r.after)) for r in row_changes(old, new).collect()}
    assert found == {
        "1": ("update", ("1", 1, "x", None), ("1", 1, "x", 9)),
        "2": ("update", ("2", None, "y", None), ("2", 2, "y", None)),
        None: ("update", (None, 4, "z", None), (None, 4, "zz", None)),
        "5": ("delete", ("5", 5, "e", None), None), "6": ("insert", None, ("6", 6, "f", None)),
    }
    assert row_changes(old, old).count() == 0 and row_changes(old.limit(0), old.limit(0)).count() == 0
    assert {r.operation for r in row_changes(old.limit(0), old).collect()} == {"insert"}


@pytest.mark.parametrize("flow, requests, table", [
    (accounts.signup, testdata.signup_requests, "users"),
    (catalog.create_categories, testdata.category_requests, "categories"),
    (catalog.update_categories, testdata.category_updates, "categories"),
    (catalog.create_products, testdata.product_requests, "products"),
    (catalog.update_products, testdata.product_updates, "products"),
    (catalog.replace_products, testdata.product_replacements, "products"),
    (carts.set_quantities, testdata.cart_quantities, "carts"),
    (carts.apply_adds, testdata.cart_adds, "carts"),
    (addresses.update_addresses, testdata.address_updates, "customers"),
    (addresses.add_addresses, testdata.address_adds, "customers"),
    (addresses.delete_addresses, testdata.address_deletes, "customers"),
    (blogs.create_blogs, testdata.blog_forms, "blogs"),
    (blogs.toggle_blogs, testdata.blog_toggles, "blogs"),
])
def test_written_rows_agree_with_the_difference(spark, shop, flow, requests, table):
    """Every row that a flow says it wrote stands in the new state; a row that is new was written."""
    outcome = flow(shop, requests(spark, SMALL))
    found = outcome.changes(shop, table)
    assert outcome.changed is not None
    written = {r[0] for r in outcome.changed.select("id").collect()}
    state = {r[0] for r in outcome.state[table].select("id").collect()}
    assert written <= state
    assert {r.key for r in found.filter("operation = 'insert'").select("key").collect()} <= written
