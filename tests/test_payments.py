import hashlib
import hmac
import json

from pyspark.sql import functions as F
from small_shop import ROWS, frame, small_shop

from merchlake.functions import hmac_sha512
from merchlake.plans import orders
from merchlake.plans.changes import payments
from merchlake.sources import testdata

SECRET = "key"


def event(event_id, reference, lines, *, user="1", status="success", address=True, sign=True, **data):
    place = {"address": "R", "city": "C", "state": "S", "country": "N"}
    if not address:
        place.pop("city")
    body = json.dumps({"data": {
        "reference": str(reference), "status": status, "paid_at": "2024-05-01T10:00:00Z", "channel": "card", "amount": 1234,
        "customer": {"email": "p@x.com"}, "authorization": {"card_type": "visa", "bank": "B", "last4": "4242"},
        "metadata": {"userId": user, "products": {"productDescriptions": lines, "deliveryDetails": place}}, **data}})
    signature = hmac.new(SECRET.encode(), body.encode(), hashlib.sha512).hexdigest() if sign else None
    return (event_id, signature, body)


CAMEL = {"productId": "1", "productName": "soap", "quantity": 2, "productTotal": 5.0}
SNAKE = {"product_id": "2", "name": "soap", "quantity": 1, "product_total": 3.25}
EVENTS = [
    event("e1", 50, [CAMEL, SNAKE]),
    event("e2", 50, [CAMEL, SNAKE]),
    event("e3", 10, [CAMEL]),
    event("e4", 51, [CAMEL], sign=False),
    event("e5", 52, [CAMEL], status="failed", gateway_response="No funds"),
    event("e6", 53, [CAMEL], status="abandoned"),
    event("e7", 54, [CAMEL], address=False),
    event("e8", 55, [CAMEL], user="404"),
    event("e9", 56, [{**CAMEL, "quantity": 0}, {**CAMEL, "productName": ""}]),
    event("f1", 57, [{**CAMEL, "productTotal": None}, SNAKE], user="2"),
    event("f2", 58, [CAMEL], metadata={}),
    event("f3", 59, [CAMEL], metadata={"userId": "1", "products": {"deliveryDetails": {}}}),
]


def judged(spark, shop, events=EVENTS):
    feed = spark.createDataFrame(events, "event_id string, signature string, body string")
    return payments.new_payments(shop, payments.signed_payments(feed, SECRET, "bigint"))


def test_signature_equals_hmac(spark):
    texts = ["", "a", "ünïcode ☃", "x" * 500]
    for secret in ("k", "a longer secret " * 8, "longer than a block " * 20):
        df = spark.createDataFrame([(t,) for t in texts], "body string").select("body", hmac_sha512(F.col("body"), secret).alias("h"))
        assert {r.body: r.h for r in df.collect()} == {
            t: hmac.new(secret.encode(), t.encode(), hashlib.sha512).hexdigest() for t in texts}


def test_events_become_orders_once(spark):
    shop = small_shop(spark)
    done = judged(spark, shop)
    made = {(r.reference, r.product_id, float(r.amount), r.quantity, r.customer_name, r.user_id)
            for r in payments.order_rows(shop, done.lines).collect()}
    assert made == {(50, 1, 5.0, 2, "Ann", 1), (50, 2, 3.25, 1, "Ann", 1), (57, 2, 3.25, 1, "Bob", 2)}
    assert {r.request_id: r.reason for r in done.rejects.collect()} == {
        "e4": "Invalid signature", "e5": "Payment verification failed: No funds",
        "e6": "Payment verification failed: Unknown error",
        "e7": "Delivery address details are incomplete. Please provide complete address information.",
        "e8": "User not found", "e9": "No valid orders were created", "f2": "Invalid payment metadata",
        "f3": "Invalid product descriptions"}
    assert {(r.order_id, r.status, r.city) for r in payments.delivery_rows(done.accepted).collect()} == {
        (50, "pending", "C"), (57, "pending", "C")}


def test_a_batch_applied_twice_changes_nothing_more(spark):
    shop = small_shop(spark)
    first = payments.order_rows(shop, judged(spark, shop).lines)
    after = shop.replace(order_lines=shop.order_lines.unionByName(first))
    again = judged(spark, after)
    assert again.lines.count() == 0 and again.accepted.count() == 0


def test_stock_and_cart_follow_the_orders(spark):
    shop = small_shop(spark)
    feed = spark.createDataFrame(EVENTS, "event_id string, signature string, body string")
    done = payments.apply_payments(shop, payments.new_payments(shop, payments.signed_payments(feed, SECRET, "bigint")))
    stock = {r.id: r.total_stock for r in done["products"].collect()}
    assert stock == {1: 7, 2: 2, 3: 0, 4: 3, 5: 1}
    assert {r.id for r in done["carts"].collect()} == {"k3"}
    assert done["order_lines"].select("id").distinct().count() == 3


def test_payment_details(spark):
    shop = small_shop(spark)
    feed = spark.createDataFrame(EVENTS, "event_id string, signature string, body string")
    paid = payments.valid_payments(payments.signed_payments(feed, SECRET, "bigint"))
    rows = orders.order_payment_details(shop, paid).collect()
    assert {(r.id, r.paid_amount, r.last4, r.customer_email) for r in rows} == {
        ("o1", 12.34, "4242", "p@x.com"), ("o2", 12.34, "4242", "p@x.com")}


def test_text_keys_work_as_well(spark):
    shop = small_shop(spark)
    kinds = {"products": ["id"], "images": ["product_id"], "users": ["id"], "order_lines": ["reference", "product_id", "user_id"],
             "carts": ["user_id", "product_id"], "customers": ["user_id"]}
    texts = {t: getattr(shop, t).withColumns({c: F.col(c).cast("string") for c in cs}) for t, cs in kinds.items()}
    shop = shop.replace(**texts)
    feed = spark.createDataFrame(EVENTS, "event_id string, signature string, body string")
    done = payments.apply_payments(shop, payments.new_payments(shop, payments.signed_payments(feed, SECRET, "string")))
    assert {(r.reference, r.product_id) for r in done["order_lines"].collect()} == {("50", "1"), ("50", "2"), ("57", "2")}


def test_derived_events_are_signed_as_stated(spark):
    feed = testdata.payment_events(spark, "/root/testdata/sf0.001").limit(50).collect()
    for row in feed:
        real = hmac.new(testdata.TEST_SECRET.encode(), row.body.encode(), hashlib.sha512).hexdigest()
        assert (real == row.signature) == (int(row.event_id.split("#")[0]) % 11 != 0)


def test_frames_are_complete(spark):
    assert frame(spark, "users").count() == len(ROWS["users"])


def sent(event_id, reference, status="success", city="C", user=1):
    line = {"productId": "1", "productName": "soap", "productTotal": 5.0, "quantity": 2}
    body = json.dumps({"data": {"reference": reference, "status": status, "paid_at": "2024-05-01T00:00:00Z", "metadata": {
        "userId": str(user), "products": {"productDescriptions": [line], "deliveryDetails": {"address": "A", "city": city, "state": "S", "country": "K"}}}}})
    return event_id, hmac.new(SECRET.encode(), body.encode(), hashlib.sha512).hexdigest(), body


CORRECTED = [sent("e1", "70", city=None), sent("e2", "70"), sent("e3", "70", user=77), sent("e4", "71", status="failed"), sent("e5", "71"),
             sent("e6", "no-key"), sent("e7", "other"), sent("e8", None), sent("e9", "72", user=77)]


def test_a_corrected_payment_is_booked(spark):
    done = judged(spark, small_shop(spark), CORRECTED)
    assert {r.event_id for r in done.accepted.collect()} == {"e2", "e5"}
    assert {r.request_id: r.reason for r in done.rejects.collect()} == {
        "e1": "Delivery address details are incomplete. Please provide complete address information.",
        "e4": "Payment verification failed: Unknown error", "e6": "Invalid payment reference", "e7": "Invalid payment reference",
        "e8": "Invalid payment reference", "e9": "User not found"}


def test_batch_borders_change_nothing(spark):
    shop, accepted, rejects = small_shop(spark), set(), {}
    for event in CORRECTED:
        done = judged(spark, shop, [event])
        accepted |= {r.event_id for r in done.accepted.collect()}
        rejects |= {r.request_id: r.reason for r in done.rejects.collect()}
        orders_now = spark.createDataFrame(payments.order_rows(shop, done.lines).collect(), shop.order_lines.schema)
        shop = shop.replace(order_lines=shop.order_lines.unionByName(orders_now))
    whole = judged(spark, small_shop(spark), CORRECTED)
    assert accepted == {r.event_id for r in whole.accepted.collect()}
    assert rejects == {r.request_id: r.reason for r in whole.rejects.collect()}
