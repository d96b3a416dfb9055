import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F
from small_shop import ROWS, T0, frame, small_shop
from test_payments import CAMEL, EVENTS, SECRET, SNAKE, event

from merchlake.plans import sales
from merchlake.plans.changes import carts, payments
from merchlake.plans.facts import paid_lines
from merchlake.session import shuffles_removed
from merchlake.sources.buckets import BucketStore
from merchlake.streaming import jobs, ledger as ledgers
from merchlake.streaming.ledger import PaymentLedger
from merchlake.streaming.rollup import SalesRollUp

KEYS = ["event_id", "signature", "body"]
CART_LOG = "event_id bigint, ts timestamp, user_id bigint, event_type string, product_id bigint, quantity bigint"


def write_file(folder, number, lines):
    """The source takes files in order of their time, so each gets its own."""
    path = folder / f"{number:03}.json"
    path.write_text("\n".join(lines))
    os.utime(path, (1_700_000_000 + number, 1_700_000_000 + number))


def drop_files(folder, *batches):
    """One JSON file per batch, in order of arrival."""
    folder.mkdir(exist_ok=True)
    for events in batches:
        number = len(list(folder.iterdir()))
        lines = [json.dumps({**dict(zip(KEYS, e)), "sent_at": "2024-05-01T00:00:00Z"}) for e in events]
        write_file(folder, number, lines)


def test_ingest_over_several_batches_books_each_reference_once(spark, tmp_path):
    shop, out = small_shop(spark), str(tmp_path / "out")
    drop_files(tmp_path / "in", EVENTS[:1], EVENTS[1:], [event("g1", 50, [CAMEL]), event("g2", 70, [SNAKE])])

    def run():
        feed = jobs.payment_feed(spark, str(tmp_path / "in"), files_per_batch=1)
        jobs.run_to_end(jobs.ingest_payments(feed, shop, SECRET, out), str(tmp_path / "ckpt"))
        return {(r.reference, r.product_id) for r in after("order_lines").collect()}

    def after(table):
        return jobs.payment_state(spark, shop, out)[table]

    assert run() == {(50, 1), (50, 2), (57, 2), (70, 2)}
    assert after("order_lines").count() == 4
    assert after("deliveries").count() == 3
    assert after("rejects").count() == 8
    drop_files(tmp_path / "in", [event("h1", 70, [SNAKE]), event("h2", 71, [CAMEL])])
    assert run() == {(50, 1), (50, 2), (57, 2), (70, 2), (71, 1)}
    assert after("order_lines").count() == 5


def test_a_lost_batch_runs_again_without_doubling(spark, tmp_path):
    shop, out = small_shop(spark), str(tmp_path / "out")
    drop_files(tmp_path / "in", EVENTS)
    for attempt in ("first", "second"):  # a new checkpoint: batch 0 is processed again
        feed = jobs.payment_feed(spark, str(tmp_path / "in"))
        jobs.run_to_end(jobs.ingest_payments(feed, shop, SECRET, out), str(tmp_path / f"ckpt-{attempt}"))
        assert jobs.payment_state(spark, shop, out)["order_lines"].count() == 3


def test_dedup_within_and_beyond_the_state(spark, tmp_path):
    out = str(tmp_path / "out")
    stored = spark.createDataFrame([(10,)], "reference bigint")
    drop_files(tmp_path / "in", [EVENTS[0], EVENTS[1], EVENTS[2], EVENTS[3]], [event("z", 50, [CAMEL]), event("y", 60, [CAMEL])])

    def run(checkpoint):
        feed = jobs.payment_feed(spark, str(tmp_path / "in"), files_per_batch=1)
        jobs.run_to_end(jobs.dedup_payments(feed, stored, SECRET, "bigint", out), str(tmp_path / checkpoint))
        return sorted(r.reference for r in spark.read.parquet(out).collect())

    assert run("one") == [50, 60]


@pytest.mark.parametrize("files", [1, 4])
def test_cart_feed_equals_the_whole_log(spark, tmp_path, files):
    kinds = ["click", "click", "error", "purchase", "view"]
    rows = [(n, T0 + dt.timedelta(minutes=(n * 37) % 211), n % 5, kinds[(n * 7) % 5], n % 3, n % 9 + 1) for n in range(200)]
    log = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, product_id bigint, quantity bigint")
    for part in range(files):  # pieces out of order in time
        log.filter(F.col("event_id") % files == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    feed = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    base = str(tmp_path / "state")
    jobs.run_to_end(jobs.cart_feed(feed, base), str(tmp_path / "ckpt"))
    got = jobs.cart_store(spark, CART_LOG, base).read("carts").select("user_id", "product_id", "quantity").collect()
    want = carts.cart_state(log).select("user_id", "product_id", "quantity").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want


def daily_rows(spark, tmp_path, files, lateness=None):
    folder = tmp_path / "lines"
    folder.mkdir()
    for number, rows in enumerate(files):
        write_file(folder, number, [json.dumps({"created_at": day.isoformat() + "Z", "amount": amount}) for day, amount in rows])
    feed = spark.readStream.schema("created_at timestamp, amount decimal(12,2)").option("maxFilesPerTrigger", 1).json(str(folder))
    out = str(tmp_path / "out")
    jobs.run_to_end(jobs.daily_sales(feed, out, lateness), str(tmp_path / "ckpt"))
    return {r.day: float(r.total) for r in jobs.latest_days(spark, out).collect()}


FILES = [
    [(dt.datetime(2024, 1, 1, 1), 5.5), (dt.datetime(2024, 1, 1, 23), 1.0)],
    [(dt.datetime(2024, 1, 9, 1), 2.0)],
    [(dt.datetime(2024, 1, 9, 3), 0.5)],  # a batch later, the limit set by the one before is in force
    [(dt.datetime(2024, 1, 9, 5), 2.0), (dt.datetime(2024, 1, 1, 2), 100.0)],
]


def test_daily_sales_keep_late_rows(spark, tmp_path):
    assert daily_rows(spark, tmp_path, FILES) == {dt.date(2024, 1, 1): 106.5, dt.date(2024, 1, 9): 4.5}


def test_daily_sales_close_old_days_on_request(spark, tmp_path):
    assert daily_rows(spark, tmp_path, FILES, "1 day") == {dt.date(2024, 1, 1): 6.5, dt.date(2024, 1, 9): 4.5}


def test_a_second_feed_is_not_lost(spark, tmp_path):
    kinds = "event_id bigint, ts timestamp, user_id bigint, event_type string, product_id bigint, quantity bigint"
    base = str(tmp_path / "state")
    for name, rows in (("one", [(1, T0, 1, "click", 1, 2)]), ("two", [(2, T0, 2, "click", 5, 3)])):
        spark.createDataFrame(rows, kinds).write.parquet(str(tmp_path / name))
        feed = spark.readStream.schema(kinds).parquet(str(tmp_path / name))
        jobs.run_to_end(jobs.cart_feed(feed, base), str(tmp_path / f"ckpt-{name}"))
    got = jobs.cart_store(spark, CART_LOG, base).read("carts").select("user_id", "product_id", "quantity").collect()
    assert sorted(map(tuple, got)) == [(1, 1, 2), (2, 5, 3)]


def test_stock_and_carts_follow_the_feed(spark, tmp_path):
    shop, out = small_shop(spark), str(tmp_path / "out")
    drop_files(tmp_path / "in", EVENTS)
    for attempt in ("first", "second"):
        feed = jobs.payment_feed(spark, str(tmp_path / "in"))
        jobs.run_to_end(jobs.ingest_payments(feed, shop, SECRET, out), str(tmp_path / f"ckpt-{attempt}"))
        after = jobs.payment_state(spark, shop, out)
        stock = {r.id: r.total_stock for r in after["products"].collect()}
        assert stock == {1: 7, 2: 2, 3: 0, 4: 3, 5: 1}
        assert {r.id for r in after["carts"].collect()} == {"k3"}
    # Another feed with the same events books nothing more.
    feed = jobs.payment_feed(spark, str(tmp_path / "in"))
    jobs.run_to_end(jobs.ingest_payments(feed, shop, SECRET, out), str(tmp_path / "ckpt-other"))
    assert jobs.payment_state(spark, shop, out)["order_lines"].count() == 3


def test_dedup_waits_for_the_paid_event(spark, tmp_path):
    out, stored = str(tmp_path / "out"), spark.createDataFrame([(10,)], "reference bigint")
    drop_files(tmp_path / "in", [event("a", 50, [CAMEL], status="failed")], [event("b", 50, [CAMEL])])
    feed = jobs.payment_feed(spark, str(tmp_path / "in"), files_per_batch=1)
    jobs.run_to_end(jobs.dedup_payments(feed, stored, SECRET, "bigint", out), str(tmp_path / "ckpt"))
    assert [(r.reference, r.payment_status) for r in spark.read.parquet(out).collect()] == [(50, "success")]


def shop_state(state):
    """All that payments change, as plain values."""
    shown = {"order_lines": ["reference", "product_id", "amount", "status", "created_at"], "deliveries": ["order_id", "city", "status"],
             "products": ["id", "total_stock", "oversold"], "carts": ["id"], "rejects": ["request_id", "reason"]}
    return {table: sorted(map(tuple, state[table].select(columns).collect()), key=repr) for table, columns in shown.items()}


def batch_state(spark, shop, events):
    parsed = payments.signed_payments(spark.createDataFrame(events, "event_id string, signature string, body string"), SECRET, "bigint")
    return shop_state(payments.apply_payments(shop, payments.new_payments(shop, parsed)))


# One reference: a bad event, a good one, a later bad one, a later good one of another amount.
LATE = [event("m1", 90, []), event("m2", 90, [CAMEL]), event("m3", 90, []), event("m4", 90, [SNAKE])]


@pytest.mark.parametrize("order", [[0, 1, 2, 3], [3, 2, 1, 0], [2, 3, 0, 1], [3, 1, 2, 0]])
def test_bookings_do_not_hang_on_arrival(spark, tmp_path, order):
    shop, out = small_shop(spark), str(tmp_path / "out")
    ledger = PaymentLedger(spark, shop, out, buckets=4)
    ledger.prepare()
    for events in ([LATE[at]] for at in order):
        ledger.apply(spark.createDataFrame(events, "event_id string, signature string, body string"), SECRET)
    got = shop_state(ledger.state())
    assert got == batch_state(spark, shop, LATE)
    assert [row[0] for row in got["rejects"]] == ["m1"] and {row[1] for row in got["order_lines"]} == {1}


def test_shuffled_feeds_equal_the_batch_flow(spark, tmp_path):
    shop, events = small_shop(spark), EVENTS + LATE
    want = batch_state(spark, shop, events)
    dice = random.Random(8)
    for number in range(2):
        mixed = dice.sample(events, len(events))
        cut = dice.randrange(1, len(mixed))
        drop_files(tmp_path / f"in-{number}", mixed[:cut], mixed[cut:], mixed[:3])  # some are sent again
        feed = jobs.payment_feed(spark, str(tmp_path / f"in-{number}"), files_per_batch=1)
        out = str(tmp_path / f"out-{number}")
        jobs.run_to_end(jobs.ingest_payments(feed, shop, SECRET, out), str(tmp_path / f"ckpt-{number}"))
        assert shop_state(jobs.payment_state(spark, shop, out)) == want


def test_a_batch_reads_and_writes_its_own_buckets(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path / "s"), "k", {"t": "k bigint, v int", "log": "v int"}, buckets=16)
    store.write(range(16), {"t": spark.range(400).select(F.col("id").alias("k"), F.lit(0).alias("v"))})
    piece = spark.createDataFrame([(7, 1), (8, 1)], "k bigint, v int")
    touched = store.touched(piece)
    before = {path for _, _, path in store._entries(1)}
    assert len(before) == 16 and 1 <= len(touched) <= 2
    assert len({row[0] for row in store.read("t", touched).select(store.bucket()).distinct().collect()}) == len(touched)
    assert len(store.read("t", touched).inputFiles()) == len(touched)
    kept = store.read("t", touched).join(piece.select("k"), "k", "left_anti")
    store.write(touched, {"t": kept.unionByName(piece)}, {"log": piece.select("v")})
    after = {path for name, _, path in store._entries(2) if name == "t"}
    assert len(after - before) == len(touched) and len(after & before) == 16 - len(touched)
    assert store.read("t").filter("v = 1").count() == 2 and store.read("t").count() == 400 and store.read("log").count() == 2
    assert store.read("t", version=1).filter("v = 1").count() == 0
    store.write(touched, {"t": kept.filter("false")})
    store.tidy(keep=1)
    assert store.read("t").count() == 400 - kept.count() - 2 and store.read("log").count() == 2


def test_a_reader_between_two_writes_sees_the_old_state(spark, tmp_path, monkeypatch):
    shop, out = small_shop(spark), str(tmp_path / "out")
    ledger = PaymentLedger(spark, shop, out, buckets=4)
    ledger.prepare()
    kinds = "event_id string, signature string, body string"
    ledger.apply(spark.createDataFrame(EVENTS, kinds), SECRET)
    want, seen, children = shop_state(ledger.state()), [], BucketStore._children

    def looking(store, path):
        # Called when a table of the new version has been written and its manifest has not.
        if path.endswith(("/booked", "/faults")):
            seen.append(shop_state(ledger.state()))
        return children(store, path)

    monkeypatch.setattr(BucketStore, "_children", looking)
    ledger.apply(spark.createDataFrame([event("h2", 71, [CAMEL])], kinds), SECRET)
    monkeypatch.undo()
    assert seen == [want, want] and shop_state(ledger.state()) != want


def test_a_repeated_cart_batch_changes_nothing(spark, tmp_path):
    rows = [(n, T0 + dt.timedelta(minutes=n), n % 7, ["click", "error", "purchase"][n % 3], n % 3, n % 5 + 1) for n in range(60)]
    spark.createDataFrame(rows, CART_LOG).write.parquet(str(tmp_path / "log"))
    base, states = str(tmp_path / "state"), []
    for attempt in ("one", "two"):
        feed = spark.readStream.schema(CART_LOG).parquet(str(tmp_path / "log"))
        jobs.run_to_end(jobs.cart_feed(feed, base), str(tmp_path / f"ckpt-{attempt}"))
        store = jobs.cart_store(spark, CART_LOG, base)
        states.append({table: sorted(map(repr, store.read(table).collect())) for table in ("settings", "payments", "carts")})
    assert states[0] == states[1] and states[0]["carts"]


def test_rollup_in_any_cut(spark, shop, tmp_path):
    """Batches in any number and order, some of them sent again, give the sums of the whole; untouched buckets stay."""
    lines = shop.order_lines
    whole, cut = (SalesRollUp(spark, f"{tmp_path}/{name}", buckets=4) for name in ("whole", "cut"))
    assert whole.add("all", lines)
    for part in (2, 0, 2, 1):
        cut.add(f"part {part}", lines.filter(F.col("reference") % 3 == part))
    assert not cut.add("part 1", lines) and cut.store.version() == 3
    for unit in ("week", "year"):
        assert sorted(whole.products(unit).collect()) == sorted(cut.products(unit).collect())
        assert sorted(whole.totals(unit).collect()) == sorted(cut.totals(unit).collect())
    before = cut.store.read("product_days").inputFiles()
    day = lines.filter("status = 'success'").agg(F.max("created_at")).first()[0]
    cut.add("one day", lines.filter(F.col("created_at") == F.lit(day)).limit(5))
    assert 0 < len(set(before) - set(cut.store.read("product_days").inputFiles())) < len(before)


def test_rollup_of_odd_rows(spark, tmp_path):
    rows = ROWS["order_lines"] + [("o7", 15, None, None, None, None, "success", None)]
    rolled = SalesRollUp(spark, f"{tmp_path}/odd", buckets=2)
    assert rolled.add("none", frame(spark, "order_lines", [])) and rolled.totals("month").count() == 0
    assert rolled.add("some", frame(spark, "order_lines", rows))
    found = {str(r.month): (r.order_count, r.items_sold, r.revenue and float(r.revenue), r.approx_customers) for r in rolled.totals("month").collect()}
    assert found == {"2024-01-01": (3, 4, 15.0, 1), "2023-12-01": (1, 1, 9.99, 1), "2023-11-01": (1, 3, None, 1), "None": (1, None, None, 0)}


def test_rollup_as_a_stream(spark, shop, tmp_path):
    shop.order_lines.repartition(3).write.parquet(f"{tmp_path}/lines")
    feed = spark.readStream.schema(shop.order_lines.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/lines")
    rolled = SalesRollUp(spark, f"{tmp_path}/rolled", buckets=2)
    jobs.run_to_end(rolled.feed(feed, "lines"), f"{tmp_path}/checkpoint")
    expected = sales.by_product(paid_lines(shop), "month").select("month", "product_id", "quantity_sold", "revenue", "order_count")
    assert sorted(rolled.products("month").collect()) == sorted(expected.collect())


def test_only_unknown_payments_are_joined_to_users(spark, tmp_path, monkeypatch):
    """Refused events and repeats of stored references are the most of a feed; neither is shuffled to its user."""
    shop, seen, faulted = small_shop(spark), [], payments.faulted_payments

    def looking(shop, parsed):
        seen.append({(row.event_id, row.lines is None) for row in parsed.collect()})
        return faulted(shop, parsed)

    ledger = PaymentLedger(spark, shop, str(tmp_path / "out"), buckets=4)
    monkeypatch.setattr(ledgers, "faulted_payments", looking)
    ledger.prepare()
    ledger.apply(spark.createDataFrame(EVENTS, "event_id string, signature string, body string"), SECRET)
    assert [{name for name, _ in one} for one in seen] == [{"e1", "e2", "e7", "e8", "e9", "f1", "f2", "f3"}]
    assert {name for name, bare in seen[0] if bare} == {"f2", "f3"}
    assert shop_state(ledger.state()) == batch_state(spark, shop, EVENTS)


def shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {os.path.join(at, name) for folder in folders for at, _, names in os.walk(folder.getPath()) for name in names if name.startswith("shuffle_")}


def test_shuffles_go_with_their_action(spark, tmp_path):
    name, kept = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", shuffle_files(spark)
    before = spark.conf.get(name, None)
    drop_files(tmp_path / "in", EVENTS)

    def write(batch, number):
        batch.repartition(3).write.parquet(str(tmp_path / "two"))

    with shuffles_removed(spark):
        spark.range(1000).repartition(5).write.parquet(str(tmp_path / "one"))
        jobs.run_to_end(jobs.payment_feed(spark, str(tmp_path / "in")).writeStream.foreachBatch(write), str(tmp_path / "ckpt"))
    assert spark.conf.get(name, None) == before
    assert shuffle_files(spark) <= kept
    assert spark.read.parquet(str(tmp_path / "one")).count() == 1000 and spark.read.parquet(str(tmp_path / "two")).count() == len(EVENTS)
