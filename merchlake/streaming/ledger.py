"""Bookings of payments by reference, the same for every order and every cut of the events.

For each reference the ledger keeps its smallest acceptable event so far, which is its booking, and the
events that were refused for a fault of their own. A smaller acceptable event that arrives later takes the
booking's place, and a faulty one counts as refused only while no smaller booking stands. Both are minima
and sets, so batches may come in any order and more than once. Orders, deliveries, stock, carts and rejects
are read from one published version of the ledger, so they always belong together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchlake.plans.changes.payments import Payments, apply_payments, faulted_payments, refusal, signed_payments
from merchlake.sources.buckets import BucketStore
from merchlake.sources.payments import payment_lines
from merchlake.sources.shop import Shop

_BOOKING = ["reference", "event_id", "user_id", "customer_name", "paid_at", "address", "city", "state", "country", "lines"]
# What an event is booked or refused by, besides its id; the customer's name comes from the shop.
_ASKED = [*(name for name in _BOOKING if name not in ("event_id", "customer_name")), "has_products"]


class PaymentLedger:
    """The ledger below ``base`` for one shop; the shop's own orders are known references from the start."""

    def __init__(self, spark: SparkSession, shop: Shop, base: str, buckets: int = 64):
        self.spark, self.shop = spark, shop
        self.key_type = shop.key_type("order_lines", "reference")
        events = spark.createDataFrame([], "event_id string, body string, signature string")
        bookings = faulted_payments(shop, signed_payments(events, "", self.key_type)).select(_BOOKING).schema
        self.store = BucketStore(spark, base, "reference", {
            "known": f"reference {self.key_type}", "booked": bookings,
            "faults": f"reference {self.key_type}, event_id string, fault string", "answers": "event_id string, reason string",
        }, buckets)

    def prepare(self) -> None:
        """Deal the references of the shop's orders to their buckets, once."""
        if not self.store.version():
            known = self.shop.order_lines.select("reference").filter(F.col("reference").isNotNull()).distinct()
            self.store.write(range(self.store.buckets), {"known": known})

    def apply(self, events: DataFrame, secret: str) -> None:
        """Book a batch. Only the buckets of the batch's references are read and written."""
        parsed = signed_payments(events, secret, self.key_type).withColumn("_reason", refusal())
        # A refused event is done with its answer: nothing else of it is kept, on disk where memory ends.
        asked = [F.when(F.col("_reason").isNull(), F.col(name)).alias(name) for name in _ASKED]
        judged = parsed.select("event_id", "_reason", *asked).persist()
        try:
            open_ = judged.filter("_reason is null")
            touched = self.store.touched(open_)
            version = self.store.version()
            # Only what is not known yet is shuffled to its user.
            fresh = faulted_payments(self.shop, open_.join(self.store.read("known", touched, version), "reference", "left_anti"))
            rest = [name for name in _BOOKING if name not in ("reference", "event_id")]
            booked = self.store.read("booked", touched, version).unionByName(fresh.filter("fault is null").select(_BOOKING))
            booked = booked.groupBy("reference").agg(F.min(F.struct("event_id", *rest)).alias("_first")).select("reference", "_first.*")
            faults = fresh.filter("fault is not null").select("reference", "event_id", "fault")
            faults = self.store.read("faults", touched, version).unionByName(faults).distinct()
            answers = judged.filter("_reason is not null").select("event_id", F.col("_reason").alias("reason"))
            self.store.write(touched, {"booked": booked, "faults": faults}, {"answers": answers})
        finally:
            judged.unpersist()

    def payments(self, version: int | None = None) -> Payments:
        """All payments booked so far, their lines, and the rejects, as of one version."""
        version = self.store.version() if version is None else version
        booked = self.store.read("booked", version=version)
        firsts = booked.select(F.col("reference").alias("_reference"), F.col("event_id").alias("_first"))
        faults = self.store.read("faults", version=version).join(firsts, F.col("reference") == F.col("_reference"), "left")
        faults = faults.filter(F.col("_first").isNull() | (F.col("event_id") < F.col("_first"))).select("event_id", F.col("fault").alias("reason"))
        # An event that was sent in two batches has one answer.
        answers = self.store.read("answers", version=version).unionByName(faults).distinct()
        lines = payment_lines(booked, "reference", "user_id", "customer_name", "paid_at")
        return Payments(booked, lines, answers.select(F.col("event_id").alias("request_id"), "reason"))

    def state(self) -> dict[str, DataFrame]:
        """Orders and deliveries that the payments made, the shop's products and carts after them, and rejects."""
        return apply_payments(self.shop, self.payments())
