from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from merchlake.plans.changes import carts as cart_changes
from merchlake.plans.changes.payments import signed_payments
from merchlake.sources.buckets import BucketStore
from merchlake.sources.shop import Shop
from merchlake.streaming.ledger import PaymentLedger

EVENT_SCHEMA = "event_id string, sent_at timestamp, signature string, body string"


def run_to_end(writer: DataStreamWriter, checkpoint: str) -> None:
    """Process what has arrived, then stop."""
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def payment_feed(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """The webhook's events, dropped as JSON files into a folder."""
    reader = spark.readStream.schema(EVENT_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(folder)


def drop_events(events: DataFrame, folder: str, *parts: str, records: int = 20_000) -> None:
    """Write events as such a folder, or one per value of ``parts``: lines of JSON, packed to about a sixth.

    A packed file is read by one task, so a file has at most ``records`` events.
    """
    events.write.partitionBy(*parts).option("compression", "gzip").option("maxRecordsPerFile", records).json(folder)


def _written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of all feeds and micro-batches so far, with ``stream`` and ``batch_id``."""
    try:
        return spark.read.schema(f"{schema}, stream string, batch_id bigint").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, stream string, batch_id bigint")


def ingest_payments(feed: DataFrame, shop: Shop, secret: str, out: str, buckets: int = 64) -> DataStreamWriter:
    """Signed events to the ledger of payments below ``out``, each reference booked once.

    What the events make of the shop is read with :func:`payment_state`. It is that of all events in one
    batch, in whatever order and cut they arrive; a batch that runs again, or another feed with the same
    events, changes nothing. A batch reads and writes the buckets of its references alone.
    """

    def book(events: DataFrame, batch_id: int) -> None:
        ledger = PaymentLedger(events.sparkSession, shop, out, buckets)
        ledger.prepare()
        ledger.apply(events, secret)
        ledger.store.tidy()

    return feed.writeStream.foreachBatch(book)


def payment_state(spark: SparkSession, shop: Shop, out: str, buckets: int = 64) -> dict[str, DataFrame]:
    """Orders, deliveries, products, carts and rejects after all that :func:`ingest_payments` has booked, as of one version."""
    return PaymentLedger(spark, shop, out, buckets).state()


def dedup_payments(feed: DataFrame, stored: DataFrame, secret: str, key_type: str, out: str,
                   remember: str = "1 day", stream: str = "main", buckets: int = 64) -> DataStreamWriter:
    """Valid events, each reference once, however often it is sent.

    Repeats within ``remember`` of the first arrival are dropped by the state store. The time is
    that of arrival, so no event is ever too late. Later repeats are found in an index of references
    beside ``out``, stored before or written by earlier batches, of which a batch reads its own buckets.
    """
    columns = ["reference", "payment_status", "amount_minor", "customer_email"]
    # Only these columns go through the shuffle and the state.
    # A failed attempt must not stand in the way of the payment that follows it.
    valid = F.col("signature_ok") & F.col("payment_status").eqNullSafe("success") & F.col("reference").isNotNull()
    parsed = signed_payments(feed, secret, key_type).filter(valid).select(columns)
    timed = parsed.withColumn("arrived_at", F.current_timestamp()).withWatermark("arrived_at", remember)
    once = timed.dropDuplicatesWithinWatermark(["reference"])

    def write(batch: DataFrame, batch_id: int) -> None:
        index = BucketStore(batch.sparkSession, f"{out.rstrip('/')}-index", "reference",
                            {"known": f"reference {key_type}, stream string, batch_id bigint"}, buckets)
        if not index.version():
            before = stored.select("reference").filter("reference is not null").distinct()
            index.write(range(buckets), {"known": before.select("reference", F.lit("").alias("stream"), F.lit(-1).cast("bigint").alias("batch_id"))})
        batch.persist()
        try:
            touched = index.touched(batch)
            # A batch that runs again does not know what it wrote itself.
            known = index.read("known", touched).filter((F.col("stream") != stream) | (F.col("batch_id") < batch_id))
            fresh = batch.select(columns).join(known.select("reference"), "reference", "left_anti").persist()
            fresh.write.mode("overwrite").parquet(f"{out}/stream={stream}/batch_id={batch_id}")
            own = fresh.select("reference", F.lit(stream).alias("stream"), F.lit(batch_id).cast("bigint").alias("batch_id"))
            index.write(touched, {"known": known.unionByName(own)})
            index.tidy()
            fresh.unpersist()
        finally:
            batch.unpersist()

    return once.writeStream.foreachBatch(write)


def cart_store(spark: SparkSession, log_schema: StructType | str, base: str, buckets: int = 64) -> BucketStore:
    """Keyed cart state below ``base``, in buckets by user; ``log_schema`` is that of the cart log."""
    piece = spark.createDataFrame([], log_schema)
    settings, payments = cart_changes.last_settings(piece), cart_changes.last_payments(piece).withColumnRenamed("_payer", "user_id")
    carts = cart_changes.carts_from(settings, cart_changes.last_payments(piece))
    return BucketStore(spark, base, "user_id", {"settings": settings.schema, "payments": payments.schema, "carts": carts.schema}, buckets)


def cart_feed(log: DataFrame, base: str, buckets: int = 64) -> DataStreamWriter:
    """Keyed cart state from the cart log, published batch by batch.

    The state is the last setting per (user, product) and the last payment per user. Both are
    maxima, so log pieces may arrive in any order and more than once, from one feed or from several in
    turn. A batch merges its users' buckets and leaves all others as they are; ``carts`` is derived from
    the merged ones and published with them. Read it with ``cart_store(...).read("carts")``.
    """
    schema = log.schema

    def merge(piece: DataFrame, batch_id: int) -> None:
        store = cart_store(piece.sparkSession, schema, base, buckets)
        piece.persist()
        try:
            version, touched = store.version(), store.touched(piece)
            earlier = store.read("payments", touched, version).withColumnRenamed("user_id", "_payer")
            settings = cart_changes.merge_settings(store.read("settings", touched, version), cart_changes.last_settings(piece))
            payments = cart_changes.merge_payments(earlier, cart_changes.last_payments(piece))
            store.write(touched, {"settings": settings, "payments": payments.withColumnRenamed("_payer", "user_id"),
                                  "carts": cart_changes.carts_from(settings, payments)})
            store.tidy()
        finally:
            piece.unpersist()

    return log.writeStream.foreachBatch(merge)


def daily_sales(lines: DataFrame, out: str, lateness: str | None = None, stream: str = "main") -> DataStreamWriter:
    """Sales by day from a stream of ``(created_at, amount)``; each batch writes the days it changed.

    The state holds one row per day, so by default all days stay open and no late row is lost. With
    ``lateness`` older days are closed and dropped from the state, and so are rows later than that.
    """
    if lateness:
        lines = lines.withWatermark("created_at", lateness)
    per_day = lines.groupBy(F.window("created_at", "1 day")).agg(F.sum("amount").alias("total"))
    days = per_day.select(F.col("window.start").cast("date").alias("day"), "total")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/stream={stream}/batch_id={batch_id}")

    return days.writeStream.outputMode("update").foreachBatch(write)


def latest_days(spark: SparkSession, out: str) -> DataFrame:
    """The newest figure of each day written by :func:`daily_sales`, summed over its feeds."""
    written = _written(spark, out, "day date, total decimal(38,2)")
    newest = written.groupBy("stream", "day").agg(F.max_by("total", "batch_id").alias("total"))
    return newest.groupBy("day").agg(F.sum("total").cast("decimal(38,2)").alias("total"))
