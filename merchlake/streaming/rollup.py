"""Sales by day, kept up to date batch by batch.

Sums and counts by (day, product) add up to any longer period, and sketches of a day's customers unite
to those of any longer period, so weeks, months and years are read from here and not from the fact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from merchlake.functions import bucket
from merchlake.plans.facts import money_columns
from merchlake.plans.sales import with_names
from merchlake.sources.buckets import BucketStore
from merchlake.sources.shop import Shop

_REVENUE = "decimal(28,2)"
_SUMS = ["quantity_sold", "revenue", "order_count"]


class SalesRollUp:
    """Day partials below ``base``, in buckets by day.

    A batch of lines is reduced to its days, merged with the buckets of these days and published in one version
    together with its own name, so a batch that is added again changes nothing. A line must come in one batch only.
    The relative error of a sketch with 2^k places is about 1.04 / 2^(k/2): 0.4 % for 16, in at most 64 KB a day.
    """

    def __init__(self, spark: SparkSession, base: str, product_type: str = "bigint", buckets: int = 64, places: int = 16):
        self.places = places
        self.store = BucketStore(spark, base, "day", {
            "product_days": f"day date, product_id {product_type}, quantity_sold bigint, revenue {_REVENUE}, order_count bigint",
            "customer_days": "day date, customers binary",
            "batches": "batch string",
        }, buckets)

    def add(self, batch: str, lines: DataFrame) -> bool:
        """Merge the paid lines of a batch; false if it was merged before."""
        if not self.store.read("batches").filter(F.col("batch") == batch).isEmpty():
            return False
        day = F.col("created_at").cast("date").alias("day")
        paid = lines.filter(F.col("status") == "success").select(day, "product_id", "quantity", "amount", "user_id")
        paid.persist()
        try:
            touched = self.store.touched(paid)
            sums = paid.select("day", "product_id", F.col("quantity").alias("quantity_sold"), F.col("amount").alias("revenue"),
                               F.lit(1).cast("long").alias("order_count"))
            products = _added(sums.unionByName(self.store.read("product_days", touched)), "day", "product_id")
            seen = paid.groupBy("day").agg(F.hll_sketch_agg("user_id", F.lit(self.places)).alias("customers"))
            customers = seen.unionByName(self.store.read("customer_days", touched)).groupBy("day").agg(
                F.hll_union_agg("customers").alias("customers"))
            named = self.store.spark.range(1).select(F.lit(batch).alias("batch"))
            self.store.write(touched, {"product_days": products, "customer_days": customers}, {"batches": named})
        finally:
            paid.unpersist()
        return True

    def feed(self, lines: DataFrame, stream: str) -> DataStreamWriter:
        """A stream of order lines into the roll-up; ``stream`` tells its batches from those of other feeds."""
        return lines.writeStream.foreachBatch(lambda batch, number: self.add(f"{stream}-{number}", batch) and None)

    def products(self, unit: str) -> DataFrame:
        """Per bucket of time and product id: quantity, revenue (decimal) and lines."""
        days = self.store.read("product_days")
        return _added(days.withColumn(unit, bucket(unit, F.col("day"))), unit, "product_id")

    def totals(self, unit: str) -> DataFrame:
        """Per bucket of time: lines, items, revenue (decimal) and about how many customers."""
        at = bucket(unit, F.col("day"))
        sums = _added(self.store.read("product_days").withColumn(unit, at), unit)
        customers = self.store.read("customer_days").groupBy(at.alias("_at")).agg(
            F.hll_sketch_estimate(F.hll_union_agg("customers")).alias("approx_customers"))
        return sums.join(customers, F.col(unit).eqNullSafe(F.col("_at"))).select(
            unit, "order_count", F.col("quantity_sold").alias("items_sold"), "revenue", "approx_customers")


def _added(partials: DataFrame, *keys: str) -> DataFrame:
    sums = partials.groupBy(*keys).agg(*[F.sum(name).alias(name) for name in _SUMS])
    return sums.withColumn("revenue", F.col("revenue").cast(_REVENUE))


def product_sales(shop: Shop, rolled: SalesRollUp, unit: str) -> DataFrame:
    """Sales by product of a bucket of time, from the roll-up, with today's names."""
    named = with_names(shop, rolled.products(unit)).select(unit, "product_name", "product_id", *_SUMS)
    return money_columns(named, "revenue").orderBy(unit, F.desc("revenue"), "product_id")


def category_sales(shop: Shop, rolled: SalesRollUp, unit: str) -> DataFrame:
    """Sales by category name of a bucket of time, from the roll-up."""
    summed = with_names(shop, rolled.products(unit), category=True).groupBy(unit, "category_name").agg(
        F.sum("order_count").alias("order_count"), F.sum("quantity_sold").alias("items_sold"), F.sum("revenue").alias("revenue"))
    return money_columns(summed, "revenue").orderBy(unit, F.desc("revenue"), "category_name")
