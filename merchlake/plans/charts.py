"""Chart series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchlake.functions import bucket, month_label, since, week_label
from merchlake.operators import as_document, computed_once, rows_as_list
from merchlake.plans.facts import money_columns, paid_lines, sold_per_product
from merchlake.plans.sales import Day
from merchlake.sources.shop import Shop


def chart_monthly(shop: Shop, as_of: Day | None = None, months: int = 6) -> DataFrame:
    """Lines and revenue of the last months, in month order."""
    recent = paid_lines(shop).filter(since(F.col("created_at"), as_of, months=months))
    per_month = recent.groupBy(bucket("month", F.col("created_at")).alias("month_date")).agg(
        F.count("*").alias("order_count"), F.sum("amount").alias("revenue")
    )
    labelled = per_month.select(month_label(F.col("month_date")).alias("month"), "month_date", "order_count", "revenue")
    return money_columns(labelled, "revenue").orderBy("month_date")


def chart_product_performance(shop: Shop, as_of: Day | None = None, weeks: int = 4, k: int = 3) -> DataFrame:
    """Weekly quantities of the best-selling product names, zero in weeks without a sale.

    Names are ranked by their quantity over the whole period, equal ones by name. The days of one
    calendar week that crosses New Year carry two week numbers, as the label counts from 1 January.
    """
    recent = paid_lines(shop).filter(since(F.col("created_at"), as_of, weeks=weeks))
    day = F.col("created_at").cast("date")
    sold = recent.groupBy(
        "product_id", bucket("week", day).alias("week_date"), week_label(day).alias("week_number")
    ).agg(F.sum("quantity").alias("units"))
    names = shop.products.select(F.col("id").alias("_product"), F.col("name").alias("product_name"))
    weekly = (
        sold.join(names, F.col("product_id") == F.col("_product"))
        .groupBy("product_name", "week_date", "week_number")
        .agg(F.sum("units").alias("units"))
    )
    top = computed_once(
        weekly.groupBy("product_name").agg(F.sum("units").alias("total"))
        .orderBy(F.desc("total"), "product_name").limit(k).select("product_name")
    )
    # At most weeks + 2 distinct pairs, so they fit one value beside each of the k names.
    shown_weeks = weekly.agg(F.collect_set(F.struct("week_date", "week_number")).alias("weeks")).scalar()
    grid = top.select("product_name", shown_weeks.alias("weeks")).select("product_name", F.inline("weeks"))
    series = weekly.join(top.withColumnRenamed("product_name", "_top"), F.col("product_name") == F.col("_top"), "left_semi")
    filled = grid.join(series, ["product_name", "week_date", "week_number"], "left")
    return filled.select(
        "product_name", "week_date", "week_number",
        F.coalesce("units", F.lit(0).cast("long")).alias("quantity_sold"),
    ).orderBy("product_name", "week_date", "week_number")


def chart_category_share(shop: Shop) -> DataFrame:
    """Revenue of each category name and its percentage of all revenue."""
    sold = sold_per_product(paid_lines(shop)).select("sold_product_id", "revenue")
    products = shop.products.select(F.col("id").alias("_product"), "category_id")
    names = shop.categories.select(F.col("id").alias("_category"), F.col("name").alias("category_name"))
    per_category = (
        sold.join(products, F.col("sold_product_id") == F.col("_product"))
        .join(names, F.col("category_id") == F.col("_category"))
        .groupBy("category_name")
        .agg(F.sum("revenue").alias("total_revenue"))
    )
    # The total is a scalar subquery over the same grouping, so no window gathers the categories.
    total = per_category.agg(F.sum("total_revenue").alias("total")).scalar()
    share = F.round(F.col("total_revenue").cast("double") * 100 / total.cast("double"), 2)
    shares = per_category.withColumn("percentage", share)
    return money_columns(shares, "total_revenue").orderBy(F.desc("total_revenue"), "category_name")


def charts_document(shop: Shop, as_of: Day | None = None) -> DataFrame:
    """The three charts as one JSON document of labels and data series."""
    months = chart_monthly(shop, as_of)
    month_rows = rows_as_list(months, F.col("month_date"))
    weekly_rows = rows_as_list(chart_product_performance(shop, as_of), F.col("product_name"), F.col("week_date"))
    shares = rows_as_list(chart_category_share(shop), -F.col("total_revenue"), F.col("category_name"))
    rows = shop.products.sparkSession.range(1).select(
        month_rows.alias("months"), weekly_rows.alias("weekly"), shares.alias("shares")
    )

    def series(label: str, column: str) -> F.Column:
        return F.struct(F.lit(label).alias("label"), F.col(f"months.{column}").alias("data"))

    names = F.array_distinct(F.col("weekly.product_name"))
    week_labels = F.array_distinct(
        F.transform(F.array_sort(F.col("weekly")), lambda row: F.concat(F.lit("Week "), row["week_number"]))
    )
    datasets = F.transform(names, lambda name: F.struct(
        name.alias("label"),
        F.transform(
            F.filter(F.col("weekly"), lambda row: row["product_name"] == name), lambda row: row["quantity_sold"]
        ).alias("data"),
    ))
    return rows.select(as_document(
        monthlySales=F.struct(
            F.col("months.month").alias("labels"),
            F.array(series("Revenue", "revenue"), F.struct(
                F.lit("Orders").alias("label"), F.col("months.order_count").cast("array<double>").alias("data")
            )).alias("datasets"),
        ),
        productPerformance=F.struct(week_labels.alias("labels"), datasets.alias("datasets")),
        categoryDistribution=F.struct(
            F.col("shares.category_name").alias("labels"), F.col("shares.percentage").alias("data")
        ),
    ).alias("document"))
