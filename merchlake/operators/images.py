"""Image arrays per product, always built apart from the facts so that no fact row is multiplied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlake.operators.bounded import computed_once


def image_lists(images: DataFrame, value: Column | None = None, *, distinct: bool = False) -> DataFrame:
    """Sorted array of the images of each product; nulls are left out."""
    collect = F.collect_set if distinct else F.collect_list
    element = F.col("image_url") if value is None else value
    return images.groupBy(F.col("product_id").alias("_product_id")).agg(
        F.sort_array(collect(element)).alias("images")
    )


def attach_images(
    df: DataFrame,
    images: DataFrame,
    key: str = "id",
    value: Column | None = None,
    *,
    distinct: bool = False,
    few: bool = False,
) -> DataFrame:
    """Add the column ``images``; a product without images gets an empty array.

    With ``few``, ``df`` is a page or a top-k list: only its products' images are collected, and
    the image table is filtered by that short list instead of being shuffled as a whole.
    """
    if few:
        df = computed_once(df)
        wanted = df.select(F.col(key).alias("_wanted")).distinct()
        images = images.join(wanted, F.col("product_id") == F.col("_wanted"), "left_semi")
    lists = image_lists(images, value, distinct=distinct)
    joined = df.join(lists, F.col(key) == F.col("_product_id"), "left").drop("_product_id")
    empty = F.array().cast(lists.schema["images"].dataType)
    return joined.withColumn("images", F.coalesce("images", empty))
