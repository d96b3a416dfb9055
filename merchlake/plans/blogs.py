"""Blog lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchlake.functions import timestamp_text
from merchlake.operators import page
from merchlake.plans.facts import newest_first, oldest_first
from merchlake.sources.shop import Shop


def _shape(blogs: DataFrame) -> DataFrame:
    return blogs.select(
        F.col("id").alias("blog_id"), F.col("title").alias("blog_title"), "status", "cover_image", "text_content",
        timestamp_text(F.col("created_at")).alias("created_at"),
        timestamp_text(F.col("updated_at")).alias("updated_at"),
    )


def blogs_page(shop: Shop, page_no: int = 1, size: int = 10) -> DataFrame:
    """A page of blogs, oldest first."""
    return _shape(page(shop.blogs, oldest_first(), page_no, size))


def blogs_all(shop: Shop) -> DataFrame:
    """All blogs, newest first."""
    return _shape(shop.blogs.orderBy(*newest_first()))
