"""Blog changes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchlake.functions import stable_id, trimmed
from merchlake.operators import validate
from merchlake.plans.changes.outcome import Outcome, rejected
from merchlake.plans.quality import blog_rules
from merchlake.sources.shop import Shop
from merchlake.sources.snapshots import with_defaults


def create_blogs(shop: Shop, requests: DataFrame, as_of: dt.datetime | None = None) -> Outcome:
    """New blogs, always active; blanks at the ends of their texts are cut off."""
    valid, invalid = validate(requests, blog_rules())
    texts = {name: trimmed(F.col(name)) for name in ("title", "cover_image", "text_content")}
    rows = valid.withColumns(texts).withColumn("status", F.lit(True))
    row_id = stable_id(F.lit("blog"), F.col("request_id"), key_type=shop.key_type("blogs", "id"))
    created = with_defaults(rows, "blogs", row_id, as_of)
    return Outcome(
        {"blogs": shop.blogs.unionByName(created)}, rejected(invalid, F.array_join("errors", "; ")), created
    )


def toggle_blogs(shop: Shop, requests: DataFrame) -> Outcome:
    """Flip the status of blogs once per request: an even number of requests changes nothing."""
    flips = requests.groupBy(F.col("blog_id").alias("_blog")).agg(F.count("*").alias("_n"))
    odd = F.coalesce(F.col("_n"), F.lit(0)) % 2 == 1
    state = shop.blogs.join(flips, F.col("id") == F.col("_blog"), "left").withColumn(
        "status", F.when(odd, ~F.col("status")).otherwise(F.col("status"))
    ).select(shop.blogs.columns)
    known = shop.blogs.select(F.col("id").alias("_known"))
    unknown = requests.join(known, F.col("blog_id") == F.col("_known"), "left_anti")
    toggled = state.join(flips.select("_blog"), F.col("id") == F.col("_blog"), "left_semi")
    return Outcome({"blogs": state}, rejected(unknown, "blog not found"), toggled)
