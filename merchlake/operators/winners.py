"""Which request of a batch counts, by aggregation instead of a window.

A window would gather all requests for one key in one task. ``min`` and ``max_by`` combine on the
map side first, so a key that holds a large part of the batch sends one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_request(requests: DataFrame, *key: str, request_id: str = "request_id") -> DataFrame:
    """The requests that come first for their key."""
    winners = requests.groupBy(*key).agg(F.min(request_id).alias("_first")).select("_first")
    return requests.join(winners, F.col(request_id) == F.col("_first"), "left_semi")


def last_given(value: Column, order: Column, given: Column | None = None) -> Column:
    """Aggregate: the value of the latest row in which it was given."""
    present = value.isNotNull() if given is None else given
    return F.max_by(value, F.when(present, order))
