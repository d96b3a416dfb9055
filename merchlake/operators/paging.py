"""Pages of a sorted list.

Spark runs ``orderBy().limit()`` as a top-k per partition, so only k rows per task are shuffled.
Reports cut the page first and join the wide columns to the few rows that are left.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchlake.operators.bounded import written_once

# The depth up to which a page is the end of a top-k list; deeper ones are found through counts.
DIRECT_RANKS = 1000


def first_rows(df: DataFrame, order: Sequence[Column], page_no: int, size: int) -> DataFrame:
    """The rows up to the end of a page: enough to build it once joins have added to them."""
    return df.orderBy(*order).limit(page_no * size)


def page(df: DataFrame, order: Sequence[Column], page_no: int = 1, size: int = 10) -> DataFrame:
    """One page. The order must end in a key, or equal rows may change places between pages."""
    return df.orderBy(*order).offset((page_no - 1) * size).limit(size)


def page_after(df: DataFrame, sort: str, key: str, last: tuple | None, size: int = 10) -> DataFrame:
    """The page after a given row in descending order of ``sort``, ascending ``key``.

    Unlike an offset, this does not read the earlier pages again: the condition reaches the scan.
    """
    if last is not None:
        at, last_key = F.lit(last[0]), F.lit(last[1])
        df = df.filter((F.col(sort) <= at) & ((F.col(sort) < at) | (F.col(key) > last_key)))
    return df.orderBy(F.col(sort).desc_nulls_last(), F.col(key)).limit(size)


def page_per(df: DataFrame, owner: str, order: Sequence[Column], page_no: int = 1, size: int = 10) -> DataFrame:
    """The same page of every owner's list.

    The bound on the row number lets Spark cut each task's input to the first rows per owner
    before the shuffle, so an owner of very many rows still sends only a few per task.
    """
    rank = F.row_number().over(Window.partitionBy(owner).orderBy(*order))
    last = page_no * size
    numbered = df.withColumn("_rank", rank).filter(F.col("_rank") <= last)
    return numbered.filter(F.col("_rank") > last - size).drop("_rank")


def deep_page(
    rows: DataFrame, at: str, key: str, page_no: int = 1, size: int = 10, owner: str | None = None
) -> DataFrame:
    """A page at any depth in descending order of the time ``at`` (nulls last) and ascending ``key``;
    with an owner, that page of every owner's list. A page behind the end is empty.

    Counts per day tell on which days the page lies and how many rows come before them. Only the sort
    columns of these days are then put in order, in ranges that may be cut anywhere, so a day, a time or
    an owner with very many rows is shared out among tasks; counts per range tell which ranges hold the
    page. Without an owner the days reach the scan as a filter. ``key`` must be unique.
    """
    if page_no < 1 or size < 1:
        raise ValueError("pages are numbered from 1 and hold at least one row")
    first, last = (page_no - 1) * size, page_no * size
    owners = [] if owner is None else [owner]
    # One row per day (and owner): the calendar bounds how many rows a list has here.
    day = F.col(at).cast("date")
    days = rows.groupBy(*owners, day.alias("_day")).agg(F.count("*").alias("_n"))
    days = _with_earlier(days, owners, F.col("_day").desc_nulls_last())
    days = days.filter((F.col("_earlier") < last) & (F.col("_earlier") + F.col("_n") > first))
    if owner is None:
        rows, skipped = _on_days(rows, at, days)
        keys = rows.select(at, key, F.lit(skipped).cast("long").alias("_skipped"))
    else:
        asked = days.select(F.col(owner).alias("_owner"), F.col("_day").alias("_asked"), F.min("_earlier").over(
            Window.partitionBy(owner)).alias("_skipped"))
        on = F.col(owner).eqNullSafe(F.col("_owner")) & day.eqNullSafe(F.col("_asked"))
        keys = rows.join(asked, on).select(owner, at, key, "_skipped")

    order = [F.col(at).desc_nulls_last(), F.col(key)]
    ranged = keys.repartitionByRange(*[F.col(name) for name in owners], *order)
    ordered = written_once(ranged.withColumn("_range", F.spark_partition_id()), "page-ranges")
    ranges = _with_earlier(ordered.groupBy(*owners, "_range").agg(F.count("*").alias("_n")), owners, F.col("_range"))
    begun = ranges.select(*[F.col(name).alias("_owner") for name in owners], F.col("_range").alias("_part"), "_earlier", "_n")
    same = F.col("_range") == F.col("_part")
    if owner is not None:
        same = same & F.col(owner).eqNullSafe(F.col("_owner"))
    before = F.col("_skipped") + F.col("_earlier")
    held = ordered.join(begun, same).filter((before < last) & (before + F.col("_n") > first))
    place = F.row_number().over(Window.partitionBy(*owners, "_range").orderBy(*order))
    shown = held.withColumn("_rank", before + place).filter(F.col("_rank").between(first + 1, last))
    return rows.join(shown.select(F.col(key).alias("_shown")), F.col(key) == F.col("_shown"), "left_semi")


def _on_days(rows: DataFrame, at: str, days: DataFrame) -> tuple[DataFrame, int | None]:
    """The rows of neighbouring days, and how many come before them. Only four figures are read here."""
    ends = days.agg(
        F.min("_day").alias("low"), F.max("_day").alias("high"), F.min("_earlier").alias("skipped"),
        F.count_if(F.col("_day").isNull()).alias("undated"),
    ).first()
    keep = F.col(at).isNull() if ends.undated else F.lit(False)
    if ends.low is not None:
        after = ends.high + dt.timedelta(days=1)
        keep = keep | ((F.col(at) >= F.lit(ends.low).cast("timestamp")) & (F.col(at) < F.lit(after).cast("timestamp")))
    return rows.filter(keep), ends.skipped


def _with_earlier(counts: DataFrame, owners: list[str], order: Column) -> DataFrame:
    """Counts with the sum of those that stand before them in their owner's list."""
    before = Window.partitionBy(*owners).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_earlier", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")))


def envelope(
    counts: DataFrame, page_no: int = 1, size: int = 10, with_neighbours: bool | Column = True
) -> DataFrame:
    """Page arithmetic for rows of ``(entity, total_items)``."""
    total = F.col("total_items")
    pages = F.ceil(total / F.lit(size)).cast("long")
    shown = with_neighbours if isinstance(with_neighbours, Column) else F.lit(with_neighbours)
    return counts.select(
        "entity",
        "total_items",
        pages.alias("total_pages"),
        F.lit(page_no).alias("current_page"),
        F.lit(size).alias("items_per_page"),
        F.when(shown, F.lit(page_no) < pages).alias("has_next_page"),
        F.when(shown, F.lit(page_no) > 1).alias("has_prev_page"),
    )
