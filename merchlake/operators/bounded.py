"""Short lists that several parts of one query read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchlake.session import work_folder


def computed_once(short: DataFrame) -> DataFrame:
    """The rows of a page or top-k list, computed once however often the query reads them.

    The list becomes a scalar subquery, which Spark evaluates once per query. Only for frames
    whose row count is fixed by a limit: the whole list is held in one value.
    """
    row = F.struct(F.lit(True).alias("_row"), *short.columns)
    rows = short.agg(F.collect_list(row).alias("rows")).scalar()
    # The outer form, as the plain one makes Spark add conditions on two more copies of the list.
    listed = short.sparkSession.range(1).select(rows.alias("rows")).select(F.inline_outer("rows"))
    return listed.filter(F.col("_row").isNotNull()).drop("_row")


def written_once(rows: DataFrame, purpose: str) -> DataFrame:
    """The rows, written to the shared folder and read back: for lists of given keys, which no limit bounds.

    They stay a table of any length, and the size of its files tells Spark what may be broadcast.
    """
    path = work_folder(rows.sparkSession, purpose)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def asked_for(short: DataFrame, key: str, wide: DataFrame, wide_key: str) -> DataFrame:
    """The rows of a large table that a short list asks for: scanned, but neither shuffled nor sorted."""
    keys = short.select(F.col(key).alias("_wanted")).distinct()
    return wide.join(keys, F.col(wide_key) == F.col("_wanted"), "left_semi")


def look_up(short: DataFrame, wide: DataFrame, key: str, wide_key: str, keys: DataFrame | None = None) -> DataFrame:
    """Left join of a short list with a large table, reading only the rows the list asks for.

    The large side is first cut down by a semi join with the list's keys, so it is scanned but
    neither shuffled nor sorted. ``wide`` must not share column names with ``short``. When several
    tables are looked up in turn, ``keys`` is the list as it was before the first.
    """
    keys = (short if keys is None else keys).select(F.col(key).alias("_wanted")).distinct()
    found = wide.join(keys, F.col(wide_key) == F.col("_wanted"), "left_semi")
    return short.join(found, F.col(key) == F.col(wide_key), "left")
