"""Writing: inserts with defaults, whole-table snapshots and publishing several tables at once.

Plain parquet has no row update. A change batch writes the new state of every table it touches
below its own batch id and publishes the id last, so readers see all of the batch or nothing of
it, and a repeated batch overwrites only its own files.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merchlake.schemas import DEFAULTS, SCHEMAS

_PUBLISHED = "published"


def with_defaults(
    df: DataFrame, table: str, row_id: Column | None = None, as_of: dt.datetime | Column | None = None
) -> DataFrame:
    """Rows ready for insert: absent or null columns get their default, timestamps the given time."""
    stamp = as_of if isinstance(as_of, Column) else F.lit(as_of) if as_of else F.current_timestamp()
    defaults = DEFAULTS.get(table, {})
    columns = []
    for field in SCHEMAS[table].fields:
        name = field.name
        if name == "id" and row_id is not None:
            column = row_id
        elif name in ("created_at", "updated_at"):
            column = F.coalesce(F.col(name), stamp) if name in df.columns else stamp
            column = column.cast(field.dataType)
        elif name in df.columns:
            column = F.col(name)
            if name in defaults:
                column = F.coalesce(column, F.lit(defaults[name]).cast(field.dataType))
        else:
            column = F.lit(defaults.get(name)).cast(field.dataType)
        columns.append(column.alias(name))
    return df.select(columns)


def write_snapshot(df: DataFrame, path: str) -> DataFrame:
    """Write a new table state to its own path and return it read back, free of its lineage."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def publish(base: str, batch_id: int, frames: dict[str, DataFrame]) -> None:
    """Write all tables of a batch, then make them visible in one step."""
    if not frames:
        raise ValueError("a batch must hold at least one table")
    for table, df in frames.items():
        df.write.mode("overwrite").parquet(f"{base}/batch={batch_id}/{table}")
    session = next(iter(frames.values())).sparkSession
    marks = session.range(1).select(F.lit(batch_id).cast("long").alias("batch_id"))
    marks.write.mode("append").parquet(f"{base}/{_PUBLISHED}")


def last_batch(spark: SparkSession, base: str) -> int | None:
    """The newest published batch id; None before the first batch."""
    try:
        marks = spark.read.schema("batch_id long").parquet(f"{base}/{_PUBLISHED}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return marks.agg(F.max("batch_id")).first()[0]


def published(spark: SparkSession, base: str, table: str) -> DataFrame | None:
    """The table as of the newest published batch."""
    batch_id = last_batch(spark, base)
    return None if batch_id is None else spark.read.parquet(f"{base}/batch={batch_id}/{table}")


def changed(new_state: DataFrame, since: dt.datetime) -> DataFrame:
    """The rows a batch wrote: those it stamped with its own time."""
    return new_state.filter(F.col("updated_at") >= F.lit(since))
