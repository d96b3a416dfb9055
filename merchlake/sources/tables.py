"""Reading declared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merchlake.schemas import DEFAULTS, REQUIRED, SCHEMAS


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One declared table, stored as parquet in ``folder/table``."""
    return conform(spark.read.parquet(f"{folder}/{table}"), table)


def _fits(found: T.DataType, declared: T.DataType) -> bool:
    """Whether a stored type can stand for the declared one: keys are text or whole numbers, numbers of any width."""
    if isinstance(found, T.NullType) or type(found) is type(declared):
        return True
    if isinstance(declared, T.StringType):
        return isinstance(found, (T.IntegralType, T.CharType, T.VarcharType))
    if isinstance(declared, T.NumericType):
        return isinstance(found, T.NumericType)
    return isinstance(declared, T.TimestampType) and isinstance(found, (T.TimestampNTZType, T.DateType))


def conform(df: DataFrame, table: str) -> DataFrame:
    """Bring a frame to the declared columns of a table.

    Columns that are absent are added with the table's default. A file without one of the
    required columns, or with a column of another kind than declared (a text price, say), is refused
    by name. Present columns keep their values and key types, so no join has to cast a key; only
    zone-less timestamps are read as session-zone timestamps.
    """
    present = set(df.columns)
    lost = [name for name in REQUIRED[table] if name not in present]
    if lost:
        raise ValueError(f"table {table} lacks required columns: {', '.join(lost)}")
    wrong = [
        f"{field.name} is {df.schema[field.name].dataType.simpleString()}, not {field.dataType.simpleString()}"
        for field in SCHEMAS[table].fields if field.name in present and not _fits(df.schema[field.name].dataType, field.dataType)
    ]
    if wrong:
        raise ValueError(f"table {table} has columns of another kind: {', '.join(wrong)}")
    defaults = DEFAULTS.get(table, {})
    columns = []
    for field in SCHEMAS[table].fields:
        if field.name not in present:
            column = F.lit(defaults.get(field.name)).cast(field.dataType)
        elif isinstance(df.schema[field.name].dataType, T.TimestampNTZType):
            column = F.col(field.name).cast("timestamp")
        else:
            column = F.col(field.name)
        columns.append(column.alias(field.name))
    return df.select(columns)
