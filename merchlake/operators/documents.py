"""Results as one row or one JSON document.

A document holds whole lists in one value, so it is only for lists of bounded length (a top-k, a
summary, the months of a chart). Long results stay rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_row(*frames: DataFrame) -> DataFrame:
    """The columns of several one-row frames side by side."""
    stacked = reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(name).alias(name) for name in stacked.columns])


def rows_as_list(df: DataFrame, *order: Column) -> Column:
    """Scalar subquery: the rows of a bounded frame as an array of structs.

    The rows stand in ascending order of the given columns; negate a number to descend.
    """
    keyed = F.struct(
        *[column.alias(f"key{n}") for n, column in enumerate(order)], F.struct(*df.columns).alias("row")
    )
    return df.agg(F.transform(F.sort_array(F.collect_list(keyed)), lambda item: item["row"]).alias("rows")).scalar()


def as_document(**parts: Column) -> Column:
    """JSON text of the parts; fields that are null are kept."""
    return F.to_json(F.struct(*[part.alias(name) for name, part in parts.items()]), {"ignoreNullFields": "false"})
