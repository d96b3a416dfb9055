from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlake.sources.shop import Shop


class Outcome(NamedTuple):
    """What a flow returns: new table states by name, rejected requests, and the written rows."""

    state: dict[str, DataFrame]
    rejects: DataFrame
    changed: DataFrame | None = None

    def changes(self, shop: Shop, table: str, key: str = "id") -> DataFrame:
        """What the flow did to a table of the shop, row by row."""
        return row_changes(getattr(shop, table), self.state[table], key)


def row_changes(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``(operation, key, before, after)`` that lead from one state of a table to another.

    The operation is ``insert``, ``update`` or ``delete``; ``before`` and ``after`` are whole rows, null where there
    is none. Columns are compared null-safely, those that only one state has count as null in the other. ``key`` must be
    unique in each state; a null key is a key like any other. Both states are shuffled by the key, once.
    """
    names = [*old.columns, *(name for name in new.columns if name not in old.columns)]
    kinds = {**dict(new.dtypes), **dict(old.dtypes)}

    def side(state: DataFrame, mark: str, row: str) -> DataFrame:
        fields = [(F.col(name) if name in state.columns else F.lit(None)).cast(kinds[name]).alias(name) for name in names]
        return state.select(F.col(key).alias(mark), F.struct(*fields).alias(row))

    before, after = F.col("before"), F.col("after")
    met = side(old, "_old", "before").join(side(new, "_new", "after"), F.col("_old").eqNullSafe(F.col("_new")), "full_outer")
    operation = F.when(before.isNull(), "insert").when(after.isNull(), "delete").otherwise("update")
    return met.filter(~before.eqNullSafe(after)).select(
        operation.alias("operation"), F.coalesce("_new", "_old").alias("key"), before, after)


def per_request(requests: DataFrame, key: str, known: DataFrame, message: str) -> DataFrame:
    """A reject for every request that finds nothing: an unknown key, or one that an earlier request removed.

    ``known`` has the keys that exist, in ``_known``. Of the requests for such a key the first is served.
    """
    first = requests.groupBy(F.col(key).alias("_key")).agg(F.min("request_id").alias("_first"))
    served = first.join(known, F.col("_key") == F.col("_known"), "left_semi").select("_first")
    return rejected(requests.join(served, F.col("request_id") == F.col("_first"), "left_anti"), message)


def rejected(requests: DataFrame, message: str | Column) -> DataFrame:
    reason = F.lit(message) if isinstance(message, str) else message
    return requests.select("request_id", reason.alias("reason"))
