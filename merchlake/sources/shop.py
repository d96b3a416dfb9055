"""The shop's tables as one object."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from merchlake.schemas import SCHEMAS
from merchlake.sources.tables import conform, load


class Shop:
    """Logical tables by attribute (``shop.products``); each frame is built when first used."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]):
        self._makers = dict(makers)
        self._frames: dict[str, DataFrame] = {}

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Shop:
        return cls({table: partial(load, spark, folder, table) for table in SCHEMAS})

    @classmethod
    def of(cls, **frames: DataFrame) -> Shop:
        """From frames at hand, conformed to the declared columns."""
        return cls({table: partial(conform, df, table) for table, df in frames.items()})

    def replace(self, **frames: DataFrame) -> Shop:
        """The same shop with some tables in a new state."""
        return Shop({**self._makers, **{name: partial(lambda df: df, df) for name, df in frames.items()}})

    def __getattr__(self, table: str) -> DataFrame:
        if table.startswith("_") or table not in self._makers:
            raise AttributeError(table)
        if table not in self._frames:
            self._frames[table] = self._makers[table]()
        return self._frames[table]

    def key_type(self, table: str, column: str) -> str:
        return getattr(self, table).schema[column].dataType.simpleString()
