"""Row rules: split rows into valid ones and rejects with reasons."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlake.functions import trimmed


class Rule(NamedTuple):
    """A message and the condition under which a row earns it."""

    message: str
    fails: Column


def not_empty(column: str, message: str) -> Rule:
    return Rule(message, trimmed(F.col(column)) == "")


def with_errors(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Each row with its failures in ``errors``. A null condition is a failure."""
    marks = F.array(*[F.when(F.coalesce(rule.fails, F.lit(True)), F.lit(rule.message)) for rule in rules])
    return df.withColumn("errors", F.array_compact(marks))


def validate(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejects with all their failures in ``errors``."""
    checked = with_errors(df, rules)
    valid = checked.filter(F.size("errors") == 0).drop("errors")
    return valid, checked.filter(F.size("errors") > 0)


def reject_split(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Rows without a reason, and rejects with it in ``reason``."""
    checked = df.withColumn("reason", reason)
    accepted = checked.filter(F.col("reason").isNull()).drop("reason")
    return accepted, checked.filter(F.col("reason").isNotNull())
