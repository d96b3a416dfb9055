"""Money is decimal inside, so sums do not depend on row order; double only at the edge."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from merchlake.schemas import MONEY


def money(value: Column) -> Column:
    return value.cast(MONEY)


def as_double(value: Column) -> Column:
    return value.cast("double")


def line_total(price: Column, quantity: Column) -> Column:
    return (money(price) * quantity.cast("decimal(12,0)")).cast("decimal(30,2)")


def to_minor(value: Column) -> Column:
    """Currency units to sub-units, e.g. 12.34 -> 1234."""
    return (value * F.lit(100)).cast("long")


def from_minor(value: Column) -> Column:
    return (value.cast("decimal(20,0)") / F.lit(100)).cast(MONEY)


def mean(total: Column, count: Column) -> Column:
    """Mean of a decimal total; null when nothing was counted."""
    return F.when(count > 0, total.cast("double") / count)


def exact_mean(total: Column, count: Column) -> Column:
    """Mean of a decimal total as a decimal of twelve places; null when nothing was counted."""
    quotient = total.cast("decimal(38,12)") / F.nullif(count, F.lit(0)).cast("decimal(18,0)")
    return quotient.cast("decimal(38,12)")
