"""Small column helpers shared by several operators."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(value: Column, precision: int, scale: int = 2) -> Column:
    """Cast to a fixed-point type; Spark rounds half away from zero."""
    return value.cast(f"decimal({precision},{scale})")


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def nullif_zero(value: Column) -> Column:
    return F.when(value != 0, value)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields NULL on a zero denominator (ANSI division would raise)."""
    return numerator / nullif_zero(denominator)


def any_of(conditions: Iterable[Column]) -> Column:
    result = None
    for condition in conditions:
        result = condition if result is None else result | condition
    return result


def all_of(conditions: Iterable[Column]) -> Column:
    result = None
    for condition in conditions:
        result = condition if result is None else result & condition
    return result


def whole_months(start: Column, end: Column) -> Column:
    """Complete calendar months between two dates.

    The day of month decides whether the last month counts (Jan 31 to Feb 29 is 0), unlike
    ``months_between`` which treats two month ends as a whole month apart.
    """
    span = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    short = (end >= start) & (F.day(end) < F.day(start))
    over = (end < start) & (F.day(end) > F.day(start))
    return span - short.cast("int") + over.cast("int")


def lookup(value: Column, table: Mapping[str, object], default: object) -> Column:
    """Translate a value through a small literal table."""
    pairs = [F.lit(item) for pair in table.items() for item in pair]
    return F.coalesce(F.create_map(*pairs)[value], F.lit(default))


def position(value: Column, order: Iterable[str]) -> Column:
    """1-based position in a fixed order, NULL for values outside it."""
    place = F.array_position(F.array(*[F.lit(v) for v in order]), value)
    return F.when(place > 0, place)


def month_start(value: Column) -> Column:
    return F.trunc(value, "month")
