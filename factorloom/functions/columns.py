from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_start(date: Column) -> Column:
    return F.trunc(date.cast("date"), "MM")


def july_first(year: Column) -> Column:
    return F.make_date(year, F.lit(7), F.lit(1))


def governing_july(date: Column) -> Column:
    """July 1 of the sort that governs a return month (July to next June)."""
    return july_first(F.year(F.add_months(date, -6)))


def clean_double(value: Column) -> Column:
    """Double with NaN as null and -0.0 as 0.0, so that ties compare equal."""
    value = value.cast("double")
    return F.when(F.isnan(value), None).when(value == 0, 0.0).otherwise(value)


def in_universe(exchange: Column, exchanges: Sequence[str] | None) -> Column:
    if exchanges is None:
        return F.lit(True)
    return F.coalesce(exchange.isin(*exchanges), F.lit(False))


def value_weighted(ret: Column, weight: Column) -> Column:
    """Aggregate: a missing return adds nothing above but keeps its weight below."""
    return F.try_divide(F.coalesce(F.sum(ret * weight), F.lit(0.0)), F.sum(weight))


def equal_weighted(ret: Column) -> Column:
    return F.avg(ret)


def inner_breaks(quantiles: Column) -> Column:
    """Breaks for right-closed bins from the inner quantiles 1/n .. (n-1)/n."""
    return F.array_sort(F.array_distinct(quantiles))


def interior_breaks(quantiles: Column) -> Column:
    """Breaks for left-closed bins from the quantiles 0 .. 1 of a universe.

    Equal quantiles collapse, then the lowest and highest are dropped: the outer
    bins are open-ended.  Null when the universe has fewer than two values.
    """
    distinct = F.array_sort(F.array_distinct(quantiles))
    return F.when(
        F.size(distinct) >= 2,
        F.slice(distinct, F.lit(2), F.greatest(F.size(distinct) - 2, F.lit(0))),
    )
