"""Portfolio sorts of annual cross-sections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import stage
from .cross_section import bin_number, breakpoints, double_breaks, join_on, nested_bin

SORT_DATE = ("sorting_date",)

# fixed values: the exchanges whose stocks set the breaks unless others are named
LISTED = ("NYSE", "NASDAQ", "AMEX")


def assign_quantile(
    df: DataFrame,
    value: str,
    n: int,
    by: Sequence[str] = SORT_DATE,
    universe: Sequence[str] | None = None,
    closed: str = "right",
    out: str = "portfolio",
) -> DataFrame:
    """Add the 1-based quantile bin of ``value`` within each group.

    The breaks are written first: the planner then knows their true size and
    sends them to every task only if they are small, and shuffles otherwise.
    """
    breaks = stage(breakpoints(df, value, n, by, universe, closed), "breaks")
    return bin_number(join_on(df, breaks, by, "left"), value, "breaks", out, n, closed).drop(
        "breaks"
    )


def double_sort(
    sv: DataFrame,
    n_size: int = 3,
    n_bm: int = 3,
    dependent: bool = False,
) -> DataFrame:
    """Add ``portfolio_me`` and ``portfolio_bm``; all stocks set the breaks, bins (a, b].

    With ``dependent`` the book-to-market breaks are those of the size portfolio.
    """
    return _double_sort(sv, n_size, n_bm, None, "right", dependent, "portfolio_bm")


def _double_sort(
    sv: DataFrame,
    n_size: int,
    n_bm: int,
    universe: Sequence[str] | None,
    closed: str,
    dependent: bool,
    out: str,
) -> DataFrame:
    """All breaks, written, then both bins from one read of the cross-sections."""
    breaks = double_breaks(
        sv, "me", "bm", n_size, n_bm, SORT_DATE, universe, closed, not dependent, dependent
    )
    found = join_on(sv, stage(breaks, "breaks"), SORT_DATE, "left")
    found = bin_number(found, "me", "first_breaks", "portfolio_me", n_size, closed)
    if dependent:
        found = nested_bin(found, "bm", "portfolio_me", out, n_bm, closed)
    else:
        found = bin_number(found, "bm", "second_breaks", out, n_bm, closed)
    return found.drop("first_breaks", "second_breaks", "nested")


def univariate_sort(
    sv: DataFrame,
    n: int = 5,
    universe: Sequence[str] | None = LISTED,
) -> DataFrame:
    """Add ``portfolio`` by book-to-market; the universe sets the breaks, bins [a, b)."""
    return assign_quantile(sv, "bm", n, universe=universe, closed="left")


def conditional_sort(
    sv: DataFrame,
    n: int = 5,
    universe: Sequence[str] | None = LISTED,
    n_size: int = 3,
    pool: bool = True,
) -> DataFrame:
    """Sort on size, then on book-to-market within size; bins [a, b).

    With ``pool`` the size portfolio is dropped, so that equal book-to-market
    portfolios of all sizes form one.
    """
    both = _double_sort(sv, n_size, n, universe, "left", True, "portfolio")
    return both.drop("portfolio_me") if pool else both


def unassigned_counts(
    assigned: DataFrame, by: Sequence[str] = SORT_DATE, portfolio: str = "portfolio"
) -> DataFrame:
    """Stocks per group, and how many have no portfolio.

    A stock has none without a value, or when its universe has fewer than two
    distinct values to set breaks.
    """
    return assigned.groupBy(*by).agg(
        F.count("*").alias("n_stocks"),
        F.count_if(F.col(portfolio).isNull()).alias("n_unassigned"),
    )
