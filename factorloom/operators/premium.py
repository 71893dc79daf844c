"""Long-short spreads and their averages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def size_neutral(
    returns: DataFrame, by: Sequence[str] = ("date",), portfolio: str = "portfolio_bm"
) -> DataFrame:
    """Equal average over the size portfolios present."""
    return returns.groupBy(*by, portfolio).agg(F.avg("ret").alias("ret"))


def high_minus_low(
    returns: DataFrame,
    portfolio: str = "portfolio",
    ret: str = "ret",
    by: Sequence[str] = ("date",),
) -> DataFrame:
    """Return of the highest portfolio present minus that of the lowest.

    Expects one row per group and portfolio.  A missing return at an end makes
    the spread null; one single portfolio makes it zero.
    """
    spread = F.max_by(ret, portfolio) - F.min_by(ret, portfolio)
    return returns.groupBy(*by).agg(
        spread.alias("value_premium"),
        F.count(portfolio).alias("n_portfolios_present"),
    )


def mean_premium(premium: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return premium.groupBy(*by).agg(F.avg("value_premium").alias("value_premium"))


def flag_significant(results: DataFrame, critical: float = 1.96) -> DataFrame:
    return results.withColumn("is_significant", F.abs("t_stat") >= critical)
