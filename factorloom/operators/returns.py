"""Portfolio returns from additive sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import equal_weighted, value_weighted

# sums that add up over finer groups: sum(r*w), sum(w), sum(r), count(r)
SUMS = ("sum_rw", "sum_w", "sum_r", "n_r")


def governed_returns(assigned: DataFrame, returns: DataFrame) -> DataFrame:
    """Stocks with the monthly returns that their sort governs.

    The join on stock and sort date moves each return once.
    """
    return assigned.join(returns, ["permno", "sorting_date"], "inner")


def cell_sums(
    assigned: DataFrame, returns: DataFrame, by: Sequence[str], extra: Sequence[Column] = ()
) -> DataFrame:
    """Sums of the governed returns per date and cell.

    They are combined before the shuffle, so a hot date or cell costs no more
    than one row per task, and they can be added up to coarser portfolios.
    """
    ret, weight = F.col("ret_excess"), F.col("mktcap_lag")
    return (
        governed_returns(assigned, returns)
        .groupBy("date", *by)
        .agg(
            F.sum(ret * weight).alias("sum_rw"),
            F.sum(weight).alias("sum_w"),
            F.sum(ret).alias("sum_r"),
            F.count(ret).alias("n_r"),
            *extra,
        )
    )


def returns_from_sums(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Value- and equal-weighted return per group: ``by..., ret_vw, ret_ew``."""
    total = cells.groupBy(*by).agg(*[F.sum(c).alias(c) for c in SUMS])
    # a missing return adds nothing to the numerator and keeps its weight
    numerator = F.coalesce(F.col("sum_rw"), F.lit(0.0))
    return total.select(
        *by,
        F.try_divide(numerator, F.col("sum_w")).alias("ret_vw"),
        F.try_divide("sum_r", "n_r").alias("ret_ew"),
    )


def stack_weightings(returns: DataFrame) -> DataFrame:
    """Turn ``ret_vw`` and ``ret_ew`` into rows of ``weighting`` and ``ret``."""
    keys = [c for c in returns.columns if c not in ("ret_vw", "ret_ew")]
    choices = [
        F.struct(F.lit(name).alias("weighting"), F.col(column).alias("ret"))
        for name, column in (("value", "ret_vw"), ("equal", "ret_ew"))
    ]
    return returns.select(*keys, F.inline(F.array(*choices)))


def portfolio_returns(
    assigned: DataFrame,
    returns: DataFrame,
    by: Sequence[str] = ("portfolio",),
    weight: str = "value",
) -> DataFrame:
    """Monthly return per date and portfolio.

    ``weight`` is "value", "equal" or "both"; "both" adds a ``weighting`` column.
    """
    if weight not in ("value", "equal", "both"):
        raise ValueError(f"weight must be 'value', 'equal' or 'both', not {weight!r}")
    weighted = value_weighted(F.col("ret_excess"), F.col("mktcap_lag"))
    plain = equal_weighted(F.col("ret_excess"))
    by_portfolio = governed_returns(assigned, returns).groupBy("date", *by)
    if weight == "both":
        return stack_weightings(by_portfolio.agg(weighted.alias("ret_vw"), plain.alias("ret_ew")))
    return by_portfolio.agg((weighted if weight == "value" else plain).alias("ret"))
