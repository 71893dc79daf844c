"""DataFrame-to-DataFrame operators."""

from .cross_section import breakpoints, count_below, join_on, quantiles, stacked
from .inference import capm_alpha, gap_check, newey_west_mean
from .portfolios import (
    assign_quantile,
    conditional_sort,
    double_sort,
    unassigned_counts,
    univariate_sort,
)
from .premium import flag_significant, high_minus_low, mean_premium, size_neutral
from .returns import cell_sums, portfolio_returns, returns_from_sums
from .timing import (
    book_to_market,
    december_equity,
    dedupe_cross_section,
    june_size,
    latest_fundamentals,
    return_periods,
    sorting_variables,
)

__all__ = [
    "assign_quantile",
    "book_to_market",
    "breakpoints",
    "capm_alpha",
    "cell_sums",
    "conditional_sort",
    "count_below",
    "december_equity",
    "dedupe_cross_section",
    "double_sort",
    "flag_significant",
    "gap_check",
    "high_minus_low",
    "join_on",
    "june_size",
    "latest_fundamentals",
    "mean_premium",
    "newey_west_mean",
    "portfolio_returns",
    "quantiles",
    "return_periods",
    "returns_from_sums",
    "size_neutral",
    "sorting_variables",
    "stacked",
    "unassigned_counts",
    "univariate_sort",
]
