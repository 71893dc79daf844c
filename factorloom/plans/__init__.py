"""Whole analyses composed from the operators."""

from .comparison import compare_designs, design_premiums, premium_comparison
from .grid import (
    GridAxes,
    Sample,
    default_samples,
    grid_series,
    run_grid,
    spec_coverage,
    spec_grid,
    value_premium,
)
from .report import estimate_histogram, grid_summary, reference_lines
from .study import Study, run_study

__all__ = [
    "GridAxes",
    "Sample",
    "Study",
    "default_samples",
    "compare_designs",
    "design_premiums",
    "estimate_histogram",
    "grid_series",
    "grid_summary",
    "premium_comparison",
    "reference_lines",
    "run_grid",
    "run_study",
    "spec_coverage",
    "spec_grid",
    "value_premium",
]
