"""The study from input tables to reports."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.returns import cell_sums
from ..operators.timing import (
    book_to_market,
    december_equity,
    june_size,
    latest_fundamentals,
    return_periods,
    sorting_variables,
    with_sort_date,
)
from ..sources import (
    by_calendar_month,
    load_factors,
    load_fundamentals,
    load_stock_panel,
    read_factors,
    tidy_factors,
    load_sorting_table,
    write_report,
    write_sorting_table,
    write_table,
)
from ..workspace import stage, stage_bucketed
from .comparison import DESIGN_CELL, compare_designs, design_cells, design_premiums, premiums_of_cells
from .grid import GridAxes, grid_cells, grid_tests, run_grid, series_of_cells
from .report import estimate_histogram, grid_summary, reference_lines


class Study:
    """Three input tables and the analyses over them.

    The sorting variables are written once on first use: one row per stock and
    year, read by every set of breaks and by every join with returns.

    With ``buckets``, the returns and the sorting variables are written in so many hash buckets of
    stock and sort date, on which they meet: the panel moves once, however many sorts follow.  A key
    holds a year of one stock at most, so no bucket is hot.  Worth it where the sorting variables are
    too large to be broadcast.
    """

    def __init__(
        self,
        panel: DataFrame,
        fundamentals: DataFrame,
        factors: DataFrame,
        buckets: int | None = None,
    ):
        self.panel = panel
        self.fundamentals = fundamentals
        self.factors = factors
        self.buckets = buckets

    def build_sorting_variables(self, years: Sequence[int] | None = None) -> DataFrame:
        """The cross-sections of all sort dates, or those of July of the given years.

        A year needs its June, the December before and the fiscal year-ends of the calendar year
        before, and nothing else of the inputs is kept.
        """
        panel, fundamentals = self.panel, self.fundamentals
        if years is not None:
            months = [d for y in years for d in (dt.date(y - 1, 12, 1), dt.date(y, 6, 1))]
            panel = panel.filter(F.col("date").isin(months))
            dates = [dt.date(y, 7, 1) for y in years]
            fundamentals = with_sort_date(fundamentals).filter(F.col("sorting_date").isin(dates))
        bm = book_to_market(latest_fundamentals(fundamentals), december_equity(panel))
        return sorting_variables(june_size(panel), bm)

    def write_sorting_table(self, path: str, years: Sequence[int] | None = None) -> None:
        """Keep the sorting variables by sort date below ``path``, and use them from there.

        Given years are built again and replace what is kept of them; the other dates stay.
        """
        dates = [dt.date(y, 7, 1) for y in years or ()]
        write_sorting_table(self.build_sorting_variables(years), path, dates)
        self.use_sorting_table(path)

    def use_sorting_table(self, path: str) -> None:
        """Read the sorting variables from a table that :meth:`write_sorting_table` has written."""
        self.sorting_variables = load_sorting_table(self.panel.sparkSession, path)
        self.__dict__.pop("premiums", None)

    def _kept(self, df: DataFrame, label: str) -> DataFrame:
        if self.buckets:
            return stage_bucketed(df, label, ["permno", "sorting_date"], self.buckets)
        return stage(df, label)

    @cached_property
    def sorting_variables(self) -> DataFrame:
        return self._kept(self.build_sorting_variables(), "sorting-variables")

    @cached_property
    def returns(self) -> DataFrame:
        periods = return_periods(self.panel)
        return self._kept(periods, "return-periods") if self.buckets else periods

    @cached_property
    def premiums(self) -> DataFrame:
        """Monthly premiums of both 3x3 designs, written once for all tests on them."""
        return stage(design_premiums(self.sorting_variables, self.returns), "premiums")

    def comparison(self) -> DataFrame:
        return compare_designs(self.premiums, self.factors)

    def grid(self, axes: GridAxes | None = None, **options) -> DataFrame:
        return run_grid(self.sorting_variables, self.returns, self.factors, axes, **options)

    def cell_sums(self, axes: GridAxes) -> tuple[DataFrame, DataFrame, list[str]]:
        """Sums of the returns that serve the comparison and the grid, the portfolios of the grid's
        cells, and the columns of such a cell.

        The grid's bins are [a, b) and those of the designs (a, b], so a cell of both is a cell of the
        grid together with the design's portfolios.
        """
        stocks, assigned, cell = grid_cells(design_cells(self.sorting_variables), axes, DESIGN_CELL)
        return cell_sums(stocks, self.returns, [*cell, *DESIGN_CELL]), assigned, cell

    def comparison_and_grid(
        self, axes: GridAxes | None = None, **options
    ) -> tuple[DataFrame, DataFrame]:
        """Both results from one join with the returns, whose sums are written once."""
        axes = axes or GridAxes()
        sums, assigned, cell = self.cell_sums(axes)
        sums = stage(sums, "cell-sums")
        self.premiums = stage(premiums_of_cells(sums), "premiums")
        series = stage(series_of_cells(sums, assigned, cell), "grid-series")
        return self.comparison(), grid_tests(series, self.factors, axes, **options)


def run_study(
    spark: SparkSession,
    panel_path: str,
    fundamentals_path: str,
    factors_path: str,
    out_dir: str,
    factors_format: str = "parquet",
    first_year: int = 1970,
    last_year: int = 2025,
    axes: GridAxes | None = None,
) -> None:
    """Read the three tables, run both analyses and write all results below ``out_dir``."""
    clean = f"{out_dir}/clean/factors_monthly"
    raw = read_factors(spark, factors_path, factors_format)
    write_table(tidy_factors(raw, first_year, last_year), clean)
    # one read of the given panel; snapshots and returns then read only their months and columns
    study = Study(
        by_calendar_month(load_stock_panel(spark, panel_path)),
        load_fundamentals(spark, fundamentals_path),
        load_factors(spark, clean, first_year=first_year, last_year=last_year),
    )
    tables = f"{out_dir}/tables"
    comparison, grid = study.comparison_and_grid(axes)
    write_report(comparison, f"{tables}/value_premium_comparison", ("_order",))
    grid = stage(grid, "grid-results")
    write_report(grid, f"{tables}/grid_results", ("spec_id", "_order"))
    bins = estimate_histogram(grid)
    write_report(bins, f"{tables}/estimate_histogram", ("test", "bin", "is_significant"))
    write_report(grid_summary(grid), f"{tables}/grid_summary", ("test", "axis", "option"))
    write_report(reference_lines(study.factors), f"{tables}/reference_lines", ("test",))
