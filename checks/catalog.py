"""The registered queries: every operator over the tables of one data folder."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom import operators as ops
from factorloom import plans, sources
from factorloom.functions import in_universe
from factorloom.operators.portfolios import LISTED
from factorloom.sources.order_tables import FIRST_YEAR, LAST_YEAR, market_tables, source_signature
from factorloom.workspace import scratch_path, stage

from .edges import planted_fundamentals, planted_panel

AXES = plans.GridAxes(samples=plans.default_samples(dt.date(1999, 7, 1)))

_studies: dict[tuple, "_Study"] = {}


class _Study(plans.Study):
    """A study over one data folder, with the results several reports share."""

    @cached_property
    def _both(self) -> tuple[DataFrame, DataFrame]:
        comparison, grid = self.comparison_and_grid(AXES)
        return comparison, stage(grid, "grid-results")

    @property
    def results(self) -> DataFrame:
        return self._both[1]

    @property
    def shared_comparison(self) -> DataFrame:
        return self._both[0]

    @cached_property
    def edges(self) -> "_Study":
        """The study of the same folder with awkward rows planted in its tables."""
        return _Study(planted_panel(self.panel), planted_fundamentals(self.fundamentals), self.factors)


def _still_written(known: _Study) -> bool:
    folder = known.panel.inputFiles()[0].rsplit("/cal_month=", 1)[0]
    try:
        known.panel.sparkSession.read.schema(known.panel.schema).parquet(folder)
    except AnalysisException:
        return False
    return True


def study(spark: SparkSession, sf_dir: str) -> _Study:
    """The study of a folder; derived again when a source file has changed or its copy is gone."""
    key = (spark.conf.get("spark.app.id"), sf_dir, source_signature(spark, sf_dir))
    if key not in _studies or not _still_written(_studies[key]):
        _studies[key] = _Study(*market_tables(spark, sf_dir))
    return _studies[key]


def forget_studies() -> None:
    """Derive every folder again on its next query."""
    _studies.clear()


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


PANEL_DIGITS = {"mktcap": 4, "mktcap_lag": 4, "ret_excess": 12}
TEST_DIGITS = {"estimate": 10, "t_stat": 8}


# inputs


def panel_monthly(s: _Study) -> DataFrame:
    return _rounded(s.panel.drop("cal_month"), **PANEL_DIGITS)


def fundamentals_annual(s: _Study) -> DataFrame:
    return _rounded(s.fundamentals, be=2)


def factors_tidy(s: _Study) -> DataFrame:
    return _rounded(s.factors, mkt_excess=10, hml=10)


def parquet_roundtrip(s: _Study) -> DataFrame:
    spark = s.panel.sparkSession
    path = scratch_path(spark, "roundtrip")
    sources.write_table(s.panel.drop("cal_month"), path)
    return _rounded(sources.load_stock_panel(spark, path), **PANEL_DIGITS)


def fundamentals_roundtrip(s: _Study) -> DataFrame:
    spark = s.panel.sparkSession
    path = scratch_path(spark, "fundamentals")
    sources.write_table(s.fundamentals, path)
    return _rounded(sources.load_fundamentals(spark, path), be=2)


def factors_csv_roundtrip(s: _Study) -> DataFrame:
    spark = s.panel.sparkSession
    path = scratch_path(spark, "factors")
    sources.write_report(s.factors, path, ("date",))
    loaded = sources.load_factors(spark, path, "csv", FIRST_YEAR, LAST_YEAR)
    return _rounded(loaded, mkt_excess=10, hml=10)


def grid_report_roundtrip(s: _Study) -> DataFrame:
    """The written grid report with the position of each row in it."""
    spark = s.panel.sparkSession
    path = scratch_path(spark, "grid-report")
    sources.write_report(s.results, path, ("spec_id", "_order"))
    # one file read by one task: the rows are numbered as they stand in it
    schema = s.results.drop("_order").schema
    lines = spark.read.csv(path, schema=schema, header=True).coalesce(1)
    numbered = lines.withColumn("position", F.monotonically_increasing_id())
    return _rounded(numbered.select("position", "spec_id", "test", "estimate", "t_stat"), **TEST_DIGITS)


def csv_report_roundtrip(s: _Study) -> DataFrame:
    spark = s.panel.sparkSession
    path = scratch_path(spark, "report")
    sources.write_report(s.comparison(), path, ("_order",))
    schema = "design string, value_premium double"
    return _rounded(spark.read.csv(path, schema=schema, header=True), value_premium=10)


# timing


def june_size(s: _Study) -> DataFrame:
    return _rounded(ops.june_size(s.panel), me=4)


def december_equity(s: _Study) -> DataFrame:
    return _rounded(ops.december_equity(s.panel), me_dec=4)


def book_to_market(s: _Study) -> DataFrame:
    return _rounded(ops.book_to_market(s.fundamentals, ops.december_equity(s.panel)), bm=10)


def sorting_variables(s: _Study) -> DataFrame:
    return _rounded(s.build_sorting_variables(), me=4, bm=10)


def return_periods(s: _Study) -> DataFrame:
    return _rounded(s.returns, ret_excess=12, mktcap_lag=4)


# double sorts


def qcut_independent(s: _Study) -> DataFrame:
    return _rounded(ops.double_sort(s.sorting_variables), me=4, bm=10)


def qcut_dependent(s: _Study) -> DataFrame:
    return _rounded(ops.double_sort(s.sorting_variables, dependent=True), me=4, bm=10)


def _double_sort_returns(s: _Study) -> DataFrame:
    return ops.portfolio_returns(
        ops.double_sort(s.sorting_variables), s.returns, ["portfolio_bm", "portfolio_me"]
    )


def vw_double_sort(s: _Study) -> DataFrame:
    return _rounded(_double_sort_returns(s), ret=10)


def size_neutral_returns(s: _Study) -> DataFrame:
    return _rounded(ops.size_neutral(_double_sort_returns(s)), ret=10)


def premium_independent(s: _Study) -> DataFrame:
    averaged = ops.size_neutral(_double_sort_returns(s))
    return _rounded(ops.high_minus_low(averaged, "portfolio_bm"), value_premium=10)


def premium_dependent(s: _Study) -> DataFrame:
    chosen = s.premiums.filter(F.col("design") == "Dependent").drop("design")
    return _rounded(chosen, value_premium=10)


def premium_comparison(s: _Study) -> DataFrame:
    return _rounded(s.comparison().drop("_order"), value_premium=10)


# exchange breakpoints and grid sorts


def _tenths(s: _Study, universes: dict[str, list[str]]) -> DataFrame:
    populations = {u: in_universe(F.col("exchange"), e) for u, e in universes.items()}
    found = ops.quantiles(
        s.sorting_variables,
        "bm",
        [i / 10 for i in range(11)],
        ["sorting_date"],
        populations,
    )
    listed = found.select("sorting_date", "population", F.posexplode("q").alias("position", "break"))
    return _rounded(listed, **{"break": 10})


def exchange_breakpoints(s: _Study) -> DataFrame:
    return _tenths(s, {"NYSE": ["NYSE"]}).drop("population")


def exchange_breakpoints_ranked(s: _Study) -> DataFrame:
    return _tenths(s, {"NYSE": ["NYSE"], "ALL": LISTED})


def sort_univariate(s: _Study) -> DataFrame:
    sorted_ = ops.univariate_sort(s.sorting_variables, 5, ["NYSE"])
    return sorted_.select("permno", "sorting_date", "portfolio")


def sort_conditional(s: _Study) -> DataFrame:
    sorted_ = ops.conditional_sort(s.sorting_variables, 5, pool=False)
    kept = ["permno", "sorting_date", "portfolio_me", "portfolio"]
    return sorted_.select(*kept)


def unassigned_counts(s: _Study) -> DataFrame:
    return ops.unassigned_counts(ops.conditional_sort(s.sorting_variables, 10, ["NYSE"]))


def returns_vw_ew(s: _Study) -> DataFrame:
    sorted_ = ops.univariate_sort(s.sorting_variables, 5, ["NYSE"])
    return _rounded(ops.portfolio_returns(sorted_, s.returns, weight="both"), ret=10)


def high_minus_low(s: _Study) -> DataFrame:
    sorted_ = ops.conditional_sort(s.sorting_variables, 5)
    rets = ops.portfolio_returns(sorted_, s.returns, weight="both")
    return _rounded(ops.high_minus_low(rets, by=["weighting", "date"]), value_premium=10)


# inference


def newey_west_mean(s: _Study) -> DataFrame:
    return _rounded(ops.newey_west_mean(s.premiums, by=["design"]), **TEST_DIGITS)


def capm_alpha(s: _Study) -> DataFrame:
    joined = s.premiums.join(s.factors, "date", "left")
    return _rounded(ops.capm_alpha(joined, by=["design"]), **TEST_DIGITS)


def factor_capm_alpha(s: _Study) -> DataFrame:
    return _rounded(ops.capm_alpha(s.factors, y="hml"), **TEST_DIGITS)


def gap_check(s: _Study) -> DataFrame:
    return ops.gap_check(s.premiums, by=["design"])


# grid


def spec_coverage(s: _Study) -> DataFrame:
    return plans.spec_coverage(s.sorting_variables, AXES)


def grid_series(s: _Study) -> DataFrame:
    return _rounded(plans.grid_series(s.sorting_variables, s.returns, AXES), value_premium=10)


def grid_custom_sample(s: _Study) -> DataFrame:
    """A sample by a predicate of its own, with other options of the tests."""
    axes = plans.GridAxes(
        n_portfolios=(5,),
        universes={"ALL": LISTED},
        samples=(plans.Sample("no_amex", keep="exchange <> 'AMEX'"),),
    )
    rows = s.grid(axes, lag=0, small_sample="none").drop("_order")
    return _rounded(rows, **TEST_DIGITS)


def value_premium(s: _Study) -> DataFrame:
    rows = plans.value_premium(s.sorting_variables, s.returns, s.factors)
    return _rounded(rows.drop("_order"), **TEST_DIGITS)


def grid_results(s: _Study) -> DataFrame:
    return _rounded(s.grid(AXES).drop("_order"), **TEST_DIGITS)


def shared_comparison(s: _Study) -> DataFrame:
    """The comparison from the sums that the grid uses too."""
    return _rounded(s.shared_comparison.drop("_order"), value_premium=10)


def shared_grid(s: _Study) -> DataFrame:
    """The grid from the sums that the comparison uses too."""
    return _rounded(s.results.drop("_order"), **TEST_DIGITS)


def grid_from_split(s: _Study) -> DataFrame:
    """The grid of the later sample alone, over cross-sections kept by sort date."""
    spark = s.panel.sparkSession
    path = scratch_path(spark, "sorting-table")
    sources.write_sorting_table(s.sorting_variables, path)
    axes = plans.GridAxes(samples=AXES.samples[-1:])
    kept = sources.load_sorting_table(spark, path)
    return _rounded(plans.grid_series(kept, s.returns, axes), value_premium=10)


# cross-sections kept by sort date, and in buckets


def sorting_table_rebuild(s: _Study) -> DataFrame:
    """Cross-sections kept with doubled ratios, of which two years are built again."""
    path = scratch_path(s.panel.sparkSession, "sorting-table")
    doubled = s.sorting_variables.withColumn("bm", F.col("bm") * 2)
    sources.write_sorting_table(doubled, path)
    kept = plans.Study(s.panel, s.fundamentals, s.factors)
    kept.write_sorting_table(path, years=[1998, 2000])
    return _rounded(kept.sorting_variables, me=4, bm=10)


def bucketed_double_sort(s: _Study) -> DataFrame:
    """The returns of the independent sort from tables in buckets of stock and sort date."""
    bucketed = plans.Study(s.panel, s.fundamentals, s.factors, buckets=8)
    return vw_double_sort(bucketed)


# the sorts over planted edge rows


def edge_sorting_variables(s: _Study) -> DataFrame:
    return sorting_variables(s.edges)


def edge_qcut_independent(s: _Study) -> DataFrame:
    return qcut_independent(s.edges)


def edge_qcut_dependent(s: _Study) -> DataFrame:
    return qcut_dependent(s.edges)


def edge_sort_univariate(s: _Study) -> DataFrame:
    return sort_univariate(s.edges)


def edge_sort_conditional(s: _Study) -> DataFrame:
    sorted_ = ops.conditional_sort(s.edges.sorting_variables, 5, ["NYSE"], pool=False)
    return sorted_.select("permno", "sorting_date", "portfolio_me", "portfolio")


def edge_unassigned_counts(s: _Study) -> DataFrame:
    return unassigned_counts(s.edges)


def edge_vw_double_sort(s: _Study) -> DataFrame:
    return vw_double_sort(s.edges)


def edge_returns_vw_ew(s: _Study) -> DataFrame:
    return returns_vw_ew(s.edges)


def edge_shared_comparison(s: _Study) -> DataFrame:
    return shared_comparison(s.edges)


def edge_shared_grid(s: _Study) -> DataFrame:
    return shared_grid(s.edges)


# reports


def significance_flags(s: _Study) -> DataFrame:
    flagged = ops.flag_significant(s.results)
    kept = flagged.select("spec_id", "test", "estimate", "t_stat", "is_significant")
    return _rounded(kept, **TEST_DIGITS)


def estimate_histogram(s: _Study) -> DataFrame:
    return _rounded(plans.estimate_histogram(s.results), bin_centre=6)


def reference_lines(s: _Study) -> DataFrame:
    return _rounded(plans.reference_lines(s.factors), reference=10)


def grid_summary(s: _Study) -> DataFrame:
    spread = ["min", "max", "mean", "median", "sd"]
    return _rounded(plans.grid_summary(s.results), **{f"{c}_estimate": 10 for c in spread})


QUERIES: list[Callable[[_Study], DataFrame]] = [
    panel_monthly,
    fundamentals_annual,
    factors_tidy,
    parquet_roundtrip,
    fundamentals_roundtrip,
    factors_csv_roundtrip,
    grid_report_roundtrip,
    csv_report_roundtrip,
    june_size,
    december_equity,
    book_to_market,
    sorting_variables,
    return_periods,
    qcut_independent,
    qcut_dependent,
    vw_double_sort,
    size_neutral_returns,
    premium_independent,
    premium_dependent,
    premium_comparison,
    exchange_breakpoints,
    exchange_breakpoints_ranked,
    sort_univariate,
    sort_conditional,
    unassigned_counts,
    returns_vw_ew,
    high_minus_low,
    newey_west_mean,
    capm_alpha,
    factor_capm_alpha,
    gap_check,
    spec_coverage,
    grid_series,
    value_premium,
    grid_custom_sample,
    grid_results,
    shared_comparison,
    shared_grid,
    grid_from_split,
    sorting_table_rebuild,
    bucketed_double_sort,
    edge_sorting_variables,
    edge_qcut_independent,
    edge_qcut_dependent,
    edge_sort_univariate,
    edge_sort_conditional,
    edge_unassigned_counts,
    edge_vw_double_sort,
    edge_returns_vw_ew,
    edge_shared_comparison,
    edge_shared_grid,
    significance_flags,
    estimate_histogram,
    reference_lines,
    grid_summary,
]


def _over_folder(query: Callable[[_Study], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(study(spark, sf_dir))

    run.__name__ = query.__name__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {query.__name__: _over_folder(query) for query in QUERIES}
