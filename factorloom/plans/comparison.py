"""Mean value premium of the two double sorts, next to the published factor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cross_section import bin_number, double_breaks, join_on, nested_bin
from ..operators.portfolios import SORT_DATE
from ..operators.premium import high_minus_low, mean_premium, size_neutral
from ..operators.returns import cell_sums, returns_from_sums
from ..workspace import stage


#: What tells the portfolios of both designs apart: at most 27 cells a month.
DESIGN_CELL = ("portfolio_me", "bm_independent", "bm_dependent")


def design_cells(sv: DataFrame) -> DataFrame:
    """Add the portfolios of the independent and the dependent 3x3 sort.

    Both designs share the size portfolios and differ in book-to-market, so each stock gets all three
    numbers and the returns are joined once.
    """
    breaks = stage(double_breaks(sv, "me", "bm", 3, 3, SORT_DATE), "breaks")
    ids = join_on(sv, breaks, SORT_DATE)
    ids = bin_number(ids, "me", "first_breaks", "portfolio_me", 3, "right")
    ids = bin_number(ids, "bm", "second_breaks", "bm_independent", 3, "right")
    ids = nested_bin(ids, "bm", "portfolio_me", "bm_dependent", 3, "right")
    return ids.select(*sv.columns, *DESIGN_CELL)


def premiums_of_cells(sums: DataFrame) -> DataFrame:
    """Monthly value premium of both designs, from sums per date and design cell or finer."""
    designs = [
        F.struct(F.lit(name).alias("design"), F.col(column).alias("portfolio_bm"))
        for name, column in (("Independent", "bm_independent"), ("Dependent", "bm_dependent"))
    ]
    both = sums.select("*", F.inline(F.array(*designs)))
    rets = returns_from_sums(both, ["design", "date", "portfolio_bm", "portfolio_me"])
    averaged = size_neutral(rets.withColumnRenamed("ret_vw", "ret"), by=["design", "date"])
    return high_minus_low(averaged, "portfolio_bm", by=["design", "date"])


def design_premiums(sv: DataFrame, returns: DataFrame) -> DataFrame:
    """Monthly value premium of the independent and the dependent 3x3 sort."""
    return premiums_of_cells(cell_sums(design_cells(sv), returns, DESIGN_CELL))


def compare_designs(premiums: DataFrame, factors: DataFrame) -> DataFrame:
    """Three rows ``design, value_premium``; ``_order`` is the order of the report."""
    means = mean_premium(premiums, by=["design"])
    published = factors.agg(F.avg("hml").alias("value_premium")).select(
        F.lit("Published HML").alias("design"), "value_premium"
    )
    order = (
        F.when(F.col("design") == "Independent", 1).when(F.col("design") == "Dependent", 2)
    ).otherwise(3)
    return means.unionByName(published).withColumn("_order", order)


def premium_comparison(sv: DataFrame, returns: DataFrame, factors: DataFrame) -> DataFrame:
    """The comparison from sorting variables and returns."""
    return compare_designs(design_premiums(sv, returns), factors)
