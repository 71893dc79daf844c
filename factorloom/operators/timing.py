"""Point-in-time alignment: every variable gets the July 1 from which it is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import governing_july, july_first


def _calendar_month(panel: DataFrame) -> Column:
    # a panel written by month prunes whole folders on its partition column
    return F.col("cal_month") if "cal_month" in panel.columns else F.month("date")


def june_size(panel: DataFrame) -> DataFrame:
    """June market cap, effective on July 1 of the same year."""
    return panel.filter(_calendar_month(panel) == 6).select(
        "permno",
        "exchange",
        "industry",
        F.add_months("date", 1).alias("sorting_date"),
        F.col("mktcap").alias("me"),
    )


def december_equity(panel: DataFrame) -> DataFrame:
    """December market cap, effective on July 1 of the next year."""
    return panel.filter(_calendar_month(panel) == 12).select(
        "permno",
        "gvkey",
        F.add_months("date", 7).alias("sorting_date"),
        F.col("mktcap").alias("me_dec"),
    )


def with_sort_date(fundamentals: DataFrame) -> DataFrame:
    """Add July 1 of the year after the fiscal year-end, unless it is there."""
    if "sorting_date" in fundamentals.columns:
        return fundamentals
    return fundamentals.withColumn("sorting_date", july_first(F.year("datadate") + 1))


def book_to_market(fundamentals: DataFrame, december: DataFrame) -> DataFrame:
    """Book equity of a fiscal year over the December market cap of that year.

    One row per matching pair.  A zero market cap gives a null ratio.  The
    fiscal year-end and firm are kept for :func:`dedupe_cross_section`.
    """
    return (
        with_sort_date(fundamentals)
        .join(december, on=["gvkey", "sorting_date"], how="inner")
        .select(
            "permno",
            "sorting_date",
            F.try_divide("be", "me_dec").alias("bm"),
            "datadate",
            "gvkey",
        )
    )


def latest_fundamentals(fundamentals: DataFrame) -> DataFrame:
    """The latest year-end with book equity per firm and calendar year.

    :func:`dedupe_cross_section` would keep these rows anyway; choosing them
    first, by an aggregate with map-side combine, makes the join with December
    equity at most one row per stock, also for a firm with very many rows.
    """
    latest = F.max(F.struct("datadate", "be")).alias("latest")
    return (
        with_sort_date(fundamentals.filter(F.col("be").isNotNull()))
        .groupBy("gvkey", "sorting_date")
        .agg(latest)
        .select("gvkey", "sorting_date", "latest.datadate", "latest.be")
    )


def dedupe_cross_section(df: DataFrame) -> DataFrame:
    """One row per stock and sort date: the latest fiscal year-end, if there is one, wins.

    Further ties go to the largest remaining values, so the result does not
    depend on the order of the input.
    """
    keys = ["permno", "sorting_date"]
    order = [c for c in ("datadate", "gvkey") if c in df.columns]
    order += [c for c in df.columns if c not in keys + order]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order)).alias("best"))
    return best.select(*keys, "best.*")


def sorting_variables(size: DataFrame, bm: DataFrame) -> DataFrame:
    """Annual cross-sections with size and book-to-market, complete and unique.

    Each side is made unique before the join, on the join keys: the best pair of
    a stock is the pair of the best rows, and copies of a key never multiply.
    """
    known_size = dedupe_cross_section(size.filter(F.col("me").isNotNull()))
    known_bm = dedupe_cross_section(bm.filter(F.col("bm").isNotNull()))
    return known_size.join(known_bm, on=["permno", "sorting_date"], how="inner").select(
        "permno", "exchange", "industry", "sorting_date", "me", "bm"
    )


def return_periods(panel: DataFrame) -> DataFrame:
    """Monthly returns with the sort date that governs them (July to next June)."""
    return panel.select(
        "permno",
        governing_july(F.col("date")).alias("sorting_date"),
        "date",
        "ret_excess",
        "mktcap_lag",
    )
