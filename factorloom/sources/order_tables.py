"""A stock panel, fundamentals and factors derived from supplier order lines.

A supplier plays the stock, and the month of shipping the return month.  One
scan and one shuffle of ``lineitem`` feed all three tables: the monthly sums per
supplier are enough for each of them.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clean_double, month_start
from ..workspace import stage
from .tables import FACTORS, FUNDAMENTALS, STOCK_PANEL, conform, tidy_factors

FIRST_YEAR, LAST_YEAR = 1995, 2001


class MarketTables(NamedTuple):
    panel: DataFrame
    fundamentals: DataFrame
    factors: DataFrame


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def supplier_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums per supplier and month; map-side partial sums absorb a hot supplier."""
    discount, tax = F.col("l_discount"), F.col("l_tax")
    returned, accepted = F.col("l_returnflag") == "R", F.col("l_returnflag") == "A"
    return (
        _read(spark, sf_dir, "lineitem")
        .filter(F.col("l_suppkey").isNotNull() & F.col("l_shipdate").isNotNull())
        .groupBy(
            F.col("l_suppkey").alias("permno"),
            month_start(F.col("l_shipdate")).alias("date"),
        )
        .agg(
            F.sum("l_extendedprice").alias("price"),
            F.sum("l_quantity").alias("quantity"),
            F.sum(discount).alias("discount"),
            F.count(discount).alias("discount_n"),
            F.sum(tax).alias("tax"),
            F.count(tax).alias("tax_n"),
            F.sum(F.when(returned, discount)).alias("discount_r"),
            F.count(F.when(returned, discount)).alias("discount_r_n"),
            F.sum(F.when(accepted, discount)).alias("discount_a"),
            F.count(F.when(accepted, discount)).alias("discount_a_n"),
        )
    )


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exchange and industry of each supplier; its size grows with the data, so no hint."""
    nation = _read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = F.col("n_regionkey")
    return (
        _read(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.col("s_suppkey").alias("permno"),
            F.when(region <= 1, "NYSE")
            .when(region <= 3, "NASDAQ")
            .when(region == 4, "AMEX")
            .alias("exchange"),
            F.when(F.col("n_nationkey") < 5, "Finance").otherwise("Other").alias("industry"),
        )
    )


def wide_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock panel columns, the sums behind the other tables, and the calendar month."""
    # one row per supplier and month, so a window holds at most the months of the calendar
    by_month = Window.partitionBy("permno").orderBy("date")
    return (
        supplier_months(spark, sf_dir)
        .join(_listing(spark, sf_dir), "permno", "left")
        .withColumn("gvkey", F.concat(F.lit("G"), F.col("permno").cast("string")))
        .withColumn("mktcap", clean_double(F.col("price")))
        .withColumn("mktcap_lag", F.lag("mktcap").over(by_month))
        .withColumn(
            "ret_excess",
            F.try_divide("discount", "discount_n") - F.try_divide("tax", "tax_n"),
        )
        .withColumn("cal_month", F.month("date"))
        .drop("price")
    )


def _panel(wide: DataFrame) -> DataFrame:
    # cal_month is the partition column of the written table: June and December
    # snapshots read one twelfth of the files
    return wide.select(*STOCK_PANEL.fieldNames(), "cal_month")


def _fundamentals(wide: DataFrame) -> DataFrame:
    annual = wide.groupBy("gvkey", F.year("date").alias("year")).agg(
        (F.sum("quantity") * 1000).alias("be")
    )
    return conform(
        annual.withColumn("datadate", F.make_date("year", F.lit(12), F.lit(31))), FUNDAMENTALS
    )


def _factors(wide: DataFrame) -> DataFrame:
    def mean(name: str):
        return F.try_divide(F.sum(name), F.sum(f"{name}_n"))

    monthly = wide.groupBy("date").agg(
        (mean("discount") - mean("tax")).alias("mkt_excess"),
        (mean("discount_r") - mean("discount_a")).alias("hml"),
    )
    return conform(tidy_factors(monthly, FIRST_YEAR, LAST_YEAR), FACTORS)


def market_tables(spark: SparkSession, sf_dir: str) -> MarketTables:
    """The three input tables, over one written copy of the supplier months."""
    months = wide_panel(spark, sf_dir).hint("rebalance", "cal_month")
    wide = stage(months, "panel", partition_by=("cal_month",))
    return MarketTables(_panel(wide), _fundamentals(wide), _factors(wide))


def source_signature(spark: SparkSession, sf_dir: str) -> tuple:
    """Changes whenever a file behind the derived tables does; reads no file content."""
    paths = [f"{sf_dir.rstrip('/')}/{name}.parquet" for name in ("lineitem", "supplier", "nation")]
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(paths)
        .select("path", "length", "modificationTime")
        .coalesce(64)
    )
    return tuple(
        files.agg(
            F.count("*"),
            F.sum("length"),
            F.max("modificationTime").cast("string"),
            F.bit_xor(F.xxhash64("path", "length", "modificationTime")),
        ).first()
    )
