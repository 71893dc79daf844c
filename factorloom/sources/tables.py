from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clean_double, month_start
from ..workspace import stage

STOCK_PANEL = T.StructType(
    [
        T.StructField("permno", T.LongType()),
        T.StructField("gvkey", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("exchange", T.StringType()),
        T.StructField("industry", T.StringType()),
        T.StructField("mktcap", T.DoubleType()),
        T.StructField("mktcap_lag", T.DoubleType()),
        T.StructField("ret_excess", T.DoubleType()),
    ]
)

FUNDAMENTALS = T.StructType(
    [
        T.StructField("gvkey", T.StringType()),
        T.StructField("datadate", T.DateType()),
        T.StructField("be", T.DoubleType()),
    ]
)

FACTORS = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("mkt_excess", T.DoubleType()),
        T.StructField("hml", T.DoubleType()),
    ]
)


def conform(df: DataFrame, schema: T.StructType, keep: tuple[str, ...] = ()) -> DataFrame:
    """Check that the columns of ``schema`` are there, then select and cast them.

    Columns named by ``keep`` stay as they are if ``df`` has them.
    """
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df.select(
        *[
            (
                clean_double(F.col(f.name))
                if isinstance(f.dataType, T.DoubleType)
                else F.col(f.name).cast(f.dataType)
            ).alias(f.name)
            for f in schema
        ],
        *[c for c in keep if c in df.columns],
    )


def load_stock_panel(spark: SparkSession, path: str) -> DataFrame:
    """Monthly stock panel, one row per stock and month, dated on month starts.

    A panel written by calendar month keeps the partition column, on which snapshots are pruned.
    """
    panel = conform(spark.read.parquet(path), STOCK_PANEL, keep=("cal_month",))
    return panel.withColumn("date", month_start(F.col("date")))


def load_fundamentals(spark: SparkSession, path: str) -> DataFrame:
    """Annual accounting data, one row per firm and fiscal year-end."""
    return conform(spark.read.parquet(path), FUNDAMENTALS)


def tidy_factors(raw: DataFrame, first_year: int = 1970, last_year: int = 2025) -> DataFrame:
    """Rows of the years ``first_year`` to ``last_year``, with a plain date column.

    All other columns are kept.  The year test is a range on the raw column, so
    that it reaches the file scan.
    """
    in_years = (F.col("date") >= F.lit(dt.date(first_year, 1, 1))) & (
        F.col("date") < F.lit(dt.date(last_year + 1, 1, 1))
    )
    return raw.filter(in_years).withColumn("date", month_start(F.col("date")))


def read_factors(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """Published factor returns as staged, with all columns."""
    if file_format == "parquet":
        return spark.read.parquet(path)
    if file_format == "csv":
        # columns are found by their header name; all but the date are cast on use
        raw = spark.read.option("header", True).csv(path)
        return raw.withColumn("date", F.col("date").cast("date"))
    raise ValueError(f"file_format must be 'parquet' or 'csv', not {file_format!r}")


def load_factors(
    spark: SparkSession,
    path: str,
    file_format: str = "parquet",
    first_year: int = 1970,
    last_year: int = 2025,
) -> DataFrame:
    """Monthly market and value factor of the given years."""
    raw = read_factors(spark, path, file_format)
    return conform(tidy_factors(raw, first_year, last_year), FACTORS)


def by_calendar_month(panel: DataFrame) -> DataFrame:
    """The panel written once by calendar month, unless it is kept so already."""
    if "cal_month" in panel.columns:
        return panel
    monthly = panel.withColumn("cal_month", F.month("date")).hint("rebalance", "cal_month")
    return stage(monthly, "panel-by-month", partition_by=("cal_month",))


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    if partition_by:  # few files in each folder, large ones split
        df = df.hint("rebalance", *partition_by)
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_report(df: DataFrame, path: str, order_by: tuple[str, ...]) -> None:
    """CSV files with a header, in order: rows inside a file, and files by their names.

    Small reports are one file; large ones are sorted in ranges by several tasks.  Columns that begin
    with an underscore only give the order.
    """
    columns = [c for c in df.columns if not c.startswith("_")]
    df.orderBy(*order_by).select(*columns).write.mode("overwrite").option("header", True).csv(path)
