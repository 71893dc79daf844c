"""Sorting variables kept on disk by sort date.

Each sort date is one folder, so a sample split or a single cross-section reads its dates only, and
a new or corrected year replaces its folder and leaves the others alone.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import conform

# the partition column stands last, as Spark reads it
SORTING_VARIABLES = T.StructType(
    [
        T.StructField("permno", T.LongType()),
        T.StructField("exchange", T.StringType()),
        T.StructField("industry", T.StringType()),
        T.StructField("me", T.DoubleType()),
        T.StructField("bm", T.DoubleType()),
        T.StructField("sorting_date", T.DateType()),
    ]
)


def write_sorting_table(sv: DataFrame, path: str, dates: Sequence[dt.date] = ()) -> None:
    """Write the cross-sections; folders of dates that have no rows in ``sv`` stay as they are.

    Dates named by ``dates`` are replaced even if nothing is left of them: such a date gets a row
    without a stock, which :func:`load_sorting_table` leaves out.
    """
    rows = conform(sv, SORTING_VARIABLES)
    if dates:
        blank = [(None, None, None, None, None, d) for d in dates]
        rows = rows.unionByName(sv.sparkSession.createDataFrame(blank, SORTING_VARIABLES))
    (
        rows.hint("rebalance", "sorting_date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("sorting_date")
        .parquet(path)
    )


def load_sorting_table(spark: SparkSession, path: str) -> DataFrame:
    """The table that :func:`write_sorting_table` keeps."""
    table = spark.read.schema(SORTING_VARIABLES).parquet(path)
    return table.filter(F.col("permno").isNotNull())
