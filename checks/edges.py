"""The market of a folder with awkward rows planted in it.

The rules are plain expressions that Spark and the SQL of the checks both read: tied sizes and ratios,
repeated stocks with other values, two year-ends in a year, null values, zero December equity, months
in which all weights are zero, a sort date without NYSE stocks and one whose NYSE stocks have one size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.sources import FUNDAMENTALS, STOCK_PANEL, conform

PANEL = {
    "permno": "permno",
    "gvkey": "gvkey",
    "date": "date",
    "exchange": """CASE WHEN permno % 17 = 4 THEN NULL
        WHEN year(date) = 1997 AND exchange = 'NYSE' THEN 'AMEX' ELSE exchange END""",
    "industry": "industry",
    "mktcap": """CASE WHEN month(date) = 6 AND permno % 11 = 3 THEN NULL
        WHEN month(date) = 6 AND year(date) = 1998 AND exchange = 'NYSE' THEN 100000
        WHEN month(date) = 12 AND permno % 13 = 5 THEN 0
        ELSE floor(mktcap / 50000) * 50000 END""",
    "mktcap_lag": """CASE WHEN permno % 7 = 1 THEN NULL WHEN permno % 5 = 0 THEN 0
        WHEN month(date) = 3 AND year(date) % 2 = 0 THEN 0 ELSE mktcap_lag END""",
    "ret_excess": "CASE WHEN (permno + month(date)) % 9 = 0 THEN NULL ELSE ret_excess END",
}
REPEATED = "month(date) = 6 AND permno % 4 = 0"
REPEATED_CAP = "mktcap + 50000"

ANNUAL = {
    "gvkey": "gvkey",
    "datadate": "datadate",
    "be": """CASE WHEN CAST(substr(gvkey, 2) AS BIGINT) % 6 = 2 AND year(datadate) % 2 = 1 THEN NULL
        ELSE floor(be / 500000) * 500000 END""",
}
EARLIER = {
    "gvkey": "gvkey",
    "datadate": "make_date(CAST(year(datadate) AS INT), 6, 30)",
    "be": "floor(be / 500000) * 1000000",
}
EARLIER_ROWS = "CAST(substr(gvkey, 2) AS BIGINT) % 3 <> 1"


def _picked(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(rule).alias(name) for name, rule in rules.items()])


def planted_panel(panel: DataFrame) -> DataFrame:
    """Nulls of the returns are NaN here, as the readers are given them, and become null in ``conform``."""
    plain = _picked(panel, PANEL)
    again = plain.filter(REPEATED).withColumn("mktcap", F.expr(REPEATED_CAP))
    rows = plain.unionByName(again)
    raw = rows.withColumn("ret_excess", F.coalesce("ret_excess", F.lit(float("nan"))))
    return conform(raw, STOCK_PANEL)


def planted_fundamentals(fundamentals: DataFrame) -> DataFrame:
    earlier = _picked(fundamentals.filter(EARLIER_ROWS), EARLIER)
    return conform(_picked(fundamentals, ANNUAL).unionByName(earlier), FUNDAMENTALS)


def _listed(rules: dict[str, str]) -> str:
    return ", ".join(f"{rule} AS {name}" for name, rule in rules.items())


def planted_sql(base: str) -> str:
    """The common tables of the checks over the planted rows."""
    names = ("panel", "fundamentals")
    for name in names:
        base = base.replace(f"\n{name} AS (", f"\nplain_{name} AS (")
    tables = f"""
planted AS (SELECT {_listed(PANEL)} FROM plain_panel),
panel AS (
  SELECT * FROM planted
  UNION ALL SELECT * REPLACE ({REPEATED_CAP} AS mktcap) FROM planted WHERE {REPEATED}),
fundamentals AS (
  SELECT {_listed(ANNUAL)} FROM plain_fundamentals
  UNION ALL SELECT {_listed(EARLIER)} FROM plain_fundamentals WHERE {EARLIER_ROWS}),"""
    base = base.replace("\nsize AS (", f"{tables}\nsize AS (")
    # repeated stocks differ in size only, and the larger one is kept
    return base.replace("ORDER BY datadate DESC, gvkey DESC", "ORDER BY datadate DESC, gvkey DESC, me DESC")
