from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from factorloom import operators as ops
from factorloom.plans import Study
from factorloom.sources import load_factors, load_fundamentals, load_stock_panel, write_report

from .helpers import STOCK_SCHEMA

D = dt.date
FUND_SCHEMA = "gvkey string, datadate date, be double"


def stock(permno, date, mktcap, gvkey=None, **other):
    row = {"exchange": "NYSE", "industry": "Other", "mktcap_lag": None, "ret_excess": None}
    row.update(other)
    return (
        permno, gvkey or f"G{permno}", date, row["exchange"], row["industry"], mktcap,
        row["mktcap_lag"], row["ret_excess"],
    )


def test_june_and_december_become_known_in_july(spark):
    panel = spark.createDataFrame(
        [stock(1, D(2020, m, 1), float(m)) for m in range(1, 13)], STOCK_SCHEMA
    )
    size = ops.june_size(panel).collect()
    assert [(r.sorting_date, r.me) for r in size] == [(D(2020, 7, 1), 6.0)]
    december = ops.december_equity(panel).collect()
    assert [(r.sorting_date, r.me_dec) for r in december] == [(D(2021, 7, 1), 12.0)]


def test_return_months_belong_to_the_july_before(spark):
    panel = spark.createDataFrame(
        [stock(1, D(2020, m, 1), 1.0) for m in range(1, 13)], STOCK_SCHEMA
    )
    got = {r.date.month: r.sorting_date for r in ops.return_periods(panel).collect()}
    assert got == {m: D(2020 if m >= 7 else 2019, 7, 1) for m in range(1, 13)}


def test_zero_or_missing_december_cap_is_left_out(spark):
    panel = spark.createDataFrame(
        [stock(p, D(2019, 12, 1), cap) for p, cap in ((1, 0.0), (2, None), (3, 4.0))]
        + [stock(p, D(2020, 6, 1), 5.0) for p in (1, 2, 3)],
        STOCK_SCHEMA,
    )
    fundamentals = spark.createDataFrame(
        [(f"G{p}", D(2019, 12, 31), 2.0) for p in (1, 2, 3)], FUND_SCHEMA
    )
    bm = ops.book_to_market(fundamentals, ops.december_equity(panel))
    assert {r.permno: r.bm for r in bm.collect()} == {1: None, 2: None, 3: 0.5}
    sv = ops.sorting_variables(ops.june_size(panel), bm).collect()
    assert [(r.permno, r.me, r.bm) for r in sv] == [(3, 5.0, 0.5)]


def test_latest_year_end_with_book_equity_wins(spark):
    panel = spark.createDataFrame(
        [stock(1, D(2019, 12, 1), 10.0), stock(1, D(2020, 6, 1), 5.0)], STOCK_SCHEMA
    )
    fundamentals = spark.createDataFrame(
        [
            ("G1", D(2019, 3, 31), 1.0),
            ("G1", D(2019, 9, 30), 2.0),
            ("G1", D(2019, 12, 31), None),
        ],
        FUND_SCHEMA,
    )
    size, december = ops.june_size(panel), ops.december_equity(panel)
    plain = ops.sorting_variables(size, ops.book_to_market(fundamentals, december))
    early = ops.sorting_variables(
        size, ops.book_to_market(ops.latest_fundamentals(fundamentals), december)
    )
    assert plain.collect() == early.collect()
    assert [r.bm for r in plain.collect()] == [0.2]


def test_many_copies_of_one_key_collapse(spark):
    rows = [("G1", D(2019, 1 + i % 12, 28), float(i)) for i in range(5000)]
    rows += [("G2", D(2019, 5, 31), 7.0)]
    fundamentals = spark.createDataFrame(rows, FUND_SCHEMA)
    got = {r.gvkey: r.be for r in ops.latest_fundamentals(fundamentals).collect()}
    assert got == {"G1": max(r[2] for r in rows if r[0] == "G1" and r[1].month == 12), "G2": 7.0}


def test_copies_of_one_stock_do_not_multiply(spark):
    n = 3000
    size = spark.range(n).selectExpr(
        "1L as permno", "'NYSE' as exchange", "'Other' as industry",
        "date'2020-07-01' as sorting_date", "cast(id as double) as me",
    )
    bm = spark.range(n).selectExpr(
        "1L as permno", "date'2020-07-01' as sorting_date", "cast(id as double) as bm",
        "date'2019-01-31' + cast(id % 300 as int) as datadate", "cast(id as string) as gvkey",
    )
    got = ops.sorting_variables(size, bm).collect()
    assert [(r.me, r.bm) for r in got] == [(2999.0, 899.0)]
    plan = ops.sorting_variables(size, bm)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")


def test_null_firm_never_joins(spark):
    panel = spark.createDataFrame(
        [(1, None, D(2019, 12, 1), "NYSE", "Other", 3.0, None, None)], STOCK_SCHEMA
    )
    fundamentals = spark.createDataFrame([("G1", D(2019, 12, 31), 1.0)], FUND_SCHEMA)
    assert ops.book_to_market(fundamentals, ops.december_equity(panel)).count() == 0


def test_loading_cleans_dates_and_numbers(spark, tmp_path):
    rows = [
        stock(1, D(2020, 6, 30), float("nan"), ret_excess=-0.0),
        stock(2, D(2020, 12, 31), 3.0),
    ]
    spark.createDataFrame(rows, STOCK_SCHEMA).write.parquet(str(tmp_path / "panel"))
    got = {r.permno: r for r in load_stock_panel(spark, str(tmp_path / "panel")).collect()}
    assert got[1].date == D(2020, 6, 1) and got[2].date == D(2020, 12, 1)
    assert got[1].mktcap is None and str(got[1].ret_excess) == "0.0"


def test_missing_columns_are_named(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "f"))
    with pytest.raises(ValueError, match="gvkey"):
        load_fundamentals(spark, str(tmp_path / "f"))


@pytest.mark.parametrize("file_format", ["parquet", "csv"])
def test_factors_are_cut_to_the_years(spark, tmp_path, file_format):
    rows = [(f"{y}-{m:02d}-01", 0.01 * m, 0.001 * y) for y in (1969, 1970, 2025, 2026) for m in (1, 12)]
    raw = spark.createDataFrame(rows, "date string, mkt_excess double, hml double")
    path = str(tmp_path / "factors")
    if file_format == "csv":
        raw.select("hml", "date", "mkt_excess").write.option("header", True).csv(path)
    else:
        raw.selectExpr("cast(date as timestamp) as date", "mkt_excess", "hml").write.parquet(path)
    got = load_factors(spark, path, file_format).orderBy("date").collect()
    assert [r.date for r in got] == [D(y, m, 1) for y in (1970, 2025) for m in (1, 12)]
    assert got[0].mkt_excess == 0.01


def test_report_is_one_ordered_file_with_full_precision(spark, tmp_path):
    rows = [(i, 1 / (i + 3)) for i in range(50)]
    df = spark.createDataFrame(rows[::-1], "_order int, value double").repartition(5)
    write_report(df, str(tmp_path / "r"), ("_order",))
    files = list((tmp_path / "r").glob("*.csv"))
    assert len(files) == 1
    lines = files[0].read_text().split()
    assert lines[0] == "value"
    assert [float(x) for x in lines[1:]] == [v for _, v in rows]


def test_a_large_report_is_ordered_over_its_files(spark, tmp_path):
    df = spark.range(200_000).select(
        F.xxhash64("id").alias("_order"), F.xxhash64("id").alias("value"), F.repeat(F.lit("x"), 40).alias("pad")
    )
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        write_report(df, str(tmp_path / "r"), ("_order",))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    files = sorted((tmp_path / "r").glob("*.csv"))
    assert len(files) > 1
    values = []
    for file in files:
        header, *lines = file.read_text().splitlines()
        assert header == "value,pad"
        values += [int(line.split(",")[0]) for line in lines]
    assert len(values) == 200_000 and values == sorted(values)


def test_an_empty_report_has_a_header(spark, tmp_path):
    df = spark.createDataFrame([], "_order int, value double")
    write_report(df, str(tmp_path / "r"), ("_order",))
    assert [f.read_text() for f in (tmp_path / "r").glob("*.csv")] == ["value\n"]


def test_study_builds_the_sorting_variables(spark):
    panel = spark.createDataFrame(
        [stock(p, D(2019, 12, 1), 10.0 * p) for p in (1, 2)]
        + [stock(p, D(2020, 6, 1), 5.0 * p) for p in (1, 2)],
        STOCK_SCHEMA,
    )
    fundamentals = spark.createDataFrame(
        [(f"G{p}", D(2019, 6, 30), 1.0) for p in (1, 2)], FUND_SCHEMA
    )
    got = Study(panel, fundamentals, None).sorting_variables.orderBy("permno").collect()
    assert [(r.permno, r.sorting_date, r.me, r.bm) for r in got] == [
        (1, D(2020, 7, 1), 5.0, 0.1),
        (2, D(2020, 7, 1), 10.0, 0.05),
    ]
