from __future__ import annotations

import csv
import datetime as dt
import math
import random

from factorloom import plans
from factorloom.__main__ import main
from factorloom.sources import load_factors, load_fundamentals, load_stock_panel

from .helpers import STOCK_SCHEMA, month


def write_inputs(spark, folder):
    rng = random.Random(21)
    panel, fundamentals, factors = [], [], []
    for permno in range(30):
        exchange = rng.choice(["NYSE", "NYSE", "NASDAQ", "AMEX"])
        industry = rng.choice(["Finance", "Other", "Other"])
        cap, last = math.exp(rng.gauss(5, 1)), None
        for k in range(5 * 12):
            ret = rng.gauss(0.01, 0.05)
            cap *= 1 + ret
            # dates at month ends, as raw files have them
            date = month(1988, k + 2) - dt.timedelta(days=1)
            panel.append((permno, f"0{permno}", date, exchange, industry, cap, last, ret))
            last = cap
        for year in range(1987, 1993):
            fundamentals.append((f"0{permno}", dt.date(year, 12, 31), math.exp(rng.gauss(4, 1))))
    for k in range(-24, 5 * 12):
        factors.append((str(month(1988, k + 1)), rng.gauss(0, 0.04), rng.gauss(0, 0.02), 0.1))
    spark.createDataFrame(panel, STOCK_SCHEMA).write.parquet(f"{folder}/panel")
    spark.createDataFrame(fundamentals, "gvkey string, datadate date, be double").write.parquet(
        f"{folder}/fundamentals"
    )
    spark.createDataFrame(
        factors, "date string, mkt_excess double, hml double, smb double"
    ).write.option("header", True).csv(f"{folder}/factors")


def read_report(path):
    (file,) = path.glob("*.csv")
    with open(file, newline="") as f:
        return list(csv.DictReader(f))


def test_command_writes_all_reports(spark, tmp_path):
    write_inputs(spark, tmp_path)
    inputs = [str(tmp_path / name) for name in ("panel", "fundamentals", "factors")]
    options = ["--factors-format", "csv", "--first-year", "1988", "--last-year", "1991"]
    main([*inputs, str(tmp_path / "out"), *options])
    tables = tmp_path / "out" / "tables"

    comparison = read_report(tables / "value_premium_comparison")
    assert [r["design"] for r in comparison] == ["Independent", "Dependent", "Published HML"]
    assert list(comparison[0]) == ["design", "value_premium"]

    grid = read_report(tables / "grid_results")
    assert len(grid) == 192
    assert [r["test"] for r in grid] == ["Newey-West", "CAPM-alpha"] * 96
    assert [int(r["spec_id"]) for r in grid] == [i // 2 for i in range(192)]

    bins = read_report(tables / "estimate_histogram")
    assert sum(int(r["n_specs"]) for r in bins) == sum(r["estimate"] != "" for r in grid)
    assert len(read_report(tables / "reference_lines")) == 2
    assert len(read_report(tables / "grid_summary")) == 2 * (1 + 3 + 2 + 2 + 2 + 4)

    clean = spark.read.parquet(str(tmp_path / "out" / "clean" / "factors_monthly"))
    assert clean.columns == ["date", "mkt_excess", "hml", "smb"] and clean.count() == 48

    study = plans.Study(
        load_stock_panel(spark, inputs[0]),
        load_fundamentals(spark, inputs[1]),
        load_factors(spark, inputs[2], "csv", 1988, 1991),
    )
    again = {r.design: r.value_premium for r in study.comparison().collect()}
    for r in comparison:
        assert math.isclose(float(r["value_premium"]), again[r["design"]], abs_tol=1e-13)
    sv = study.sorting_variables
    assert {r.sorting_date for r in sv.select("sorting_date").distinct().collect()} == {
        dt.date(y, 7, 1) for y in range(1989, 1993)
    }
