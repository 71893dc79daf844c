from __future__ import annotations

import datetime as dt
import re

from factorloom import operators as ops
from factorloom import plans
from factorloom.operators.returns import governed_returns
from factorloom.sources import load_sorting_table, write_sorting_table
from factorloom.workspace import stage_bucketed

from .helpers import RETURN_SCHEMA, SV_SCHEMA, random_market
from .test_plans import plan_of


def rows_by_date(df):
    found = {}
    for r in df.collect():
        found.setdefault(r.sorting_date.year, set()).add((r.permno, r.bm))
    return found


def test_a_year_is_replaced_and_others_stay(spark, tmp_path):
    sv, _ = random_market(n_stocks=12)
    path = str(tmp_path / "sv")
    whole = spark.createDataFrame(sv, SV_SCHEMA)
    write_sorting_table(whole, path)
    before = rows_by_date(load_sorting_table(spark, path))
    assert before == rows_by_date(whole)
    kept = {f: f.read_bytes() for f in tmp_path.rglob("*.parquet") if "1989" not in str(f)}

    new = [(99, "NYSE", "Other", dt.date(1989, 7, 1), 1.0, 2.0)]
    write_sorting_table(spark.createDataFrame(new, SV_SCHEMA), path)
    after = rows_by_date(load_sorting_table(spark, path))
    assert after == before | {1989: {(99, 2.0)}}
    assert all(f.read_bytes() == content for f, content in kept.items())

    # a named date of which nothing is left
    write_sorting_table(whole.limit(0), path, [dt.date(1990, 7, 1)])
    assert rows_by_date(load_sorting_table(spark, path)) == {
        year: rows for year, rows in after.items() if year != 1990
    }


def test_a_sample_split_reads_its_folders(spark, tmp_path):
    sv, rets = random_market(n_stocks=12)
    path = str(tmp_path / "sv")
    write_sorting_table(spark.createDataFrame(sv, SV_SCHEMA), path)
    table = load_sorting_table(spark, path)
    late, early, full = (
        plans.GridAxes((2,), {"ALL": ("NYSE", "NASDAQ", "AMEX")}, dependent=(False,), samples=(sample,))
        for sample in (
            plans.Sample("late", start=dt.date(1990, 7, 1)),
            plans.Sample("early", end=dt.date(1990, 7, 1)),
            plans.Sample("full"),
        )
    )

    def folders(axes):
        return re.findall(r"PartitionFilters: \[[^\]]*(>=|<) 1990-07-01", plan_of(plans.spec_coverage(table, axes)))

    assert ">=" in folders(late) and "<" in folders(early) and not folders(full)
    returns = spark.createDataFrame(rets, RETURN_SCHEMA)
    every = {tuple(r) for r in plans.grid_series(table, returns, full).collect()}
    for axes, inside in ((late, lambda d: d >= dt.date(1990, 7, 1)), (early, lambda d: d < dt.date(1990, 7, 1))):
        found = plans.grid_series(table, returns, axes)
        at = found.columns.index("sorting_date")
        assert {tuple(r) for r in found.collect()} == {r for r in every if inside(r[at])}


def test_bucketed_tables_meet_without_a_shuffle(spark):
    sv, rets = random_market(n_stocks=20)
    keys = ["permno", "sorting_date"]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        stocks = stage_bucketed(spark.createDataFrame(sv, SV_SCHEMA), "sv", keys, 5)
        returns = stage_bucketed(spark.createDataFrame(rets, RETURN_SCHEMA), "returns", keys, 5)
        joined = governed_returns(stocks, returns)
        assert "Exchange" not in plan_of(joined) and "SortMergeJoin" in plan_of(joined)
        assert joined.count() == len(rets)
        # sorted stocks move once more, the returns never
        cells = ops.cell_sums(ops.univariate_sort(stocks, 3), returns, ["portfolio"])
        plan = plan_of(cells)
        moved = re.findall(r"Exchange\nInput \[\d+\]: \[([^\]]*)\]", plan)
        assert moved and not any("ret_excess" in m for m in moved)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
