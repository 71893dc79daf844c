"""The physical plans: pruned scans, no Python, no cross joins, no collected groups."""

from __future__ import annotations

import contextlib
import io
import os
import re

import pytest

import __spark_entry__ as entry_points
from checks import catalog
from checks.catalog import study
from factorloom import operators as ops
from factorloom import plans
from factorloom.sources import by_calendar_month, load_stock_panel, write_table
from factorloom.sources.order_tables import supplier_months
from factorloom.workspace import scratch_path, stage, workspace_dir

from .helpers import RETURN_SCHEMA, STOCK_SCHEMA, SV_SCHEMA, random_market

SF_DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def plan_of(df) -> str:
    printed = io.StringIO()
    with contextlib.redirect_stdout(printed):
        df.explain("formatted")
    return printed.getvalue()


@needs_tables
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_no_python_and_no_cross_join(spark, name):
    plan = plan_of(entry_points.queries()[name](spark, SF_DIR))
    for operator in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in plan


@needs_tables
def test_lineitem_is_read_once_with_the_needed_columns(spark):
    plan = plan_of(supplier_months(spark, SF_DIR))
    (schema,) = re.findall(r"ReadSchema: struct<([^\n]*)>", plan)
    columns = {part.split(":")[0] for part in schema.split(",")}
    assert columns == {
        "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
        "l_shipdate",
    }
    assert "IsNotNull(l_suppkey)" in plan


@needs_tables
def test_snapshots_read_one_month_of_the_panel(spark):
    plan = plan_of(ops.june_size(study(spark, SF_DIR).panel))
    assert re.search(r"PartitionFilters: \[[^\]]*cal_month#\d+ = 6", plan)
    assert "ret_excess" not in re.search(r"ReadSchema: [^\n]*", plan).group()


def test_a_loaded_panel_is_read_once(spark, tmp_path):
    sv, rets = random_market(n_stocks=5)
    rows = [(p, f"G{p}", d, "NYSE", "Other", 1.0, w, r) for p, _, d, r, w in rets]
    path = str(tmp_path / "panel.parquet")
    spark.createDataFrame(rows, STOCK_SCHEMA).write.parquet(path)
    panel = by_calendar_month(load_stock_panel(spark, path))
    assert path not in "".join(panel.inputFiles())
    again = str(tmp_path / "by-month.parquet")
    write_table(panel, again, ("cal_month",))
    loaded = by_calendar_month(load_stock_panel(spark, again))
    assert all(again in f for f in loaded.inputFiles())
    for frame in (panel, loaded):
        assert re.search(r"PartitionFilters: \[[^\]]*cal_month#\d+ = 12", plan_of(ops.december_equity(frame)))


@needs_tables
def test_a_folder_is_derived_once(spark):
    assert study(spark, SF_DIR) is study(spark, SF_DIR)


def test_stock_returns_move_once(spark):
    """Beyond the two inputs of the join, only sums per date and cell are exchanged."""
    sv, rets = random_market(n_stocks=20)
    stocks = spark.createDataFrame(sv, SV_SCHEMA)
    returns = spark.createDataFrame(rets, RETURN_SCHEMA)
    cells = ops.cell_sums(stocks.hint("merge"), returns, ["exchange"])
    keys = re.findall(r"Arguments: hashpartitioning\((\w+)#\d+", plan_of(cells))
    assert sorted(keys) == ["date", "permno", "permno"]
    assert plan_of(cells).count("partial_sum(") >= 3


@needs_tables
def test_comparison_and_grid_read_the_returns_once(spark):
    s = study(spark, SF_DIR)
    axes = plans.GridAxes(n_portfolios=(2,), samples=(plans.Sample("full"),))
    sums, _, _ = s.cell_sums(axes)
    assert len(re.findall(r"ReadSchema: [^\n]*ret_excess", plan_of(sums))) == 1
    # what follows reads the written sums only
    for found in s.comparison_and_grid(axes):
        assert "ret_excess" not in plan_of(found)


def test_scratch_tables_lie_in_the_checkpoint_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        assert workspace_dir(spark).startswith(shared.rstrip("/"))
    assert scratch_path(spark, "a") != scratch_path(spark, "a")


def test_small_written_tables_are_broadcast_by_their_size(spark):
    sv, _ = random_market(n_stocks=20)
    df = stage(spark.createDataFrame(sv, SV_SCHEMA), "sv")
    assert "BroadcastHashJoin" in plan_of(ops.univariate_sort(df, 5))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10")
        assert "BroadcastHashJoin" not in plan_of(ops.univariate_sort(df, 5))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


@needs_tables
def test_a_changed_source_is_derived_again(spark, tmp_path):
    for name in ("nation", "supplier", "lineitem"):
        table = spark.read.parquet(f"{SF_DIR}/{name}.parquet")
        table.write.parquet(str(tmp_path / f"{name}.parquet"))
    first = study(spark, str(tmp_path))
    before = first.panel.count()
    fewer = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").filter("l_suppkey <> 1")
    fewer.write.mode("overwrite").parquet(str(tmp_path / "lineitem.parquet"))
    second = study(spark, str(tmp_path))
    assert second is not first and 0 < second.panel.count() < before


@needs_tables
def test_a_lost_copy_is_noticed(spark, monkeypatch):
    known = study(spark, SF_DIR)
    assert catalog._still_written(known)
    missing = ["file:/tmp/factorloom-missing/panel/cal_month=1/part-0.parquet"]
    monkeypatch.setattr(type(known.panel), "inputFiles", lambda self: missing)
    assert not catalog._still_written(known)
