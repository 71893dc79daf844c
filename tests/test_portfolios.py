from __future__ import annotations

import datetime as dt
import math
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from factorloom import operators as ops
from factorloom.operators import cross_section as bp
from factorloom.workspace import stage, workspace_dir

from .helpers import RETURN_SCHEMA, SV_SCHEMA, exchange_bins, linear_quantile, random_market

DATE = dt.date(2000, 7, 1)


def cross_section(spark, values, exchanges=None, date=DATE):
    exchanges = exchanges or ["NYSE"] * len(values)
    rows = [
        (i, e, "Other", date, v, v) for i, (v, e) in enumerate(zip(values, exchanges))
    ]
    return spark.createDataFrame(rows, SV_SCHEMA)


def bins(df, out="portfolio"):
    return [r[out] for r in df.orderBy("permno").collect()]


def test_a_value_on_a_break(spark):
    # medians of 1..3 put the break on 2
    df = cross_section(spark, [1.0, 2.0, 3.0])
    right = ops.assign_quantile(df, "bm", 2, closed="right")
    left = ops.assign_quantile(df, "bm", 2, closed="left")
    assert bins(right) == [1, 1, 2]
    assert bins(left) == [1, 2, 2]


@pytest.mark.parametrize("closed,expected", [("right", [1, 1, 2, 2, 3]), ("left", [1, 2, 2, 3, 3])])
def test_given_breaks(spark, closed, expected):
    df = cross_section(spark, [1.0, 2.0, 2.5, 3.0, 4.0]).withColumn(
        "breaks", F.array(F.lit(2.0), F.lit(3.0))
    )
    assert bins(bp.bin_number(df, "bm", "breaks", "p", 3, closed), "p") == expected


def test_equal_quantiles_collapse(spark):
    values = [1.0, 2.0, 2.0, 2.0, 3.0]
    df = cross_section(spark, values)
    assert bins(ops.univariate_sort(df, 5)) == exchange_bins(values, values, 5)
    right = ops.assign_quantile(df, "bm", 5, closed="right")
    breaks = sorted({linear_quantile(values, i / 5) for i in range(1, 5)})
    assert bins(right) == [1 + sum(b < v for b in breaks) for v in values]


def test_lowest_quantile_of_the_universe_is_open_ended(spark):
    # the 0 and 1/3 quantiles are equal, so only one inner break is left
    values = [1.0, 1.0, 1.0, 2.0, 3.0, 4.0]
    df = cross_section(spark, values)
    assert bins(ops.univariate_sort(df, 3)) == exchange_bins(values, values, 3)


def test_universe_sets_breaks_for_all(spark):
    values = [-5.0, 1.0, 2.0, 3.0, 4.0, 99.0]
    exchanges = ["AMEX", "NYSE", "NYSE", "NYSE", "NYSE", None]
    df = cross_section(spark, values, exchanges)
    got = bins(ops.univariate_sort(df, 2, ["NYSE"]))
    assert got == [1, 1, 1, 2, 2, 2]


def test_empty_or_constant_universe_gives_null(spark):
    none = cross_section(spark, [1.0, 2.0, 3.0], ["AMEX"] * 3)
    one = cross_section(spark, [1.0, 2.0, 3.0], ["NYSE", "AMEX", "AMEX"])
    assert bins(ops.univariate_sort(none, 2, ["NYSE"])) == [None] * 3
    assert bins(ops.univariate_sort(one, 2, ["NYSE"])) == [None] * 3


def test_stocks_without_portfolio_are_counted(spark):
    none = cross_section(spark, [1.0, 2.0, 3.0], ["AMEX"] * 3)
    some = cross_section(spark, [1.0, None, 3.0], date=dt.date(2001, 7, 1))
    df = ops.univariate_sort(none.unionByName(some), 2, ["NYSE"])
    got = {r.sorting_date.year: (r.n_stocks, r.n_unassigned) for r in ops.unassigned_counts(df).collect()}
    assert got == {2000: (3, 3), 2001: (3, 1)}


def test_null_value_has_no_portfolio(spark):
    df = cross_section(spark, [1.0, None, 3.0])
    assert bins(ops.univariate_sort(df, 2)) == [1, None, 2]


def test_one_portfolio_holds_all(spark):
    df = cross_section(spark, [1.0, 2.0, 3.0])
    assert bins(ops.univariate_sort(df, 1)) == [1, 1, 1]
    assert bins(ops.assign_quantile(df, "bm", 1, closed="right")) == [1, 1, 1]


def _hard_groups(seed):
    rng = random.Random(seed)
    hot = [rng.choice([0.0, 1.5]) if rng.random() < 0.5 else rng.lognormvariate(0, 3) for _ in range(6000)]
    return {
        dt.date(2000, 7, 1): hot,
        dt.date(2001, 7, 1): [float(rng.randint(-3, 3)) for _ in range(2000)],
        dt.date(2002, 7, 1): [rng.gauss(1, 1e-9) for _ in range(1500)],
        dt.date(2003, 7, 1): [42.0],
        dt.date(2004, 7, 1): [1.0, 2.0],
        dt.date(2005, 7, 1): [-x for x in hot[:700]] + [1e300, -1e300],
    }


@pytest.mark.parametrize("seed", [3, 4])
def test_quantiles_are_exact(spark, seed):
    groups = _hard_groups(seed)
    rng = random.Random(seed)
    rows = []
    for date, values in groups.items():
        for v in values:
            rows.append((len(rows), rng.choice(["NYSE", "AMEX", "NASDAQ"]), "Other", date, v, v))
    df = spark.createDataFrame(rows, SV_SCHEMA).repartition(7)
    probs = [i / 10 for i in range(11)] + [1 / 3, 2 / 3, 0.123]
    populations = {"all": F.lit(True), "nyse": F.col("exchange") == "NYSE"}
    found = ops.quantiles(df, "bm", probs, ["sorting_date"], populations)
    got = {(r.sorting_date, r.population): r.q for r in found.collect()}
    assert len(got) == 2 * len(groups)
    for date in groups:
        for name in populations:
            values = [r[5] for r in rows if r[3] == date and (name == "all" or r[1] == "NYSE")]
            expected = [linear_quantile(values, p) for p in probs] if values else None
            assert got[date, name] == expected, (date, name)


def test_null_keys_ties_and_infinity(spark):
    inf = float("inf")
    rows = [(None, 4.0), (None, 1.0), (None, 2.0), (DATE, 1.0), (DATE, 2.0), (DATE, inf)]
    rows += [(dt.date(2001, 7, 1), 3.0)] * 5 + [(dt.date(2002, 7, 1), None)]
    df = spark.createDataFrame(rows, "sorting_date date, bm double")
    got = {r.sorting_date: r.q for r in ops.quantiles(df, "bm", [0, 0.5, 1], ["sorting_date"]).collect()}
    assert got[None] == [1.0, 2.0, 4.0]
    assert got[DATE] == [1.0, 2.0, inf]
    assert got[dt.date(2001, 7, 1)] == [3.0] * 3
    assert got[dt.date(2002, 7, 1)] is None
    assigned = ops.assign_quantile(df.withColumn("exchange", F.lit("NYSE")), "bm", 2)
    assert sorted(r.portfolio for r in assigned.filter("sorting_date IS NULL").collect()) == [1, 1, 2]


def test_quantiles_agree_with_the_database(spark):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(11)
    rows = [(DATE, rng.lognormvariate(0, 2)) for _ in range(501)]
    df = spark.createDataFrame(rows, "sorting_date date, bm double")
    probs = [i / 10 for i in range(11)]
    got = ops.quantiles(df, "bm", probs, ["sorting_date"]).first().q
    values = [v for _, v in rows]
    want = duckdb.execute("SELECT quantile_cont(v, ?) FROM (SELECT unnest(?) AS v)", [probs, values]).fetchall()
    assert all(math.isclose(a, b, rel_tol=1e-12) for a, b in zip(got, want[0][0]))


def test_too_many_breaks_are_an_error(spark):
    df = cross_section(spark, [1.0]).withColumn("breaks", F.array(F.lit(1.0), F.lit(2.0)))
    with pytest.raises(Exception, match="more than 1"):
        ops.count_below(df, "breaks", "bm", "n", 1).collect()


@pytest.mark.parametrize("length", [0, 1, 2, 3, 7, 8, 9, 100])
def test_binary_search_counts_breaks(spark, length):
    breaks = [float(2 * i) for i in range(length)]
    df = cross_section(spark, [x / 2 for x in range(-4, 4 * length + 4)]).withColumn(
        "breaks", F.array(*[F.lit(b) for b in breaks]).cast("array<double>")
    )
    for inclusive in (False, True):
        got = ops.count_below(df, "breaks", "bm", "n", length, inclusive).collect()
        for r in got:
            assert r.n == sum(b < r.bm or (inclusive and b == r.bm) for b in breaks)


def test_portfolios_are_balanced_and_size_sorts_agree(spark):
    sv, _ = random_market(seed=9)
    df = spark.createDataFrame(sv, SV_SCHEMA)
    counts = ops.assign_quantile(df, "bm", 3).groupBy("sorting_date", "portfolio").count()
    spread = counts.groupBy("sorting_date").agg((F.max("count") - F.min("count")).alias("d"))
    assert max(r.d for r in spread.collect()) <= 2
    one, two = ops.double_sort(df), ops.double_sort(df, dependent=True)
    keys = ["permno", "sorting_date", "portfolio_me"]
    assert one.select(*keys).exceptAll(two.select(*keys)).count() == 0


def test_dependent_sort_ranks_within_size(spark):
    sv, _ = random_market(seed=5)
    df = ops.double_sort(spark.createDataFrame(sv, SV_SCHEMA), dependent=True)
    groups = {}
    for r in df.collect():
        groups.setdefault((r.sorting_date, r.portfolio_me), []).append((r.bm, r.portfolio_bm))
    for members in groups.values():
        values = [v for v, _ in members]
        breaks = [linear_quantile(values, 1 / 3), linear_quantile(values, 2 / 3)]
        assert [p for _, p in members] == [1 + sum(b < v for b in breaks) for v in values]


def test_conditional_sort_pools_sizes(spark):
    sv, _ = random_market(seed=6)
    df = spark.createDataFrame(sv, SV_SCHEMA)
    pooled = ops.conditional_sort(df, 5, ["NYSE"])
    assert "portfolio_me" not in pooled.columns
    kept = ops.conditional_sort(df, 5, ["NYSE"], pool=False)
    for date in {row[3] for row in sv}:
        group = sorted(row for row in sv if row[3] == date)
        sizes = exchange_bins([r[4] for r in group if r[1] == "NYSE"], [r[4] for r in group], 3)
        rows = kept.filter(F.col("sorting_date") == date).orderBy("permno").collect()
        assert [r.portfolio_me for r in rows] == sizes


# returns and spreads

RETURN_DATE = dt.date(2000, 8, 1)


def vw_and_ew(spark, pairs):
    assigned = spark.createDataFrame(
        [(i, DATE, 1) for i in range(len(pairs))], "permno bigint, sorting_date date, portfolio int"
    )
    rets = spark.createDataFrame(
        [(i, DATE, RETURN_DATE, r, w) for i, (r, w) in enumerate(pairs)], RETURN_SCHEMA
    )
    rows = ops.portfolio_returns(assigned, rets, weight="both").collect()
    return {r.weighting: r.ret for r in rows}


def test_missing_return_keeps_its_weight(spark):
    got = vw_and_ew(spark, [(0.1, 1.0), (None, 1.0)])
    assert got == {"value": 0.05, "equal": 0.1}


def test_weights_missing_or_zero_give_null(spark):
    assert vw_and_ew(spark, [(0.1, None), (0.2, None)])["value"] is None
    assert vw_and_ew(spark, [(0.1, 1.0), (0.2, -1.0)])["value"] is None


def test_no_return_at_all_counts_as_zero_when_weighted(spark):
    assert vw_and_ew(spark, [(None, 1.0), (None, 2.0)]) == {"value": 0.0, "equal": None}


def test_single_weightings(spark):
    assigned = spark.createDataFrame([(1, DATE, 1)], "permno bigint, sorting_date date, portfolio int")
    rets = spark.createDataFrame([(1, DATE, RETURN_DATE, 0.3, 2.0)], RETURN_SCHEMA)
    for weight in ("value", "equal"):
        row = ops.portfolio_returns(assigned, rets, weight=weight).first()
        assert math.isclose(row.ret, 0.3)
    with pytest.raises(ValueError, match="weight"):
        ops.portfolio_returns(assigned, rets, weight="other")


def test_spread_uses_the_ends_that_are_present(spark):
    rows = [
        (dt.date(2000, 1, 1), 2, 0.01), (dt.date(2000, 1, 1), 4, 0.05),
        (dt.date(2000, 2, 1), 3, 0.02),
        (dt.date(2000, 3, 1), 1, 0.01), (dt.date(2000, 3, 1), 5, None),
    ]
    df = spark.createDataFrame(rows, "date date, portfolio int, ret double")
    got = [
        (r.value_premium, r.n_portfolios_present)
        for r in ops.high_minus_low(df).orderBy("date").collect()
    ]
    assert math.isclose(got[0][0], 0.04) and got[0][1] == 2
    assert got[1] == (0.0, 1)
    assert got[2] == (None, 2)


def test_ten_comes_after_two(spark):
    rows = [(dt.date(2000, 1, 1), p, float(p)) for p in (1, 2, 10)]
    df = spark.createDataFrame(rows, "date date, portfolio int, ret double")
    assert ops.high_minus_low(df).first().value_premium == 9.0


def test_size_neutral_mean_counts_sizes_equally(spark):
    rows = [(dt.date(2000, 1, 1), 1, m, r) for m, r in ((1, 0.0), (2, 0.3), (3, None))]
    df = spark.createDataFrame(rows, "date date, portfolio_bm int, portfolio_me int, ret double")
    assert math.isclose(ops.size_neutral(df).first().ret, 0.15)


def test_quantiles_read_once_and_write_nothing(spark):
    sv, _ = random_market(n_stocks=80, seed=11)
    df = stage(spark.createDataFrame(sv, SV_SCHEMA), "one-read")
    before = set(os.listdir(workspace_dir(spark)))
    found = bp.quantiles(df, "bm", [0.2, 0.5], ["sorting_date"], {"a": F.col("exchange") == "NYSE"})
    assert found.count() == 4
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        # the ranges are sorted in one exchange, which both uses of them read
        sort_merge = re.findall(r"SortMergeJoin", plan)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert set(os.listdir(workspace_dir(spark))) == before
    assert len(sort_merge) <= 1 and "MapIn" not in plan


def test_a_hot_group_is_split_into_ranges(spark):
    """One group holds nearly all rows: its values are sorted in many ranges, with the same result."""
    rng = random.Random(2)
    values = {dt.date(2000, 7, 1): [rng.random() for _ in range(20_000)], DATE.replace(year=2001): [1.0, 2.0, 4.0]}
    rows = [(i, "NYSE", "x", d, v, v) for d, vs in values.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, SV_SCHEMA)
    counts = bp.value_counts(df, ["sorting_date"], ["bm"], {"all": F.lit(True)})
    ordered = counts.select("_g", F.struct(F.xxhash64("_g").alias("g"), F.col("bm").alias("x")).alias("_o"))
    fences = ordered.select(bp._fences(ordered).alias("f")).limit(1).collect()[0].f
    assert bp.FENCES // 2 < len(fences) <= bp.FENCES
    probs = [0.0, 0.1, 1 / 3, 0.5, 0.999, 1.0]
    for row in bp.quantiles(df, "bm", probs, ["sorting_date"]).collect():
        expected = [linear_quantile(values[row.sorting_date], p) for p in probs]
        assert row.q == pytest.approx(expected, abs=1e-15)


def test_null_groups_and_empty_populations(spark):
    rows = [(1, "NYSE", "x", None, 1.0, 5.0), (2, "NYSE", "x", None, 2.0, 7.0), (3, "AMEX", "x", DATE, 3.0, 9.0)]
    df = spark.createDataFrame([*rows, (4, "NYSE", "x", DATE, 1.0, None)], SV_SCHEMA)
    found = bp.quantiles(df, "bm", [0.5], ["sorting_date"], {"n": F.col("exchange") == "NYSE", "all": F.lit(True)})
    got = {(r.sorting_date, r.population): r.q for r in found.collect()}
    assert got == {(None, "n"): [6.0], (None, "all"): [6.0], (DATE, "n"): None, (DATE, "all"): [9.0]}
