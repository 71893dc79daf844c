from __future__ import annotations

import datetime as dt
import itertools
import math

import pytest
from pyspark.sql import functions as F

from factorloom import plans
from factorloom.operators import returns as ret_ops

from .helpers import RETURN_SCHEMA, SV_SCHEMA, ols_newey_west, random_market, spec_premium

SPLIT = dt.date(1990, 7, 1)
FACTOR_SCHEMA = "date date, mkt_excess double, hml double"


def market(spark, **options):
    sv, rets = random_market(**options)
    factors = [
        (d, 0.01 * math.sin(i), 0.003 * math.cos(i))
        for i, d in enumerate(sorted({r[2] for r in rets})[:-2])
    ]
    frames = (
        spark.createDataFrame(sv, SV_SCHEMA).repartition(3),
        spark.createDataFrame(rets, RETURN_SCHEMA).repartition(5),
        spark.createDataFrame(factors, FACTOR_SCHEMA),
    )
    return sv, rets, {d: x for d, x, _ in factors}, frames


def samples(sv):
    return [
        sv,
        [r for r in sv if r[2] is not None and r[2] != "Finance"],
        [r for r in sv if r[3] < SPLIT],
        [r for r in sv if r[3] >= SPLIT],
    ]


@pytest.mark.parametrize("ties", [False, True])
def test_grid_equals_one_specification_at_a_time(spark, ties):
    sv, rets, mkt, frames = market(spark, seed=11, ties=ties)
    rows = plans.run_grid(*frames).collect()
    assert len(rows) == 192
    got = {(r.spec_id, r.test): r for r in rows}
    options = itertools.product(
        [2, 5, 10], [("NYSE",), ("NYSE", "NASDAQ", "AMEX")], [True, False], [True, False], samples(sv)
    )
    for i, (n, exchanges, weighted, dependent, sample) in enumerate(options):
        premium = spec_premium(sample, rets, n, exchanges, weighted, dependent)
        dates = sorted(d for d, v in premium.items() if v is not None)
        row = got[i, "Newey-West"]
        assert (row.n_portfolios, row.weighting, row.dependent) == (
            n, "value" if weighted else "equal", dependent,
        )
        assert row.n_obs == len(dates)
        if not dates:
            assert row.estimate is None and got[i, "CAPM-alpha"].estimate is None
            continue
        estimate, t = ols_newey_west([premium[d] for d in dates])
        assert math.isclose(row.estimate, estimate, rel_tol=1e-9, abs_tol=1e-12), row
        assert math.isclose(row.t_stat, t, rel_tol=1e-7), row
        known = [d for d in dates if d in mkt]
        row = got[i, "CAPM-alpha"]
        assert row.n_obs == len(known)
        estimate, t = ols_newey_west([premium[d] for d in known], [mkt[d] for d in known])
        assert math.isclose(row.estimate, estimate, rel_tol=1e-9, abs_tol=1e-12), row
        assert math.isclose(row.t_stat, t, rel_tol=1e-7), row


def test_full_sample_is_the_weighted_mean_of_its_halves(spark):
    _, _, _, frames = market(spark, seed=12)
    rows = [r for r in plans.run_grid(*frames).collect() if r.test == "Newey-West"]
    by_spec = {r.spec_id: r for r in rows}
    for first in range(0, 96, 4):
        full, before, after = (by_spec[first + k] for k in (0, 2, 3))
        share = before.n_obs / full.n_obs
        mixed = share * before.estimate + (1 - share) * after.estimate
        assert math.isclose(full.estimate, mixed, abs_tol=1e-12)


def test_scaling_weights_and_shuffling_rows_change_nothing(spark):
    _, _, _, (sv, rets, factors) = market(spark, seed=13)
    axes = plans.GridAxes(n_portfolios=(5,), samples=(plans.Sample("full"),))
    plain = plans.run_grid(sv, rets, factors, axes).orderBy("spec_id", "_order").collect()
    scaled = plans.run_grid(
        sv.withColumn("me", F.col("me") * 1024).repartition(6),
        rets.withColumn("mktcap_lag", F.col("mktcap_lag") * 1024).orderBy(F.rand(3)),
        factors,
        axes,
    )
    for a, b in zip(plain, scaled.orderBy("spec_id", "_order").collect()):
        assert math.isclose(a.estimate, b.estimate, abs_tol=1e-13)


def test_one_portfolio_has_no_premium(spark):
    _, _, _, frames = market(spark, seed=14, n_stocks=20)
    axes = plans.GridAxes(n_portfolios=(1,))
    rows = plans.run_grid(*frames, axes).collect()
    assert {r.estimate for r in rows if r.test == "Newey-West"} == {0.0}


def test_specifications_without_breaks_are_kept_as_null(spark):
    sv, rets, _, (_, ret_frame, factors) = market(spark, seed=15, n_stocks=12)
    without = [(p, "AMEX", i, d, m, b) for p, _, i, d, m, b in sv]
    rows = plans.run_grid(spark.createDataFrame(without, SV_SCHEMA), ret_frame, factors).collect()
    assert len(rows) == 192
    assert {r.estimate for r in rows if r.universe == "NYSE"} == {None}
    assert all(r.estimate is not None for r in rows if r.universe == "ALL" and r.sample == "full"
               and not r.dependent)


def test_other_axes(spark):
    sv, rets, _, frames = market(spark, seed=16)
    axes = plans.GridAxes(
        n_portfolios=(3, 4),
        universes={"NMS": ("NYSE", "NASDAQ")},
        weightings=("equal",),
        dependent=(False,),
        samples=(plans.Sample("early", end=dt.date(1989, 7, 1)), plans.Sample("no other", "Other")),
    )
    rows = {r.spec_id: r for r in plans.run_grid(*frames, axes).collect() if r.test == "Newey-West"}
    assert len(rows) == 4
    chosen = [
        [r for r in sv if r[3] < dt.date(1989, 7, 1)],
        [r for r in sv if r[2] is not None and r[2] != "Other"],
    ]
    for i, (n, sample) in enumerate(itertools.product((3, 4), chosen)):
        premium = spec_premium(sample, rets, n, ("NYSE", "NASDAQ"), False, False)
        known = [v for v in premium.values() if v is not None]
        assert math.isclose(rows[i].estimate, sum(known) / len(known), abs_tol=1e-12)


def test_specification_order(spark):
    specs = plans.spec_grid(spark, plans.GridAxes()).orderBy("spec_id").collect()
    assert [r.spec_id for r in specs] == list(range(96))
    default = specs[52]
    assert (default.n_portfolios, default.universe, default.weighting) == (5, "ALL", "value")
    assert (default.dependent, default.sample) == (False, "full")
    assert [r.sample for r in specs[:5]] == [
        "full", "no_finance", "before_split", "from_split", "full",
    ]


def test_comparison_equals_the_two_designs_one_by_one(spark):
    from factorloom import operators as ops

    _, _, _, (sv, rets, factors) = market(spark, seed=17)
    got = {r.design: r.value_premium for r in plans.premium_comparison(sv, rets, factors).collect()}
    for design, dependent in (("Independent", False), ("Dependent", True)):
        cells = ops.portfolio_returns(
            ops.double_sort(sv, dependent=dependent), rets, ["portfolio_bm", "portfolio_me"]
        )
        spread = ops.high_minus_low(ops.size_neutral(cells), "portfolio_bm")
        assert math.isclose(got[design], ops.mean_premium(spread).first()[0], abs_tol=1e-13)
    assert math.isclose(got["Published HML"], factors.agg(F.avg("hml")).first()[0])


def test_sums_of_cells_add_up(spark):
    _, _, _, (sv, rets, _) = market(spark, seed=18)
    fine = ret_ops.cell_sums(sv, rets, ["exchange", "industry"])
    coarse = ret_ops.returns_from_sums(fine, ["date", "exchange"]).orderBy("date", "exchange")
    direct = ret_ops.returns_from_sums(
        ret_ops.cell_sums(sv, rets, ["exchange"]), ["date", "exchange"]
    ).orderBy("date", "exchange")
    for a, b in zip(coarse.collect(), direct.collect()):
        assert math.isclose(a.ret_vw, b.ret_vw) and math.isclose(a.ret_ew, b.ret_ew)


def results(spark):
    rows = [
        (0, "Newey-West", 2, "NYSE", 0.0004, 1.0), (1, "Newey-West", 2, "ALL", 0.0005, 2.5),
        (2, "Newey-West", 5, "NYSE", 0.00051, 1.96), (3, "Newey-West", 5, "ALL", -0.0012, -3.0),
        (0, "CAPM-alpha", 2, "NYSE", 0.0061, 2.0), (1, "CAPM-alpha", 2, "ALL", None, None),
    ]
    return spark.createDataFrame(
        rows, "spec_id int, test string, n_portfolios int, universe string, estimate double, t_stat double"
    )


def test_histogram_bins_are_centred_and_closed_on_the_right(spark):
    rows = plans.estimate_histogram(results(spark)).collect()
    got = {(r.test, r.bin, r.is_significant): r.n_specs for r in rows}
    assert got == {
        ("Newey-West", 0, False): 1,
        ("Newey-West", 0, True): 1,
        ("Newey-West", 1, True): 1,
        ("Newey-West", -1, True): 1,
        ("CAPM-alpha", 6, True): 1,
    }
    assert {r.bin: round(r.bin_centre, 9) for r in rows} == {0: 0.0, 1: 0.001, -1: -0.001, 6: 0.006}


def test_summary_by_axis(spark):
    rows = plans.grid_summary(results(spark), axes=("n_portfolios", "universe")).collect()
    got = {(r.test, r.axis, r.option): r for r in rows}
    everything = got["Newey-West", "all", "all"]
    assert (everything.n_specs, everything.n_significant, everything.n_positive) == (4, 3, 3)
    assert math.isclose(everything.median_estimate, 0.00045)
    assert got["Newey-West", "universe", "ALL"].min_estimate == -0.0012
    alpha = got["CAPM-alpha", "n_portfolios", "2"]
    assert (alpha.n_specs, alpha.n_estimates) == (2, 1)


def test_reference_lines(spark):
    _, _, mkt, (_, _, factors) = market(spark, seed=19)
    got = {r.test: r.reference for r in plans.reference_lines(factors).collect()}
    rows = factors.orderBy("date").collect()
    alpha, _ = ols_newey_west([r.hml for r in rows], [r.mkt_excess for r in rows])
    assert math.isclose(got["CAPM-alpha"], alpha, rel_tol=1e-9)
    assert math.isclose(got["Newey-West"], sum(r.hml for r in rows) / len(rows), rel_tol=1e-9)


def test_one_specification_equals_its_row_of_the_grid(spark):
    _, _, _, frames = market(spark, seed=20)
    whole = {(r.spec_id, r.test): r for r in plans.run_grid(*frames).collect()}
    for spec_id, options in (
        (52, {}),
        (0, {"n_portfolios": 2, "exchanges": ["NYSE"], "dependent_sort": True}),
    ):
        rows = plans.value_premium(*frames, **options).orderBy("_order").collect()
        assert [r.test for r in rows] == ["Newey-West", "CAPM-alpha"]
        for r in rows:
            assert math.isclose(r.estimate, whole[spec_id, r.test].estimate, abs_tol=1e-13)
            assert math.isclose(r.t_stat, whole[spec_id, r.test].t_stat, rel_tol=1e-8)


def test_shuffled_joins_give_the_same_grid(spark):
    _, _, _, (sv, rets, factors) = market(spark, seed=22, n_stocks=30, years=(1989, 1990))
    axes = plans.GridAxes(n_portfolios=(3,), weightings=("value",), samples=(plans.Sample("full"),))

    def run():
        rows = plans.run_grid(sv, rets, factors, axes).collect()
        return {(r.spec_id, r.test): r for r in rows}

    usual = run()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        shuffled = run()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert usual.keys() == shuffled.keys()
    for key, row in usual.items():
        assert row.n_obs == shuffled[key].n_obs
        assert row.estimate is None or math.isclose(
            row.estimate, shuffled[key].estimate, abs_tol=1e-13
        )
