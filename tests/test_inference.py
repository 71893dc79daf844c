from __future__ import annotations

import contextlib
import datetime as dt
import io
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom import operators as ops
from factorloom.operators import inference

from .helpers import month, ols_newey_west

SCHEMA = "series int, date date, value_premium double, mkt_excess double"


def series(seed=7, length=60):
    rng = random.Random(seed)
    rows = []
    for s in range(3):
        shock = 0.0
        for t in range(length):
            shock = 0.4 * shock + rng.gauss(0, 0.03)
            x = rng.gauss(0.005, 0.04)
            rows.append((s, month(1990, 1 + t), 0.004 + 0.3 * s * x + shock, x))
    return rows


def test_mean_test_equals_matrix_formula(spark):
    rows = series()
    rows[70] = (rows[70][0], rows[70][1], None, rows[70][3])
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r.series: r for r in ops.newey_west_mean(df, by=["series"]).collect()}
    for s in range(3):
        y = [r[2] for r in rows if r[0] == s and r[2] is not None]
        estimate, t = ols_newey_west(y)
        assert math.isclose(got[s].estimate, estimate, rel_tol=1e-10)
        assert math.isclose(got[s].t_stat, t, rel_tol=1e-9)
        assert got[s].n_obs == len(y)


@pytest.mark.parametrize("lag", [0, 1, 3, 6])
def test_alpha_equals_sandwich_matrix(spark, lag):
    rows = series(8)
    rows[3] = (*rows[3][:3], None)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r.series: r for r in ops.capm_alpha(df, by=["series"], lag=lag).collect()}
    for s in range(3):
        kept = [r for r in rows if r[0] == s and r[3] is not None]
        estimate, t = ols_newey_west([r[2] for r in kept], [r[3] for r in kept], lag)
        assert math.isclose(got[s].estimate, estimate, rel_tol=1e-10)
        assert math.isclose(got[s].t_stat, t, rel_tol=1e-9)


def test_without_small_sample_factor(spark):
    df = spark.createDataFrame(series(), SCHEMA)
    plain = {r.series: r.t_stat for r in ops.newey_west_mean(df, by=["series"], small_sample="none").collect()}
    scaled = {r.series: r.t_stat for r in ops.newey_west_mean(df, by=["series"]).collect()}
    for s in plain:
        assert math.isclose(plain[s], scaled[s] * math.sqrt(60 / 59), rel_tol=1e-12)
    with pytest.raises(ValueError, match="small_sample"):
        ops.newey_west_mean(df, small_sample="other")


def test_one_series_without_key(spark):
    rows = [r for r in series() if r[0] == 1]
    df = spark.createDataFrame(rows, SCHEMA)
    got = ops.capm_alpha(df).collect()
    estimate, t = ols_newey_west([r[2] for r in rows], [r[3] for r in rows])
    assert len(got) == 1
    assert math.isclose(got[0].estimate, estimate, rel_tol=1e-10)
    assert math.isclose(got[0].t_stat, t, rel_tol=1e-9)


@pytest.mark.parametrize("lag", [0, 1, 3, 6])
def test_lags_reach_over_blocks(spark, monkeypatch, lag):
    """Blocks of few rows, some with fewer than ``lag``, give what the whole series gives."""
    monkeypatch.setattr(inference, "BLOCK_ROWS", 4)
    rows = [r for i, r in enumerate(series(9)) if i % 7 not in (2, 3, 4) or i % 2]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    means = {r.series: r for r in ops.newey_west_mean(df, by=["series"], lag=lag).collect()}
    alphas = {r.series: r for r in ops.capm_alpha(df, by=["series"], lag=lag).collect()}
    for s in range(3):
        kept = [r for r in rows if r[0] == s]
        y, x = [r[2] for r in kept], [r[3] for r in kept]
        for got, (estimate, t) in (
            (means[s], ols_newey_west(y, lag=lag)),
            (alphas[s], ols_newey_west(y, x, lag)),
        ):
            assert math.isclose(got.estimate, estimate, rel_tol=1e-10)
            assert math.isclose(got.t_stat, t, rel_tol=1e-9)
            assert got.n_obs == len(kept)


def test_a_long_series_is_spread_over_tasks(spark):
    n = 1_000_000
    t = F.col("id").cast("double")
    df = spark.range(n).select(
        "id", (F.sin(t / 50) + F.cos(t * t)).alias("y"), F.sin(t / 3).alias("x")
    )
    ids = np.arange(n, dtype=float)
    y, x = np.sin(ids / 50) + np.cos(ids * ids), np.sin(ids / 3)
    for found, expected in (
        (ops.newey_west_mean(df, "y", order="id"), ols_newey_west(y)),
        (ops.capm_alpha(df, "y", "x", order="id"), ols_newey_west(y, x)),
    ):
        (got,) = found.collect()
        assert got.n_obs == n
        assert math.isclose(got.estimate, expected[0], rel_tol=1e-6)
        assert math.isclose(got.t_stat, expected[1], rel_tol=1e-6)
        printed = io.StringIO()
        with contextlib.redirect_stdout(printed):
            found.explain("formatted")
        assert re.search(r"hashpartitioning\(_block", printed.getvalue())


def test_other_orders_and_no_rows(spark):
    df = spark.createDataFrame([(f"{i:03}", math.sin(i)) for i in range(40)], "name string, y double")
    (got,) = ops.newey_west_mean(df, "y", order="name").collect()
    estimate, t = ols_newey_west([math.sin(i) for i in range(40)])
    assert math.isclose(got.estimate, estimate, rel_tol=1e-10)
    assert math.isclose(got.t_stat, t, rel_tol=1e-9)
    (none,) = ops.newey_west_mean(df.filter("y > 2"), "y", order="name").collect()
    assert (none.estimate, none.t_stat, none.n_obs) == (None, None, 0)


def test_short_or_constant_series(spark):
    rows = [(0, month(1990, 1), 0.5, 0.5)] + [(1, month(1990, m), 0.0, 0.5) for m in range(1, 9)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.series: r for r in ops.newey_west_mean(df, by=["series"]).collect()}
    assert got[0].estimate == 0.5 and got[0].t_stat is None
    assert got[1].estimate == 0.0 and got[1].t_stat is None
    alpha = {r.series: r for r in ops.capm_alpha(df, by=["series"]).collect()}
    assert alpha[1].estimate is None and alpha[1].t_stat is None


def test_gaps_are_counted(spark):
    rows = [(0, month(1990, m), 0.1, 0.1) for m in (1, 2, 5)] + [(1, dt.date(1990, 1, 1), 0.1, 0.1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.series: (r.n_months, r.n_missing) for r in ops.gap_check(df, by=["series"]).collect()}
    assert got == {0: (3, 2), 1: (1, 0)}


def test_significance_is_two_sided_and_inclusive(spark):
    df = spark.createDataFrame([(1.96,), (-2.0,), (1.9599,), (None,)], "t_stat double")
    assert [r.is_significant for r in ops.flag_significant(df).collect()] == [True, True, False, None]
