"""Small panels and plain-Python versions of the operators."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np

STOCK_SCHEMA = (
    "permno bigint, gvkey string, date date, exchange string, industry string, "
    "mktcap double, mktcap_lag double, ret_excess double"
)
SV_SCHEMA = (
    "permno bigint, exchange string, industry string, sorting_date date, me double, bm double"
)
RETURN_SCHEMA = (
    "permno bigint, sorting_date date, date date, ret_excess double, mktcap_lag double"
)


def month(year: int, m: int) -> dt.date:
    return dt.date(year + (m - 1) // 12, (m - 1) % 12 + 1, 1)


def random_market(n_stocks=60, years=(1988, 1989, 1990, 1991), seed=1, ties=False):
    """Sorting variables and returns as lists of tuples."""
    rng = random.Random(seed)
    sv, rets = [], []
    for permno in range(n_stocks):
        exchange = rng.choice(["NYSE", "NYSE", "NASDAQ", "AMEX"])
        industry = rng.choice(["Finance", "Other", "Other", "Other", None])
        for year in years:
            if rng.random() < 0.1:
                continue
            sort_date = dt.date(year, 7, 1)
            me = round(math.exp(rng.gauss(5, 1.5)), 3)
            bm = round(math.exp(rng.gauss(-0.3, 0.8)), 4)
            if ties:
                me, bm = round(me, -2), round(bm * 3) / 3
            sv.append((permno, exchange, industry, sort_date, me, bm))
            for k in range(12):
                ret = None if rng.random() < 0.02 else rng.gauss(0.01 + 0.002 * bm, 0.08)
                weight = None if rng.random() < 0.02 else me * math.exp(rng.gauss(0, 0.2))
                rets.append((permno, sort_date, month(year, 7 + k), ret, weight))
    return sv, rets


def linear_quantile(values, p):
    values = sorted(values)
    position = (len(values) - 1) * p
    low, high = values[math.floor(position)], values[math.ceil(position)]
    return low + (position - math.floor(position)) * (high - low)


def exchange_bins(members, everyone, n):
    """Bins [a, b) of ``everyone`` from the quantiles of ``members``; None if impossible."""
    if not members:
        return [None] * len(everyone)
    breaks = sorted({linear_quantile(members, i / n) for i in range(n + 1)})
    if len(breaks) < 2:
        return [None] * len(everyone)
    return [1 + sum(b <= x for b in breaks[1:-1]) for x in everyone]


def spec_premium(sv, rets, n, exchanges, value_weighted, dependent):
    """Monthly premium of one specification, stock by stock: {date: premium}."""
    portfolio = {}
    for date in sorted({row[3] for row in sv}):
        group = [row for row in sv if row[3] == date]

        def split(rows, column, bins):
            members = [r[column] for r in rows if r[1] in exchanges]
            return exchange_bins(members, [r[column] for r in rows], bins)

        parts = [group]
        if dependent:
            sizes = split(group, 4, 3)
            parts = [[r for r, s in zip(group, sizes) if s == k] for k in (1, 2, 3)]
        for part in parts:
            for row, number in zip(part, split(part, 5, n)):
                if number is not None:
                    portfolio[row[0], date] = number
    cells = {}
    for permno, sort_date, date, ret, weight in rets:
        if (permno, sort_date) in portfolio:
            cells.setdefault((date, portfolio[permno, sort_date]), []).append((ret, weight))
    by_date = {}
    for (date, number), rows in cells.items():
        if value_weighted:
            total = sum(w for _, w in rows if w is not None)
            top = sum(r * w for r, w in rows if r is not None and w is not None)
            value = top / total if total else None
        else:
            known = [r for r, _ in rows if r is not None]
            value = sum(known) / len(known) if known else None
        by_date.setdefault(date, {})[number] = value
    premium = {}
    for date, values in by_date.items():
        high, low = values[max(values)], values[min(values)]
        premium[date] = None if high is None or low is None else high - low
    return premium


def ols_newey_west(y, x=None, lag=3):
    """Intercept and t-statistic by matrix algebra, with the factor n / (n - k)."""
    y = np.asarray(y, dtype=float)
    design = np.ones((len(y), 1)) if x is None else np.column_stack([np.ones(len(y)), x])
    bread = np.linalg.inv(design.T @ design)
    beta = bread @ design.T @ y
    scores = design * (y - design @ beta)[:, None]
    meat = scores.T @ scores
    for k in range(1, lag + 1):
        gamma = scores[k:].T @ scores[:-k]
        meat += (1 - k / (lag + 1)) * (gamma + gamma.T)
    n, k = design.shape
    cov = bread @ meat @ bread * n / (n - k)
    return beta[0], beta[0] / math.sqrt(cov[0, 0])
