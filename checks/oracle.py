"""The registered queries as SQL over the raw tables."""

from __future__ import annotations

from .edges import planted_sql

SPLIT = "DATE '1999-07-01'"



def _at_ranks(v: str, probs: str) -> str:
    """Quantiles of a sorted list at linearly interpolated ranks."""
    rank = f"(len({v}) - 1) * p"
    low, high = (f"{v}[CAST({f}({rank}) AS INT) + 1]" for f in ("floor", "ceil"))
    value = f"{low} + ({rank} - floor({rank})) * ({high} - {low})"
    return f"CASE WHEN {v} IS NOT NULL THEN list_transform({probs}, lambda p: {value}) END"


THIRDS, TENTHS = "[1/3, 2/3]", f"[{', '.join(f'{i}/10' for i in range(11))}]"

BASE = """
sm AS (
  SELECT l_suppkey AS permno, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
         sum(l_extendedprice) AS mktcap, avg(l_discount) - avg(l_tax) AS ret_excess
  FROM lineitem WHERE l_suppkey IS NOT NULL AND l_shipdate IS NOT NULL GROUP BY 1, 2),
listing AS (
  SELECT s_suppkey AS permno,
         CASE WHEN n_regionkey <= 1 THEN 'NYSE' WHEN n_regionkey <= 3 THEN 'NASDAQ'
              WHEN n_regionkey = 4 THEN 'AMEX' END AS exchange,
         CASE WHEN n_nationkey < 5 THEN 'Finance' ELSE 'Other' END AS industry
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey),
panel AS (
  SELECT permno, 'G' || permno AS gvkey, date, exchange, industry, mktcap,
         lag(mktcap) OVER (PARTITION BY permno ORDER BY date) AS mktcap_lag, ret_excess
  FROM sm LEFT JOIN listing USING (permno)),
fundamentals AS (
  SELECT 'G' || l_suppkey AS gvkey, make_date(CAST(year(l_shipdate) AS INT), 12, 31) AS datadate,
         sum(l_quantity) * 1000 AS be
  FROM lineitem WHERE l_suppkey IS NOT NULL AND l_shipdate IS NOT NULL GROUP BY 1, 2),
factors AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
         avg(l_discount) - avg(l_tax) AS mkt_excess,
         avg(l_discount) FILTER (WHERE l_returnflag = 'R')
           - avg(l_discount) FILTER (WHERE l_returnflag = 'A') AS hml
  FROM lineitem
  WHERE l_suppkey IS NOT NULL AND year(l_shipdate) BETWEEN 1995 AND 2001 GROUP BY 1),
size AS (
  SELECT permno, exchange, industry, CAST(date + INTERVAL 1 MONTH AS DATE) AS sorting_date,
         mktcap AS me
  FROM panel WHERE month(date) = 6),
december AS (
  SELECT permno, gvkey, CAST(date + INTERVAL 7 MONTH AS DATE) AS sorting_date, mktcap AS me_dec
  FROM panel WHERE month(date) = 12),
btm AS (
  SELECT permno, sorting_date, be / nullif(me_dec, 0) AS bm, datadate, gvkey
  FROM (SELECT *, make_date(CAST(year(datadate) + 1 AS INT), 7, 1) AS sorting_date
        FROM fundamentals) JOIN december USING (gvkey, sorting_date)),
sv AS (
  SELECT permno, exchange, industry, sorting_date, me, bm
  FROM (SELECT *, row_number() OVER (PARTITION BY permno, sorting_date
                                     ORDER BY datadate DESC, gvkey DESC) AS rn
        FROM size JOIN btm USING (permno, sorting_date)
        WHERE me IS NOT NULL AND bm IS NOT NULL)
  WHERE rn = 1),
rets AS (
  SELECT permno, date, ret_excess, mktcap_lag,
         CASE WHEN month(date) >= 7 THEN make_date(CAST(year(date) AS INT), 7, 1)
              ELSE make_date(CAST(year(date) - 1 AS INT), 7, 1) END AS sorting_date
  FROM panel)"""

# (a, b] terciles from all stocks
DOUBLE = f"""
qs AS (
  SELECT sorting_date, {_at_ranks('vme', THIRDS)} AS qme, {_at_ranks('vbm', THIRDS)} AS qbm
  FROM (SELECT sorting_date, list_sort(list(me)) AS vme, list_sort(list(bm)) AS vbm
        FROM sv GROUP BY 1)),
ind AS (
  SELECT sv.*,
         1 + (me > qme[1])::INT + (me > qme[2] AND qme[2] <> qme[1])::INT AS portfolio_me,
         1 + (bm > qbm[1])::INT + (bm > qbm[2] AND qbm[2] <> qbm[1])::INT AS portfolio_bm
  FROM sv JOIN qs USING (sorting_date)),
qd AS (
  SELECT sorting_date, portfolio_me, {_at_ranks('v', THIRDS)} AS qbm
  FROM (SELECT sorting_date, portfolio_me, list_sort(list(bm)) AS v FROM ind GROUP BY 1, 2)),
dep AS (
  SELECT permno, exchange, industry, sorting_date, me, bm, portfolio_me,
         1 + (bm > q.qbm[1])::INT + (bm > q.qbm[2] AND q.qbm[2] <> q.qbm[1])::INT AS portfolio_bm
  FROM ind JOIN qd q USING (sorting_date, portfolio_me)),
both_sorts AS (
  SELECT 'Independent' AS design, permno, sorting_date, portfolio_me, portfolio_bm FROM ind
  UNION ALL
  SELECT 'Dependent', permno, sorting_date, portfolio_me, portfolio_bm FROM dep),
vw AS (
  SELECT design, date, portfolio_bm, portfolio_me,
         coalesce(sum(ret_excess * mktcap_lag), 0) / nullif(sum(mktcap_lag), 0) AS ret
  FROM both_sorts JOIN rets USING (permno, sorting_date) GROUP BY ALL),
neutral AS (
  SELECT design, date, portfolio_bm, avg(ret) AS ret FROM vw GROUP BY ALL),
ends AS (
  SELECT *, max(portfolio_bm) OVER (PARTITION BY design, date) AS hi,
            min(portfolio_bm) OVER (PARTITION BY design, date) AS lo FROM neutral),
premium AS (
  SELECT design, date, avg(ret) FILTER (WHERE portfolio_bm = hi)
                       - avg(ret) FILTER (WHERE portfolio_bm = lo) AS value_premium,
         count(*) AS n_portfolios_present
  FROM ends GROUP BY ALL)"""

# [a, b) bins from exchange quantiles, every assignment of the grid one by one
GRID = f"""
pops AS (
  SELECT * FROM (VALUES ('NYSE', 'NYSE', false), ('NYSE without Finance', 'NYSE', true),
                        ('ALL', 'ALL', false), ('ALL without Finance', 'ALL', true))
    t(population, universe, no_finance)),
stock AS (
  SELECT sv.*, population,
         CASE universe WHEN 'NYSE' THEN exchange = 'NYSE'
                       ELSE exchange IN ('NYSE', 'NASDAQ', 'AMEX') END AS member
  FROM sv JOIN pops ON NOT no_finance OR industry <> 'Finance'),
me_q AS (
  SELECT sorting_date, population,
         list_sort(list_distinct({_at_ranks('v', '[0, 1/3, 2/3, 1]')})) AS q
  FROM (SELECT sorting_date, population, list_sort(list(me) FILTER (WHERE member)) AS v
        FROM stock GROUP BY 1, 2)),
sized AS (
  SELECT stock.*, CASE WHEN len(q) >= 2
      THEN 1 + len(list_filter(q[2:len(q) - 1], lambda b: b <= me)) END AS size_id
  FROM stock LEFT JOIN me_q USING (sorting_date, population)),
keyed AS (
  SELECT *, false AS dependent, 0 AS grp FROM sized
  UNION ALL
  SELECT *, true, size_id FROM sized WHERE size_id IS NOT NULL),
tenths AS (
  SELECT sorting_date, population, dependent, grp, {_at_ranks('v', TENTHS)} AS q
  FROM (SELECT sorting_date, population, dependent, grp,
               list_sort(list(bm) FILTER (WHERE member)) AS v
        FROM keyed GROUP BY ALL)),
bm_q AS (
  SELECT sorting_date, population, dependent, grp, n_portfolios,
         list_sort(list_distinct(CASE n_portfolios WHEN 2 THEN [q[1], q[6], q[11]]
           WHEN 5 THEN [q[1], q[3], q[5], q[7], q[9], q[11]] ELSE q END)) AS q
  FROM tenths, (VALUES (2), (5), (10)) t(n_portfolios) WHERE q IS NOT NULL),
assigned AS (
  SELECT permno, sorting_date, population, dependent, n_portfolios, size_id,
         CAST(1 + len(list_filter(q[2:len(q) - 1], lambda b: b <= bm)) AS INT) AS portfolio
  FROM keyed JOIN bm_q USING (sorting_date, population, dependent, grp) WHERE len(q) >= 2),
both_weights AS (
  SELECT population, n_portfolios, dependent, sorting_date, date, portfolio,
         coalesce(sum(ret_excess * mktcap_lag), 0) / nullif(sum(mktcap_lag), 0) AS vw,
         avg(ret_excess) AS ew
  FROM assigned JOIN rets USING (permno, sorting_date) GROUP BY ALL),
grid_rets AS (
  SELECT * EXCLUDE (vw, ew), 'value' AS weighting, vw AS ret FROM both_weights
  UNION ALL
  SELECT * EXCLUDE (vw, ew), 'equal', ew FROM both_weights),
grid_ends AS (
  SELECT *, max(portfolio) OVER w AS hi, min(portfolio) OVER w AS lo FROM grid_rets
  WINDOW w AS (PARTITION BY population, n_portfolios, dependent, weighting, date)),
series AS (
  SELECT population, n_portfolios, dependent, weighting, sorting_date, date,
         avg(ret) FILTER (WHERE portfolio = hi) - avg(ret) FILTER (WHERE portfolio = lo)
           AS value_premium, count(*) AS n_portfolios_present
  FROM grid_ends GROUP BY ALL)"""

SPECS = f"""
specs AS (
  SELECT CAST((((ni * 2 + ei) * 2 + wi) * 2 + di) * 4 + si AS INT) AS spec_id, *
  FROM (VALUES (0, 2), (1, 5), (2, 10)) a(ni, n_portfolios),
       (VALUES (0, 'NYSE'), (1, 'ALL')) b(ei, universe),
       (VALUES (0, 'value'), (1, 'equal')) c(wi, weighting),
       (VALUES (0, true), (1, false)) d(di, dependent),
       (VALUES (0, 'full', '', DATE '0001-01-01', DATE '9999-01-01'),
               (1, 'no_finance', ' without Finance', DATE '0001-01-01', DATE '9999-01-01'),
               (2, 'before_split', '', DATE '0001-01-01', {SPLIT}),
               (3, 'from_split', '', {SPLIT}, DATE '9999-01-01'))
         e(si, sample, suffix, lo_date, hi_date)),
months AS (
  SELECT spec_id, date, value_premium AS y
  FROM specs JOIN series ON series.population = universe || suffix
    AND series.n_portfolios = specs.n_portfolios AND series.dependent = specs.dependent
    AND series.weighting = specs.weighting
    AND sorting_date >= lo_date AND sorting_date < hi_date
  WHERE value_premium IS NOT NULL)"""


def nw(source: str, key: str, name: str, lags: int = 3, correct: bool = True) -> str:
    """Mean test of column y per key."""
    lagged = "".join(f", lag(u, {i}) OVER w AS u{i}" for i in range(1, lags + 1))
    cross = " + ".join(
        f"{1 - i / (lags + 1)} * coalesce(sum(u * u{i}), 0)" for i in range(1, lags + 1)
    )
    factor = " * count(*) / nullif(count(*) - 1, 0)" if correct else ""
    return f"""
{name}_u AS (
  SELECT {key}, date, y, y - avg(y) OVER (PARTITION BY {key}) AS u FROM {source}),
{name}_l AS (
  SELECT *{lagged} FROM {name}_u WINDOW w AS (PARTITION BY {key} ORDER BY date)),
{name} AS (
  SELECT {key}, avg(y) AS estimate, count(*) AS n_obs,
         avg(y) / nullif(sqrt(greatest(sum(u * u) + 2 * ({cross or 0}), 0){factor}) / count(*), 0)
           AS t_stat
  FROM {name}_l GROUP BY {key})"""


def capm(source: str, key: str, name: str, lags: int = 3, correct: bool = True) -> str:
    """Intercept of y on x per key with the two-by-two sandwich matrix."""
    cross = "".join(
        f" + {1 - i / (lags + 1)} * coalesce(sum({{a}} * {{b}}{i} + {{b}} * {{a}}{i}), 0)"
        for i in range(1, lags + 1)
    )
    m00, m01, m11 = (
        f"sum({a} * {b})" + cross.format(a=a, b=b)
        for a, b in (("u", "u"), ("u", "v"), ("v", "v"))
    )
    lagged = "".join(f", lag({c}, {i}) OVER w AS {c}{i}" for c in "uv" for i in range(1, lags + 1))
    factor = " * n / nullif(n - 2, 0)" if correct else ""
    return f"""
{name}_b AS (
  SELECT {key}, regr_intercept(y, x) AS alpha, regr_slope(y, x) AS beta, count(*) AS n,
         sum(x) AS sx, sum(x * x) AS sxx
  FROM {source} WHERE y IS NOT NULL AND x IS NOT NULL GROUP BY {key}),
{name}_u AS (
  SELECT {key}, date, y - alpha - beta * x AS u, (y - alpha - beta * x) * x AS v
  FROM {source} JOIN {name}_b USING ({key}) WHERE y IS NOT NULL AND x IS NOT NULL),
{name}_l AS (
  SELECT *{lagged} FROM {name}_u WINDOW w AS (PARTITION BY {key} ORDER BY date)),
{name}_m AS (
  SELECT {key}, {m00} AS m00, {m01} AS m01, {m11} AS m11 FROM {name}_l GROUP BY {key}),
{name} AS (
  SELECT {key}, alpha AS estimate, n AS n_obs,
         alpha / nullif(sqrt(greatest(sxx * sxx * m00 - 2 * sxx * sx * m01 + sx * sx * m11, 0)
           {factor}) / abs(n * sxx - sx * sx), 0) AS t_stat
  FROM {name}_b JOIN {name}_m USING ({key}))"""


RESULTS = (
    nw("months", "spec_id", "nwt")
    + ",\nmonths_x AS (SELECT spec_id, date, y, mkt_excess AS x FROM months LEFT JOIN factors USING (date)),"
    + capm("months_x", "spec_id", "capmt")
    + """,
grid_results AS (
  SELECT spec_id, n_portfolios, universe, weighting, dependent, sample, test, estimate, t_stat,
         coalesce(n_obs, 0) AS n_obs
  FROM specs CROSS JOIN (VALUES ('Newey-West'), ('CAPM-alpha')) t(test)
  LEFT JOIN (SELECT 'Newey-West' AS test, spec_id, estimate, t_stat, n_obs FROM nwt
             UNION ALL
             SELECT 'CAPM-alpha', spec_id, estimate, t_stat, n_obs FROM capmt) r
  USING (spec_id, test))"""
)

# one sample by a predicate, five portfolios, all listed stocks, no lags and no correction
CUSTOM = (
    GRID.replace("FROM sv JOIN pops", "FROM (FROM sv WHERE exchange <> 'AMEX') sv JOIN pops")
    + """,
specs AS (
  SELECT CAST(wi * 2 + di AS INT) AS spec_id, 5 AS n_portfolios, 'ALL' AS universe, *,
         'no_amex' AS sample
  FROM (VALUES (0, 'value'), (1, 'equal')) c(wi, weighting),
       (VALUES (0, true), (1, false)) d(di, dependent)),
months AS (
  SELECT spec_id, date, value_premium AS y FROM specs JOIN series USING (weighting, dependent)
  WHERE series.population = 'ALL' AND series.n_portfolios = 5 AND value_premium IS NOT NULL),"""
    + nw("months", "spec_id", "nwt", 0, False)
    + ",\nmonths_x AS (SELECT spec_id, date, y, mkt_excess AS x FROM months LEFT JOIN factors USING (date)),"
    + capm("months_x", "spec_id", "capmt", 0, False)
)

FACTOR_CAPM = capm("(SELECT 1 AS one, date, hml AS y, mkt_excess AS x FROM factors)", "one", "hmlt")


def _sql(parts: list[str], select: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + select


def _edge_sql(known: dict[str, str]) -> dict[str, str]:
    """The SQL of the sorts over planted rows: the same queries, other common tables."""
    edges = planted_sql(BASE)
    same = [
        "sorting_variables",
        "qcut_independent",
        "qcut_dependent",
        "sort_univariate",
        "unassigned_counts",
        "vw_double_sort",
        "returns_vw_ew",
        "shared_comparison",
        "shared_grid",
    ]
    found = {f"edge_{name}": known[name].replace(BASE, edges) for name in same}
    conditional = known["sort_conditional"].replace(BASE, edges)
    nyse = conditional.replace("population = 'ALL'", "population = 'NYSE'")
    return found | {"edge_sort_conditional": nyse}


def oracle_sql() -> dict[str, str]:
    known = _study_sql()
    return known | _edge_sql(known)


def _study_sql() -> dict[str, str]:
    base, double, grid = [BASE], [BASE, DOUBLE], [BASE, GRID]
    results = [BASE, GRID, SPECS, RESULTS]
    panel = """SELECT permno, gvkey, date, exchange, industry, round(mktcap, 4) + 0.0 AS mktcap,
      round(mktcap_lag, 4) + 0.0 AS mktcap_lag, round(ret_excess, 12) + 0.0 AS ret_excess FROM panel"""
    comparison = """
      SELECT design, round(avg(value_premium), 10) + 0.0 AS value_premium FROM premium GROUP BY 1
      UNION ALL SELECT 'Published HML', round(avg(hml), 10) + 0.0 FROM factors"""
    sort_columns = """permno, exchange, industry, sorting_date, round(me, 4) + 0.0 AS me,
      round(bm, 10) + 0.0 AS bm, portfolio_me, portfolio_bm"""
    return {
        # inputs
        "panel_monthly": _sql(base, panel),
        "fundamentals_roundtrip": _sql(base, "SELECT gvkey, datadate, round(be, 2) + 0.0 AS be FROM fundamentals"),
        "factors_csv_roundtrip": _sql(
            base,
            "SELECT date, round(mkt_excess, 10) + 0.0 AS mkt_excess, round(hml, 10) + 0.0 AS hml FROM factors",
        ),
        "grid_report_roundtrip": _sql(
            results,
            """SELECT row_number() OVER (ORDER BY spec_id, test DESC) - 1 AS position, spec_id, test,
                      round(estimate, 10) + 0.0 AS estimate, round(t_stat, 8) + 0.0 AS t_stat
               FROM grid_results""",
        ),
        "fundamentals_annual": _sql(base, "SELECT gvkey, datadate, round(be, 2) + 0.0 AS be FROM fundamentals"),
        "factors_tidy": _sql(
            base,
            "SELECT date, round(mkt_excess, 10) + 0.0 AS mkt_excess, round(hml, 10) + 0.0 AS hml FROM factors",
        ),
        "parquet_roundtrip": _sql(base, panel),
        "csv_report_roundtrip": _sql(double, comparison),
        # timing
        "june_size": _sql(
            base,
            "SELECT permno, exchange, industry, sorting_date, round(me, 4) + 0.0 AS me FROM size",
        ),
        "december_equity": _sql(
            base, "SELECT permno, gvkey, sorting_date, round(me_dec, 4) + 0.0 AS me_dec FROM december"
        ),
        "book_to_market": _sql(
            base, "SELECT permno, sorting_date, round(bm, 10) + 0.0 AS bm, datadate, gvkey FROM btm"
        ),
        "sorting_variables": _sql(
            base,
            """SELECT permno, exchange, industry, sorting_date, round(me, 4) + 0.0 AS me,
               round(bm, 10) + 0.0 AS bm FROM sv""",
        ),
        "return_periods": _sql(
            base,
            """SELECT permno, sorting_date, date, round(ret_excess, 12) + 0.0 AS ret_excess,
               round(mktcap_lag, 4) + 0.0 AS mktcap_lag FROM rets""",
        ),
        # double sorts
        "qcut_independent": _sql(double, f"SELECT {sort_columns} FROM ind"),
        "qcut_dependent": _sql(double, f"SELECT {sort_columns} FROM dep"),
        "vw_double_sort": _sql(
            double,
            """SELECT date, portfolio_bm, portfolio_me, round(ret, 10) + 0.0 AS ret
               FROM vw WHERE design = 'Independent'""",
        ),
        "size_neutral_returns": _sql(
            double,
            """SELECT date, portfolio_bm, round(ret, 10) + 0.0 AS ret
               FROM neutral WHERE design = 'Independent'""",
        ),
        "premium_independent": _sql(
            double,
            """SELECT date, round(value_premium, 10) + 0.0 AS value_premium, n_portfolios_present
               FROM premium WHERE design = 'Independent'""",
        ),
        "premium_dependent": _sql(
            double,
            """SELECT date, round(value_premium, 10) + 0.0 AS value_premium, n_portfolios_present
               FROM premium WHERE design = 'Dependent'""",
        ),
        "premium_comparison": _sql(double, comparison),
        # exchange breakpoints and grid sorts
        "exchange_breakpoints": _sql(
            grid,
            """SELECT sorting_date, CAST(k - 1 AS INT) AS position, round(q[k], 10) + 0.0 AS break
               FROM tenths, range(1, 12) t(k) WHERE population = 'NYSE' AND NOT dependent""",
        ),
        "exchange_breakpoints_ranked": _sql(
            grid,
            """SELECT sorting_date, population, CAST(k - 1 AS INT) AS position,
                      round(q[k], 10) + 0.0 AS break
               FROM tenths, range(1, 12) t(k)
               WHERE population IN ('NYSE', 'ALL') AND NOT dependent""",
        ),
        "sort_univariate": _sql(
            grid,
            """SELECT permno, sorting_date, portfolio
               FROM sized LEFT JOIN (SELECT permno, sorting_date, population, portfolio FROM assigned
                                     WHERE NOT dependent AND n_portfolios = 5)
                 USING (permno, sorting_date, population)
               WHERE population = 'NYSE'""",
        ),
        "sort_conditional": _sql(
            grid,
            """SELECT permno, sorting_date, CAST(size_id AS INT) AS portfolio_me, portfolio
               FROM sized LEFT JOIN (SELECT permno, sorting_date, population, portfolio FROM assigned
                                     WHERE dependent AND n_portfolios = 5)
                 USING (permno, sorting_date, population)
               WHERE population = 'ALL'""",
        ),
        "unassigned_counts": _sql(
            grid,
            """SELECT sorting_date, count(*) AS n_stocks,
                      count(*) FILTER (WHERE portfolio IS NULL) AS n_unassigned
               FROM sized LEFT JOIN (SELECT permno, sorting_date, population, portfolio
                                     FROM assigned WHERE dependent AND n_portfolios = 10)
                 USING (permno, sorting_date, population)
               WHERE population = 'NYSE' GROUP BY 1""",
        ),
        "returns_vw_ew": _sql(
            grid,
            """SELECT date, portfolio, unnest(['value', 'equal']) AS weighting,
                      round(unnest([vw, ew]), 10) + 0.0 AS ret
               FROM (SELECT date, portfolio,
                            coalesce(sum(ret_excess * mktcap_lag), 0) / nullif(sum(mktcap_lag), 0) AS vw,
                            avg(ret_excess) AS ew
                     FROM sized JOIN rets USING (permno, sorting_date)
                       LEFT JOIN (SELECT permno, sorting_date, population, portfolio FROM assigned
                                  WHERE NOT dependent AND n_portfolios = 5)
                         USING (permno, sorting_date, population)
                     WHERE population = 'NYSE' GROUP BY ALL)""",
        ),
        "high_minus_low": _sql(
            grid,
            """SELECT weighting, date, round(value_premium, 10) + 0.0 AS value_premium,
                      n_portfolios_present
               FROM series
               WHERE population = 'ALL' AND dependent AND n_portfolios = 5""",
        ),
        # inference
        "newey_west_mean": _sql(
            [BASE, DOUBLE, "p AS (SELECT design, date, value_premium AS y FROM premium"
             " WHERE value_premium IS NOT NULL)", nw("p", "design", "nwt")],
            "SELECT design, round(estimate, 10) + 0.0 AS estimate, round(t_stat, 8) + 0.0 AS t_stat, n_obs FROM nwt",
        ),
        "capm_alpha": _sql(
            [BASE, DOUBLE, "p AS (SELECT design, date, value_premium AS y, mkt_excess AS x"
             " FROM premium LEFT JOIN factors USING (date))", capm("p", "design", "capmt")],
            "SELECT design, round(estimate, 10) + 0.0 AS estimate, round(t_stat, 8) + 0.0 AS t_stat, n_obs FROM capmt",
        ),
        "factor_capm_alpha": _sql(
            [BASE, FACTOR_CAPM],
            "SELECT round(estimate, 10) + 0.0 AS estimate, round(t_stat, 8) + 0.0 AS t_stat, n_obs FROM hmlt",
        ),
        "gap_check": _sql(
            double,
            """SELECT design, count(DISTINCT date) AS n_months,
                      date_diff('month', min(date), max(date)) + 1 - count(DISTINCT date)
                        AS n_missing
               FROM premium GROUP BY 1""",
        ),
        # grid
        "spec_coverage": _sql(
            [BASE, GRID, SPECS],
            """SELECT spec_id, n_portfolios, universe, weighting, dependent, sample,
                      count(permno) AS n_stocks, count(permno) FILTER (WHERE member) AS n_members
               FROM specs LEFT JOIN stock ON stock.population = universe || suffix
                 AND sorting_date >= lo_date AND sorting_date < hi_date
               GROUP BY ALL""",
        ),
        "grid_series": _sql(
            grid,
            """SELECT population, n_portfolios, dependent, weighting, sorting_date, date,
                      round(value_premium, 10) + 0.0 AS value_premium, n_portfolios_present
               FROM series""",
        ),
        "value_premium": _sql(
            results,
            """SELECT test, round(estimate, 10) + 0.0 AS estimate, round(t_stat, 8) + 0.0 AS t_stat
               FROM grid_results WHERE universe = 'ALL' AND n_portfolios = 5 AND NOT dependent
                 AND weighting = 'value' AND sample = 'full'""",
        ),
        "grid_custom_sample": _sql(
            [BASE, CUSTOM],
            """SELECT spec_id, n_portfolios, universe, weighting, dependent, sample, test,
                      round(estimate, 10) + 0.0 AS estimate, round(t_stat, 8) + 0.0 AS t_stat, n_obs
               FROM specs JOIN (SELECT 'Newey-West' AS test, spec_id, estimate, t_stat, n_obs FROM nwt
                                UNION ALL
                                SELECT 'CAPM-alpha', spec_id, estimate, t_stat, n_obs FROM capmt)
                 USING (spec_id)""",
        ),
        "grid_results": _sql(
            results,
            """SELECT spec_id, n_portfolios, universe, weighting, dependent, sample, test,
                      round(estimate, 10) + 0.0 AS estimate, round(t_stat, 8) + 0.0 AS t_stat, n_obs
               FROM grid_results""",
        ),
        "shared_comparison": _sql(double, comparison),
        "shared_grid": _sql(
            results,
            """SELECT spec_id, n_portfolios, universe, weighting, dependent, sample, test,
                      round(estimate, 10) + 0.0 AS estimate, round(t_stat, 8) + 0.0 AS t_stat, n_obs
               FROM grid_results""",
        ),
        "grid_from_split": _sql(
            grid,
            f"""SELECT population, n_portfolios, dependent, weighting, sorting_date, date,
                       round(value_premium, 10) + 0.0 AS value_premium, n_portfolios_present
                FROM series WHERE sorting_date >= {SPLIT} AND population IN ('NYSE', 'ALL')""",
        ),
        "sorting_table_rebuild": _sql(
            base,
            """SELECT permno, exchange, industry, sorting_date, round(me, 4) + 0.0 AS me,
               round(CASE WHEN year(sorting_date) IN (1998, 2000) THEN bm ELSE bm * 2 END, 10) + 0.0
                 AS bm FROM sv""",
        ),
        "bucketed_double_sort": _sql(
            double,
            """SELECT date, portfolio_bm, portfolio_me, round(ret, 10) + 0.0 AS ret
               FROM vw WHERE design = 'Independent'""",
        ),
        # reports
        "significance_flags": _sql(
            results,
            """SELECT spec_id, test, round(estimate, 10) + 0.0 AS estimate, round(t_stat, 8) + 0.0 AS t_stat,
                      abs(t_stat) >= 1.96 AS is_significant FROM grid_results""",
        ),
        "estimate_histogram": _sql(
            results,
            """SELECT test, CAST(ceil((estimate - 0.0005) / 0.001) AS BIGINT) AS bin,
                      abs(t_stat) >= 1.96 AS is_significant, count(*) AS n_specs,
                      round(CAST(ceil((estimate - 0.0005) / 0.001) AS BIGINT) * 0.001::DOUBLE, 6) AS bin_centre
               FROM grid_results WHERE estimate IS NOT NULL GROUP BY ALL""",
        ),
        "reference_lines": _sql(
            [BASE, FACTOR_CAPM],
            """SELECT 'Newey-West' AS test, round(avg(hml), 10) + 0.0 AS reference FROM factors
               UNION ALL SELECT 'CAPM-alpha', round(estimate, 10) + 0.0 FROM hmlt""",
        ),
        "grid_summary": _sql(
            results + ["""
flat AS (
  SELECT test, estimate, t_stat, unnest([
    {'axis': 'all', 'option': 'all'},
    {'axis': 'n_portfolios', 'option': CAST(n_portfolios AS VARCHAR)},
    {'axis': 'universe', 'option': universe}, {'axis': 'weighting', 'option': weighting},
    {'axis': 'dependent', 'option': CAST(dependent AS VARCHAR)},
    {'axis': 'sample', 'option': sample}], recursive := true)
  FROM grid_results)"""],
            """SELECT test, axis, option, count(*) AS n_specs, count(estimate) AS n_estimates,
                      count(*) FILTER (WHERE abs(t_stat) >= 1.96) AS n_significant,
                      count(*) FILTER (WHERE estimate > 0) AS n_positive,
                      round(min(estimate), 10) + 0.0 AS min_estimate,
                      round(max(estimate), 10) + 0.0 AS max_estimate,
                      round(avg(estimate), 10) + 0.0 AS mean_estimate,
                      round(median(estimate), 10) + 0.0 AS median_estimate,
                      round(stddev_samp(estimate), 10) + 0.0 AS sd_estimate
               FROM flat GROUP BY ALL""",
        ),
    }
