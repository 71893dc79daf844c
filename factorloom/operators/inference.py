"""Time-series tests with Newey-West (1987) standard errors.

The intercept of a regression is a weighted sum of the outcomes.  With ``h_t``
its residual times its weight, the variance of the intercept is
``sum(h_t^2) + 2 sum_l w_l sum(h_t h_{t-l})`` with Bartlett weights
``w_l = 1 - l / (lag + 1)``.  That equals the intercept entry of the usual
sandwich matrix and needs one column only.

Lags are positional: the previous observed row of the series, which is the
previous month unless months are missing; :func:`gap_check` counts those.

A series is read twice: for its moments, and for its lags.  It is cut into blocks
of equal width in the order column, about ``BLOCK_ROWS`` rows each if that is
evenly filled.  Lags inside a block are a window over its rows; those that reach
back over its start come from the last ``lag`` rows of the blocks before, of
which one row each is left.  So a single long series is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cross_section import join_on

SMALL_SAMPLE = ("n/(n-k)", "none")
#: Rows of one block of a series, about.
BLOCK_ROWS = 65_536


def _position(df: DataFrame, order: str) -> Column:
    """The order column as a number; a type without one gives a single block."""
    kind = df.schema[order].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(order).cast("double")
    if isinstance(kind, (T.TimestampType, T.NumericType)):
        return F.col(order).cast("double")
    return F.lit(0.0)


def _with_moments(df: DataFrame, by: Sequence[str], order: str, *moments: Column) -> DataFrame:
    """Add the moments of each series to its rows, and ``_block``."""
    placed = df.withColumn("_at", _position(df, order))
    found = [*moments, F.count("*").alias("_n"), F.min("_at").alias("_from"), F.max("_at").alias("_to")]
    if by:
        known = join_on(placed, placed.groupBy(*by).agg(*found), by)
    else:  # one row, as a subquery
        whole = placed.agg(F.struct(*found).alias("_m")).scalar()
        known = placed.withColumn("_m", whole).select("*", "_m.*").drop("_m")
    blocks = F.ceil(F.col("_n") / BLOCK_ROWS)
    share = F.try_divide(F.col("_at") - F.col("_from"), F.col("_to") - F.col("_from"))
    block = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * blocks), blocks - 1)
    return known.withColumn("_block", F.coalesce(block, F.lit(0)))


def _intercept_test(
    df: DataFrame,
    estimate: Column,
    influence: Column,
    by: Sequence[str],
    order: str,
    lag: int,
    small_sample: str,
    k: int,
) -> DataFrame:
    if small_sample not in SMALL_SAMPLE:
        raise ValueError(f"small_sample must be one of {SMALL_SAMPLE}, not {small_sample!r}")
    h, at, lags = F.col("_h"), F.col("_i"), range(1, lag + 1)
    weight = {i: 2 * (1 - i / (lag + 1)) for i in lags}
    in_block = Window.partitionBy(*by, "_block").orderBy(order)
    scored = df.select(*by, order, "_block", estimate.alias("_estimate"), influence.alias("_h"))
    own = scored.select(
        *by,
        "_block",
        "_estimate",
        h,
        F.row_number().over(in_block).alias("_i"),
        # null for the last rows of a block
        F.lead(F.lit(True), max(lag, 1)).over(in_block).alias("_more"),
        *[F.lag(h, i).over(in_block).alias(f"_h{i}") for i in lags],
    )

    def kept(condition: Column) -> Column:
        """``_h`` of the rows of a block that meet the condition, at most ``lag``, in order."""
        rows = F.array_sort(F.collect_list(F.when(condition, F.struct("_i", "_h"))))
        return rows["_h"]

    within = F.sum(h * h)
    for i in lags:
        within = within + weight[i] * F.coalesce(F.sum(h * F.col(f"_h{i}")), F.lit(0.0))
    blocks = own.groupBy(*by, "_block").agg(
        F.max("_estimate").alias("_estimate"),
        within.alias("_within"),
        F.count(h).alias("_rows"),
        kept(at <= lag).alias("_first"),
        kept(F.col("_more").isNull()).alias("_last"),
    )
    # every block has a row, so the last rows of ``lag`` blocks hold the ``lag`` rows before a block
    in_order = Window.partitionBy(*by).orderBy("_block")
    none = F.array().cast("array<double>")
    earlier = [F.coalesce(F.lag("_last", i).over(in_order), none) for i in reversed(lags)]
    blocks = blocks.withColumn("_before", F.concat(*earlier) if lag else none)
    across = F.lit(0.0)
    for i in lags:
        for row in range(i):
            partner = F.get("_before", F.size("_before") - F.lit(i - row))
            product = F.get("_first", F.lit(row)) * partner
            across = across + weight[i] * F.coalesce(product, F.lit(0.0))
    moments = blocks.withColumn("_across", across).groupBy(*by).agg(
        F.max("_estimate").alias("estimate"),
        F.sum(F.col("_within") + F.col("_across")).alias("_variance"),
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("n_obs"),
    )
    n = F.col("n_obs")
    scale = F.try_divide(n, n - k) if small_sample == "n/(n-k)" else F.lit(1.0)
    error = F.sqrt(F.greatest(F.col("_variance"), F.lit(0.0)) * scale)
    return moments.select(
        *by, "estimate", F.try_divide(F.col("estimate"), error).alias("t_stat"), "n_obs"
    )


def newey_west_mean(
    df: DataFrame,
    value: str = "value_premium",
    by: Sequence[str] = (),
    order: str = "date",
    lag: int = 3,
    small_sample: str = "n/(n-k)",
) -> DataFrame:
    """Mean of each series and its t-statistic: ``by..., estimate, t_stat, n_obs``."""
    known = df.filter(F.col(value).isNotNull()).select(*by, order, F.col(value).alias("_y"))
    known = _with_moments(known, by, order, F.avg("_y").alias("_my"))
    mean = F.col("_my")
    influence = (F.col("_y") - mean) / F.col("_n")
    return _intercept_test(known, mean, influence, by, order, lag, small_sample, k=1)


def capm_alpha(
    df: DataFrame,
    y: str = "value_premium",
    x: str = "mkt_excess",
    by: Sequence[str] = (),
    order: str = "date",
    lag: int = 3,
    small_sample: str = "n/(n-k)",
) -> DataFrame:
    """Intercept of ``y`` on ``x`` per series and its t-statistic.

    Rows without ``y`` or ``x`` are left out before the lags are taken.
    """
    known = df.filter(F.col(y).isNotNull() & F.col(x).isNotNull()).select(
        *by, order, F.col(y).cast("double").alias("_y"), F.col(x).cast("double").alias("_x")
    )
    fitted = _with_moments(
        known,
        by,
        order,
        F.avg("_y").alias("_my"),
        F.avg("_x").alias("_mx"),
        F.regr_sxx("_y", "_x").alias("_sxx"),
        F.regr_sxy("_y", "_x").alias("_sxy"),
    ).withColumn("_slope", F.try_divide("_sxy", "_sxx"))
    dx, slope = F.col("_x") - F.col("_mx"), F.col("_slope")
    intercept = F.col("_my") - slope * F.col("_mx")
    residual = F.col("_y") - F.col("_my") - slope * dx
    row_weight = 1 / F.col("_n") - F.try_divide(F.col("_mx") * dx, F.col("_sxx"))
    return _intercept_test(
        fitted, intercept, residual * row_weight, by, order, lag, small_sample, k=2
    )


def gap_check(df: DataFrame, by: Sequence[str] = (), order: str = "date") -> DataFrame:
    """Months missing between the first and last one of each series."""
    months = F.months_between(F.max(order), F.min(order)).cast("int") + 1
    return df.groupBy(*by).agg(
        F.count_distinct(order).alias("n_months"),
        (months - F.count_distinct(order)).cast("long").alias("n_missing"),
    )
