"""Summaries of the distribution of estimates over the grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.inference import capm_alpha
from ..operators.premium import flag_significant

AXES = ("n_portfolios", "universe", "weighting", "dependent", "sample")


def estimate_histogram(
    results: DataFrame, width: float = 0.001, critical: float = 1.96
) -> DataFrame:
    """Counts per test, bin and significance; bins (a, b] centred on multiples of ``width``."""
    flagged = flag_significant(results.filter(F.col("estimate").isNotNull()), critical)
    number = F.ceil((F.col("estimate") - width / 2) / width)
    return (
        flagged.groupBy("test", number.cast("long").alias("bin"), "is_significant")
        .agg(F.count("*").alias("n_specs"))
        .withColumn("bin_centre", F.col("bin") * width)
    )


def reference_lines(factors: DataFrame) -> DataFrame:
    """Where the published factor stands in each histogram: ``test, reference``."""
    mean = factors.agg(F.avg("hml").alias("reference")).select(
        F.lit("Newey-West").alias("test"), "reference"
    )
    alpha = capm_alpha(factors, y="hml").select(
        F.lit("CAPM-alpha").alias("test"), F.col("estimate").alias("reference")
    )
    return mean.unionByName(alpha)


def grid_summary(
    results: DataFrame, axes: Sequence[str] = AXES, critical: float = 1.96
) -> DataFrame:
    """Spread of the estimates per test, overall and for every option of each axis."""
    flagged = flag_significant(results, critical).select(
        "test", "estimate", "is_significant", *[F.col(a).cast("string").alias(a) for a in axes]
    )
    rows = flagged.groupingSets([["test"], *[["test", a] for a in axes]], "test", *axes)
    estimate = F.col("estimate")
    summary = rows.agg(
        *[(F.grouping(a) == 0).alias(f"_by_{a}") for a in axes],
        F.count("*").alias("n_specs"),
        F.count(estimate).alias("n_estimates"),
        F.count_if(F.col("is_significant")).alias("n_significant"),
        F.count_if(estimate > 0).alias("n_positive"),
        F.min(estimate).alias("min_estimate"),
        F.max(estimate).alias("max_estimate"),
        F.avg(estimate).alias("mean_estimate"),
        F.median(estimate).alias("median_estimate"),
        F.stddev_samp(estimate).alias("sd_estimate"),
    )
    axis = F.coalesce(*[F.when(F.col(f"_by_{a}"), F.lit(a)) for a in axes], F.lit("all"))
    option = F.coalesce(*[F.when(F.col(f"_by_{a}"), F.col(a)) for a in axes], F.lit("all"))
    kept = [c for c in summary.columns if c.startswith("n_") and c not in axes or c.endswith("_estimate")]
    return summary.select("test", axis.alias("axis"), option.alias("option"), *kept)
