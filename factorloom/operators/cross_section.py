"""Exact quantiles of cross-sections, per group and per population of members."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import in_universe, inner_breaks, interior_breaks
from ..workspace import stage

# value ranges into which all groups together are split, at most
FENCES = 4096


def count_below(
    df: DataFrame, breaks: str, value: str, out: str, capacity: int, inclusive: bool = False
) -> DataFrame:
    """Add ``out``: how many of the sorted ``breaks`` lie below ``value``.

    A binary search spelled out in ``log2(capacity)`` projections, which stay in
    generated code; ``capacity`` bounds the length of ``breaks``, and longer ones
    are an error.  With ``inclusive`` a break equal to ``value`` counts too.
    """
    too_long = F.raise_error(F.lit(f"{breaks} has more than {capacity} entries")).cast("int")
    df = df.withColumn(out, F.when(F.size(breaks) > capacity, too_long).otherwise(0))
    compare = "<=" if inclusive else "<"
    step = 1 << max(capacity.bit_length() - 1, 0)
    while step:
        # get() is null past the end, which leaves the position as it is
        passed = f"get(`{breaks}`, `{out}` + {step} - 1) {compare} `{value}`"
        df = df.withColumn(out, F.expr(f"if({passed}, `{out}` + {step}, `{out}`)"))
        step >>= 1
    return df


def bin_number(
    df: DataFrame, value: str, breaks: str, out: str, n: int, closed: str
) -> DataFrame:
    """Add ``out``: the 1-based bin of ``value`` among the sorted ``breaks``.

    Bins are (a, b] when ``closed`` is "right" and [a, b) when it is "left"; ``n``
    bounds their number.  Null without a value or without breaks.
    """
    if closed not in ("left", "right"):
        raise ValueError(f"closed must be 'left' or 'right', not {closed!r}")
    df = count_below(df, breaks, value, out, n - 1, inclusive=closed == "left")
    known = F.col(value).isNotNull() & F.col(breaks).isNotNull()
    return df.withColumn(out, F.when(known, F.col(out) + 1))


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns of the same names, null keys included; the keys are kept once."""
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(other, same, how).drop(*[f"_right_{k}" for k in keys])


def stacked(df: DataFrame, values: Sequence[str], *keep: str) -> DataFrame:
    """One row ``keep..., variable, value`` per row and column, for quantiles of several columns
    from the same passes."""
    pairs = [F.struct(F.lit(v).alias("variable"), F.col(v).alias("value")) for v in values]
    return df.select(*keep, F.inline(F.array(*pairs)))


def value_counts(
    df: DataFrame, by: Sequence[str], values: Sequence[str], populations: Mapping[str, Column]
) -> DataFrame:
    """Members of each population per group and value: ``_g, values..., _member0, ...``.

    ``_g`` is a struct of ``by``, which joins null keys like others.  Ties collapse before the shuffle.
    """
    members = [F.coalesce(c, F.lit(False)).cast("long") for c in populations.values()]
    return df.groupBy(F.struct(*by).alias("_g"), *values).agg(
        *[F.sum(m).alias(f"_member{i}") for i, m in enumerate(members)]
    )


def _fences(counts: DataFrame) -> Column:
    """Sorted positions (hash of the group, value) that cut all groups into ranges, as a scalar subquery.

    Buckets of hashes each keep one value, chosen by a hash too: a random sample of bounded size in
    which large groups have more values, and the same on every evaluation.
    """
    h = F.xxhash64("_o.g", "_o.x")
    kept = counts.select("_o", h.alias("_h")).select(
        F.col("_o.g").alias("g"), F.col("_o.x").alias("x"), "_h", F.pmod("_h", F.lit(FENCES)).alias("_bucket")
    )
    sample = kept.groupBy("_bucket").agg(F.min_by("g", "_h").alias("g"), F.min_by("x", "_h").alias("x"))
    fences = F.array_sort(F.array_distinct(F.collect_list(F.struct("g", "x"))))
    return sample.agg(fences.alias("fences")).scalar()


def quantiles_of_counts(
    counts: DataFrame, value: str, probs: Sequence[float], names: Sequence[str]
) -> DataFrame:
    """Quantiles from the table of :func:`value_counts`: one row ``_g, population, q`` each.

    All values are sorted in ranges that a sample fences off, so no task holds a group, whatever its
    size.  ``counts`` is read from one exchange, and nothing is written.
    """
    member = [f"_member{i}" for i in range(len(names))]
    x = F.col(value)
    # a value without members, or no value at all, only keeps its group in the result
    counts = counts.select(
        "_g",
        x.alias("_x"),
        *[F.when(x.isNull(), F.lit(0).cast("long")).otherwise(F.col(m)).alias(m) for m in member],
        F.struct(F.xxhash64("_g").alias("g"), x.alias("x")).alias("_o"),
    )
    # a binary search in one expression, as the plan is optimized anew after each of its stages
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(FENCES.bit_length()))])
    place = F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(F.get("_fences", at + step - 1) < F.col("_o"), at + step).otherwise(at),
    )
    ranged = counts.withColumn("_fences", _fences(counts)).select("_g", "_x", *member, place.alias("_range"))

    # 1. Running counts inside each range.
    upto = Window.partitionBy("_g", "_range").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranged.select(
        "_g",
        "_range",
        "_x",
        F.array(*[F.col(m) for m in member]).alias("_here"),
        F.array(*[F.sum(m).over(upto) for m in member]).alias("_upto"),
    )

    # 2. Running counts over the ranges of a group: the range and place of each order statistic.
    sizes = ranked.groupBy("_g", "_range").agg(
        *[F.max(F.get("_upto", F.lit(i))).alias(m) for i, m in enumerate(member)]
    )
    so_far = Window.partitionBy("_g").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("_g")
    summed = sizes.select(
        "_g",
        "_range",
        (F.min("_range").over(whole) == F.col("_range")).alias("_lowest"),
        *member,
        *[(F.sum(m).over(so_far) - F.col(m)).alias(f"{m}_before") for m in member],
        *[F.sum(m).over(whole).alias(f"{m}_total") for m in member],
    )
    per_population = [
        F.struct(
            F.lit(i).alias("_pop"),
            F.col(m).alias("_n"),
            F.col(f"{m}_before").alias("_before"),
            F.col(f"{m}_total").alias("_total"),
        )
        for i, m in enumerate(member)
    ]
    counted = summed.select("_g", "_range", "_lowest", F.inline(F.array(*per_population)))
    points = F.array(
        *[F.struct(F.lit(k).alias("_k"), F.lit(float(p)).alias("_p")) for k, p in enumerate(probs)]
    )
    targets = (
        counted.filter("_n > 0")
        .select("*", F.inline(points))
        .withColumn("_position", (F.col("_total") - 1) * F.col("_p"))
        .withColumn(
            "_rank", F.explode(F.array_distinct(F.array(F.floor("_position"), F.ceil("_position"))))
        )
        .withColumn("_offset", F.col("_rank") - F.col("_before"))
        .filter("_offset >= 0 AND _offset < _n")
        .select("_g", "_range", "_pop", "_k", "_position", "_rank", "_offset")
    )
    # a population without values in a group is a row without points
    none = counted.filter("_total = 0 AND _lowest").select(
        "_g", "_range", "_pop", *[F.lit(None).cast(t).alias(c) for c, t in targets.dtypes[3:]]
    )

    # 3. The values that cover the places asked for.
    found = (
        ranked.join(targets.unionAll(none), ["_g", "_range"])
        .filter("_k IS NULL OR _offset < get(_upto, _pop) AND _offset >= get(_upto, _pop) - get(_here, _pop)")
        .repartition("_g", "_pop")
    )
    low, high = F.min_by("_x", "_rank"), F.max_by("_x", "_rank")
    position = F.first("_position")
    part = position - F.floor(position)
    # at a rank itself the value stands alone: an infinite neighbour would make it NaN
    by_point = found.groupBy("_g", "_pop", "_k").agg(
        F.when(part == 0, low).otherwise(low + part * (high - low)).alias("_value")
    )
    point = F.when(F.col("_k").isNotNull(), F.struct("_k", "_value"))
    listed = by_point.groupBy("_g", "_pop").agg(F.array_sort(F.collect_list(point)).alias("_points"))
    named = F.array(*[F.lit(name) for name in names])
    return listed.select(
        "_g",
        F.get(named, F.col("_pop")).alias("population"),
        F.when(F.size("_points") > 0, F.col("_points._value")).alias("q"),
    )


def quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str],
    populations: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles: one row ``by..., population, q`` each.

    ``populations`` names conditions; the quantiles of a population use the rows
    that meet its condition, and all populations share the pass over ``df``.
    ``q`` is null for a population without values in a group.  Null values are
    ignored; rows whose ``by`` is null form groups like others.
    """
    populations = populations or {"all": F.lit(True)}
    counts = value_counts(df, by, [value], populations)
    found = quantiles_of_counts(counts, value, probs, list(populations))
    return found.select(*[F.col("_g")[c].alias(c) for c in by], "population", "q")


def breakpoints(
    df: DataFrame,
    value: str,
    n: int,
    by: Sequence[str],
    universe: Sequence[str] | None = None,
    closed: str = "left",
) -> DataFrame:
    """Breaks of ``n`` bins per group: ``by..., breaks``.

    ``closed="right"`` keeps the inner quantiles 1/n .. (n-1)/n; ``"left"`` takes
    0 .. 1, collapses equal ones and drops the outermost two.  ``universe`` limits
    the rows that set the breaks to some exchanges.
    """
    probs, shape = break_points(n, closed)
    if not probs:
        return df.select(*by).distinct().withColumn("breaks", F.array().cast("array<double>"))
    population = {"universe": in_universe(F.col("exchange"), universe)}
    found = quantiles(df, value, probs, by, population)
    return found.select(*by, shape(F.col("q")).alias("breaks"))


def break_points(n: int, closed: str) -> tuple[list[float], Callable[[Column], Column]]:
    """The quantiles behind the breaks of ``n`` bins, and how they become breaks."""
    if closed == "right":
        return [i / n for i in range(1, n)], inner_breaks
    return [i / n for i in range(n + 1)], interior_breaks


def double_breaks(
    df: DataFrame,
    first: str,
    second: str,
    n_first: int,
    n_second: int,
    by: Sequence[str],
    universe: Sequence[str] | None = None,
    closed: str = "right",
    independent: bool = True,
    dependent: bool = True,
) -> DataFrame:
    """Breaks of double sorts, one row per group: ``by..., first_breaks, second_breaks, nested``.

    ``second_breaks`` are those of the whole group, ``nested`` lists structs ``bin, breaks`` per bin of
    the first variable; either is null if it is not asked for.  Both variables share one pass over
    ``df``; nested breaks take a second one, for which the first breaks are written.
    """
    population = {"universe": in_universe(F.col("exchange"), universe)}
    first_probs, shape = break_points(n_first, closed)
    second_probs, _ = break_points(n_second, closed)
    probs = sorted({*first_probs, *second_probs})
    variables = [first, second] if independent else [first]
    both = stacked(df, variables, *by, "exchange")
    found = quantiles(both, "value", probs or [0.5], [*by, "variable"], population)

    def of(variable: str, wanted: list[float]) -> Column:
        picks = F.array(*[F.get("q", F.lit(probs.index(p))) for p in wanted]).cast("array<double>")
        known = F.when(F.col("q").isNotNull(), picks) if wanted else picks
        return F.max(F.when(F.col("variable") == variable, shape(known)))

    no_breaks = F.lit(None).cast("array<double>")
    whole = found.groupBy(*by).agg(
        of(first, first_probs).alias("first_breaks"),
        (of(second, second_probs) if independent else no_breaks).alias("second_breaks"),
    )
    if not dependent:
        no_bins = F.lit(None).cast("array<struct<bin:int,breaks:array<double>>>")
        return whole.withColumn("nested", no_bins)
    whole = stage(whole, "first-breaks")
    binned = bin_number(join_on(df, whole, by), first, "first_breaks", "bin", n_first, closed)
    within = quantiles(binned, second, second_probs or [0.5], [*by, "bin"], population)
    second_q = F.col("q") if second_probs else F.array().cast("array<double>")
    bins = F.collect_list(F.struct("bin", shape(second_q).alias("breaks")))
    return join_on(whole, within.groupBy(*by).agg(bins.alias("nested")), by, "left")


def nested_bin(df: DataFrame, value: str, bin_column: str, out: str, n: int, closed: str) -> DataFrame:
    """Add ``out``: the bin of ``value`` by the breaks that ``nested`` lists for its first bin."""
    chosen = F.filter("nested", lambda e: e["bin"].eqNullSafe(F.col(bin_column)))
    df = df.withColumn("_breaks", F.get(chosen, F.lit(0))["breaks"])
    return bin_number(df, value, "_breaks", out, n, closed).drop("_breaks")
