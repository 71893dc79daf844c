"""The value premium under every combination of methodological choices.

One job serves the whole grid.  Weighting and the split of the sample by date do
not move a stock to another portfolio, so only the number of portfolios, the
exchanges that set the breaks, the kind of sort and the excluded industry count:
24 assignments in the default grid.  All of them are step functions of size and
book-to-market with breaks fixed per sort date.  The breaks of all assignments
together cut the (size, book-to-market) plane of a date into cells, inside which
every assignment is constant.  So a stock needs one cell number only, the returns
are joined once and summed per date and cell, and the assignments are evaluated
on the cells, whose number depends on the grid and the calendar but not on the
number of stocks.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, field
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean_double, in_universe, interior_breaks
from ..operators.cross_section import bin_number, count_below, join_on, quantiles, stacked
from ..operators.inference import capm_alpha, newey_west_mean
from ..operators.portfolios import LISTED, SORT_DATE
from ..operators.premium import high_minus_low
from ..operators.returns import SUMS, cell_sums, returns_from_sums, stack_weightings
from ..workspace import stage

N_SIZE = 3
TESTS = ("Newey-West", "CAPM-alpha")


@dataclass(frozen=True)
class Sample:
    """Stocks outside one industry, sorted from ``start`` to before ``end``.

    ``keep`` is any further condition on the columns of the sorting variables, in SQL.
    """

    name: str
    exclude_industry: str | None = None
    start: dt.date | None = None
    end: dt.date | None = None
    keep: str | None = None

    @property
    def exclusion(self) -> tuple[str | None, str | None] | None:
        """What leaves stocks out; None if nothing does."""
        return (self.exclude_industry, self.keep) if self.exclude_industry or self.keep else None


Exclusion = tuple[str | None, str | None] | None


def in_samples(sv: DataFrame, axes: GridAxes) -> DataFrame:
    """The sort dates from the earliest start to the latest end of the samples.

    A range on ``sorting_date``: a table kept by sort date reads the folders inside it only.
    """
    starts, ends = [s.start for s in axes.samples], [s.end for s in axes.samples]
    if starts and None not in starts:
        sv = sv.filter(F.col("sorting_date") >= F.lit(min(starts)))
    if ends and None not in ends:
        sv = sv.filter(F.col("sorting_date") < F.lit(max(ends)))
    return sv


def _suffix(exclusion: Exclusion) -> str:
    industry, keep = exclusion or (None, None)
    return (f" without {industry}" if industry else "") + (f" where {keep}" if keep else "")


def default_samples(split: dt.date) -> tuple[Sample, ...]:
    return (
        Sample("full"),
        Sample("no_finance", exclude_industry="Finance"),
        Sample("before_split", end=split),
        Sample("from_split", start=split),
    )


@dataclass(frozen=True)
class GridAxes:
    """The options of each choice; the grid is their product, the last one fastest."""

    n_portfolios: Sequence[int] = (2, 5, 10)
    universes: dict[str, Sequence[str]] = field(
        default_factory=lambda: {"NYSE": ("NYSE",), "ALL": LISTED}
    )
    weightings: Sequence[str] = ("value", "equal")
    dependent: Sequence[bool] = (True, False)
    samples: Sequence[Sample] = default_samples(dt.date(1990, 7, 1))

    @property
    def exclusions(self) -> list[Exclusion]:
        return list(dict.fromkeys(s.exclusion for s in self.samples))

    @property
    def populations(self) -> list[tuple[str, Exclusion]]:
        """Pairs of universe and what is left out, which set the breaks."""
        return [(u, e) for u in self.universes for e in self.exclusions]

    def population_name(self, universe: str, exclusion: Exclusion) -> str:
        return universe + _suffix(exclusion)


def spec_grid(spark: SparkSession, axes: GridAxes) -> DataFrame:
    """One row per combination: ``spec_id``, its choices, and the bounds of its sample."""
    choices = {
        "n_portfolios": [F.lit(n) for n in axes.n_portfolios],
        "universe": [F.lit(u) for u in axes.universes],
        "weighting": [F.lit(w) for w in axes.weightings],
        "dependent": [F.lit(d) for d in axes.dependent],
        "_sample": [
            F.struct(
                F.lit(s.name).alias("sample"),
                F.lit(_suffix(s.exclusion)).alias("_suffix"),
                F.lit(s.start).cast("date").alias("sample_start"),
                F.lit(s.end).cast("date").alias("sample_end"),
            )
            for s in axes.samples
        ],
    }
    total = reduce(lambda a, b: a * len(b), choices.values(), 1)
    columns, width = [], total
    for name, options in choices.items():
        width //= len(options)
        digit = (F.floor(F.col("id") / width) % len(options)).cast("int")
        columns.append(F.get(F.array(*options), digit).alias(name))
    grid = spark.range(0, total, numPartitions=1).select(
        F.col("id").cast("int").alias("spec_id"), *columns
    )
    grid = grid.select("*", "_sample.*").drop("_sample")
    return grid.withColumn("population", F.concat("universe", "_suffix")).drop("_suffix")


def _kept(exclusion: Exclusion) -> Column:
    industry, keep = exclusion or (None, None)
    outside = F.col("industry") != industry if industry else F.lit(True)
    return F.coalesce(outside & (F.expr(keep) if keep else F.lit(True)), F.lit(False))


def _members(axes: GridAxes) -> dict[str, Column]:
    """Per population, the condition for a stock to set its breaks."""
    exchange = F.col("exchange")
    return {
        axes.population_name(u, e): in_universe(exchange, axes.universes[u]) & _kept(e)
        for u, e in axes.populations
    }


def _case(key: Column, branches: dict[str, Column]) -> Column:
    chosen = F.lit(False)
    for name, value in branches.items():
        chosen = F.when(key == name, value).otherwise(chosen)
    return chosen


def _breaks_by_n(quantile_rows: DataFrame, axes: GridAxes, probs: list[Fraction]) -> DataFrame:
    """Replace ``q`` by one row of breaks per number of portfolios."""
    rows = []
    for n in axes.n_portfolios:
        picks = [F.get("q", F.lit(probs.index(Fraction(i, n)))) for i in range(n + 1)]
        known = F.when(F.col("q").isNotNull(), F.array(*picks))
        rows.append(
            F.struct(F.lit(n).alias("n_portfolios"), interior_breaks(known).alias("breaks"))
        )
    keys = [c for c in quantile_rows.columns if c != "q"]
    return quantile_rows.select(*keys, F.inline(F.array(*rows)))


def _breaks(sv: DataFrame, axes: GridAxes) -> tuple[DataFrame, DataFrame]:
    """Size breaks per population, and book-to-market breaks per assignment.

    ``portfolio_me`` is 0 for the sorts that ignore size.  Size and book-to-market share the passes
    over the whole cross-sections.
    """
    members = _members(axes)
    probs = sorted({Fraction(i, n) for n in (*axes.n_portfolios, N_SIZE) for i in range(n + 1)})
    points = [p.numerator / p.denominator for p in probs]
    flags = {name: f"_member{i}" for i, name in enumerate(members)}
    marked = sv.withColumns({flags[name]: member for name, member in members.items()})
    both = stacked(marked, ["me", "bm"], "sorting_date", *flags.values())
    found = stage(
        quantiles(
            both, "value", points, ["sorting_date", "variable"], {n: F.col(f) for n, f in flags.items()}
        ),
        "quantiles",
    )

    size_picks = F.array(*[F.get("q", F.lit(probs.index(Fraction(i, N_SIZE)))) for i in range(N_SIZE + 1)])
    size = found.filter("variable = 'me'").select(
        "sorting_date",
        "population",
        interior_breaks(F.when(F.col("q").isNotNull(), size_picks)).alias("me_breaks"),
    )
    parts = []
    if False in axes.dependent:
        whole = found.filter("variable = 'bm'").drop("variable")
        parts.append(whole.withColumn("portfolio_me", F.lit(0)))
    if True in axes.dependent:
        # one copy of a stock per population it belongs to, on the annual rows only
        copies = sv.join(size, "sorting_date").filter(
            F.col("me_breaks").isNotNull() & _case(F.col("population"), members)
        )
        sized = bin_number(copies, "me", "me_breaks", "portfolio_me", N_SIZE, "left").select(
            "sorting_date", F.col("population").alias("_population"), "portfolio_me", "bm"
        )
        by = ["sorting_date", "_population", "portfolio_me"]
        within = quantiles(sized, "bm", points, by).drop("population")
        parts.append(within.withColumnRenamed("_population", "population"))
    bm = reduce(DataFrame.unionByName, parts)
    return size, stage(_breaks_by_n(bm, axes, probs), "bm-breaks")


def _with_cells(
    sv: DataFrame, size: DataFrame, bm: DataFrame, axes: GridAxes, carry: Sequence[str]
) -> tuple[DataFrame, list[str]]:
    """Add the cell of each stock: its place among all size and all other breaks."""

    def merged(df: DataFrame, breaks: str, out: str) -> DataFrame:
        together = F.flatten(F.collect_list(breaks))
        return df.groupBy("sorting_date").agg(
            F.array_sort(F.array_distinct(together)).alias(out)
        )

    cuts = merged(size, "me_breaks", "me_cuts").join(
        merged(bm, "breaks", "bm_cuts"), "sorting_date", "left"
    )
    per_population = sum(n - 1 for n in axes.n_portfolios) * (1 + N_SIZE)
    n_populations = len(axes.populations)
    cells = sv.join(cuts, "sorting_date")
    cells = count_below(
        cells, "me_cuts", "me", "me_cell", (N_SIZE - 1) * n_populations, inclusive=True
    )
    cells = count_below(
        cells, "bm_cuts", "bm", "bm_cell", per_population * n_populations, inclusive=True
    )
    kept = [f"kept{i}" for i in range(len(axes.exclusions))]
    cells = cells.select(
        "permno",
        "sorting_date",
        "me",
        "bm",
        "me_cell",
        "bm_cell",
        *[_kept(e).alias(name) for e, name in zip(axes.exclusions, kept)],
        *carry,
    )
    return cells, ["sorting_date", "me_cell", "bm_cell", *kept]


def _portfolios_of_cells(
    cells: DataFrame, size: DataFrame, bm: DataFrame, axes: GridAxes
) -> DataFrame:
    """One row per cell and assignment that contains it, with the portfolio."""
    in_sample = {
        axes.population_name(u, e): F.col(f"kept{axes.exclusions.index(e)}")
        for u, e in axes.populations
    }
    copies = cells.join(size, "sorting_date").filter(_case(F.col("population"), in_sample))
    sized = bin_number(copies, "me", "me_breaks", "_size", N_SIZE, "left").withColumn(
        "portfolio_me", F.explode(F.array(F.lit(0), F.col("_size")))
    )
    assignments = sized.join(
        bm.filter(F.col("breaks").isNotNull()), ["sorting_date", "population", "portfolio_me"]
    )
    return bin_number(
        assignments, "bm", "breaks", "portfolio", max(axes.n_portfolios), "left"
    ).withColumn("dependent", F.col("portfolio_me") > 0)


ASSIGNMENT = ["population", "n_portfolios", "dependent"]


def grid_cells(
    sv: DataFrame, axes: GridAxes, carry: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Stocks with their cell, the portfolio of each cell in every assignment, and the cell's columns.

    ``sv`` should be a written table: the breaks and the cells read it again.  The stocks keep the
    columns named by ``carry``.
    """
    sv = sv.withColumns({"me": clean_double(F.col("me")), "bm": clean_double(F.col("bm"))})
    size, bm = _breaks(sv.drop(*carry), axes)
    stocks, cell = _with_cells(sv, size, bm, axes, carry)
    # all stocks of a cell share every portfolio, so any one of them stands for it, and the
    # assignments are evaluated once for all months of the cell
    whole = stocks.groupBy(*cell).agg(F.min("me").alias("me"), F.min("bm").alias("bm"))
    assigned = _portfolios_of_cells(whole, size, bm, axes).select(*cell, *ASSIGNMENT, "portfolio")
    return stocks, assigned, cell


def series_of_cells(sums: DataFrame, assigned: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Monthly value premium of every assignment and weighting, from sums per date and cell or finer."""
    rets = returns_from_sums(
        join_on(sums, assigned, cell).select(*ASSIGNMENT, "sorting_date", "date", "portfolio", *SUMS),
        [*ASSIGNMENT, "sorting_date", "date", "portfolio"],
    )
    keys = [*ASSIGNMENT, "weighting", "sorting_date", "date"]
    return high_minus_low(stack_weightings(rets), by=keys)


def grid_series(sv: DataFrame, returns: DataFrame, axes: GridAxes) -> DataFrame:
    """Monthly value premium of every assignment and weighting over all dates of the samples."""
    stocks, assigned, cell = grid_cells(in_samples(sv, axes), axes)
    return series_of_cells(cell_sums(stocks, returns, cell), assigned, cell)


def spec_series(specs: DataFrame, series: DataFrame) -> DataFrame:
    """The months of each specification: ``spec_id, date, value_premium``."""
    keys = [*ASSIGNMENT, "weighting"]
    months = series.join(specs, keys)
    from_start = F.col("sample_start").isNull() | (F.col("sorting_date") >= F.col("sample_start"))
    to_end = F.col("sample_end").isNull() | (F.col("sorting_date") < F.col("sample_end"))
    return months.filter(from_start & to_end).select("spec_id", "date", "value_premium")


def spec_coverage(sv: DataFrame, axes: GridAxes) -> DataFrame:
    """Stocks in the sample of each specification, and those that set its breaks."""
    specs = spec_grid(sv.sparkSession, axes)
    populations = [
        F.struct(
            F.lit(axes.population_name(u, e)).alias("population"),
            _kept(e).alias("_kept"),
            (in_universe(F.col("exchange"), axes.universes[u]) & _kept(e)).alias("_member"),
        )
        for u, e in axes.populations
    ]
    per_date = (
        in_samples(sv, axes)
        .select("sorting_date", F.inline(F.array(*populations)))
        .filter("_kept")
        .groupBy("population", "sorting_date")
        .agg(F.count("*").alias("_stocks"), F.count_if("_member").alias("_members"))
    )
    from_start = F.col("sample_start").isNull() | (F.col("sorting_date") >= F.col("sample_start"))
    to_end = F.col("sample_end").isNull() | (F.col("sorting_date") < F.col("sample_end"))
    inside = from_start & to_end
    keys = ["spec_id", "n_portfolios", "universe", "weighting", "dependent", "sample"]
    return (
        specs.join(per_date, "population", "left")
        .groupBy(*keys)
        .agg(
            F.coalesce(F.sum(F.when(inside, F.col("_stocks"))), F.lit(0)).alias("n_stocks"),
            F.coalesce(F.sum(F.when(inside, F.col("_members"))), F.lit(0)).alias("n_members"),
        )
    )


def grid_tests(
    series: DataFrame,
    factors: DataFrame,
    axes: GridAxes,
    lag: int = 3,
    small_sample: str = "n/(n-k)",
) -> DataFrame:
    """Two rows per specification: the mean test and the CAPM alpha.

    Every specification of the grid is returned; its estimates are null when no
    month could be computed.  ``_order`` gives the order of the report within
    a ``spec_id``.  ``series`` should be a written table: both tests read it.
    """
    specs = spec_grid(series.sparkSession, axes)
    months = spec_series(specs, series)
    options = {"by": ["spec_id"], "lag": lag, "small_sample": small_sample}
    mean_test = newey_west_mean(months, **options).withColumn("test", F.lit(TESTS[0]))
    alpha_test = capm_alpha(
        months.join(factors.select("date", "mkt_excess"), "date", "left"), **options
    ).withColumn("test", F.lit(TESTS[1]))
    found = mean_test.unionByName(alpha_test)
    names = [F.struct(F.lit(i).alias("_order"), F.lit(t).alias("test")) for i, t in enumerate(TESTS)]
    rows = specs.drop("population", "sample_start", "sample_end").select(
        "*", F.inline(F.array(*names))
    )
    return rows.join(found, ["spec_id", "test"], "left").withColumn(
        "n_obs", F.coalesce("n_obs", F.lit(0))
    )


def run_grid(
    sv: DataFrame,
    returns: DataFrame,
    factors: DataFrame,
    axes: GridAxes | None = None,
    lag: int = 3,
    small_sample: str = "n/(n-k)",
) -> DataFrame:
    """The rows of :func:`grid_tests` from sorting variables and returns."""
    axes = axes or GridAxes()
    # one row per assignment, weighting and month
    series = stage(grid_series(sv, returns, axes), "grid-series")
    return grid_tests(series, factors, axes, lag, small_sample)


def value_premium(
    sv: DataFrame,
    returns: DataFrame,
    factors: DataFrame,
    n_portfolios: int = 5,
    exchanges: Sequence[str] = LISTED,
    value_weighted: bool = True,
    dependent_sort: bool = False,
    lag: int = 3,
    small_sample: str = "n/(n-k)",
) -> DataFrame:
    """Both tests of one specification: two rows ``test, estimate, t_stat``."""
    axes = GridAxes(
        n_portfolios=(n_portfolios,),
        universes={"chosen": exchanges},
        weightings=("value" if value_weighted else "equal",),
        dependent=(dependent_sort,),
        samples=(Sample("full"),),
    )
    rows = run_grid(sv, returns, factors, axes, lag=lag, small_sample=small_sample)
    return rows.select("test", "estimate", "t_stat", "_order")
