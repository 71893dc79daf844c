"""Run the whole study: ``python -m factorloom PANEL FUNDAMENTALS FACTORS OUT``."""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import SparkSession

from .plans import GridAxes, default_samples, run_study


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="factorloom", description="Value premium study")
    parser.add_argument("panel", help="monthly stock panel (Parquet)")
    parser.add_argument("fundamentals", help="annual fundamentals (Parquet)")
    parser.add_argument("factors", help="published monthly factor returns")
    parser.add_argument("out", help="folder for the results")
    parser.add_argument("--factors-format", choices=["parquet", "csv"], default="parquet")
    parser.add_argument("--first-year", type=int, default=1970)
    parser.add_argument("--last-year", type=int, default=2025)
    parser.add_argument("--split", type=dt.date.fromisoformat, default=dt.date(1990, 7, 1))
    given = parser.parse_args(arguments)
    run_study(
        SparkSession.builder.appName("factorloom").getOrCreate(),
        given.panel,
        given.fundamentals,
        given.factors,
        given.out,
        given.factors_format,
        given.first_year,
        given.last_year,
        GridAxes(samples=default_samples(given.split)),
    )


if __name__ == "__main__":
    main()
