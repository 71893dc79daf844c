"""Readers, writers and the panel derived from order tables."""

from .order_tables import MarketTables, market_tables
from .sorting_table import SORTING_VARIABLES, load_sorting_table, write_sorting_table
from .tables import (
    FACTORS,
    FUNDAMENTALS,
    STOCK_PANEL,
    by_calendar_month,
    conform,
    load_factors,
    load_fundamentals,
    load_stock_panel,
    read_factors,
    tidy_factors,
    write_report,
    write_table,
)

__all__ = [
    "FACTORS",
    "FUNDAMENTALS",
    "SORTING_VARIABLES",
    "STOCK_PANEL",
    "MarketTables",
    "by_calendar_month",
    "conform",
    "load_factors",
    "load_fundamentals",
    "load_sorting_table",
    "load_stock_panel",
    "market_tables",
    "read_factors",
    "tidy_factors",
    "write_report",
    "write_sorting_table",
    "write_table",
]
