"""Memory of Python worker processes.

Batches of whole texts are short, as a batch lies in the memory of Spark and of the worker at once.
Workers wait for their next task with all that the C library and Arrow keep of freed memory, so an
executor would hold the peaks of tasks long ended beside those of its own heap.
"""

from __future__ import annotations

import ctypes
import functools
import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows of whole texts that a Python function gets at a time.
TEXT_ROWS = 1000

_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def give_back() -> None:
    """Return what this process has freed to the system."""
    pa.default_memory_pool().release_unused()
    # other C libraries have no such function
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim:
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a function over batches, with freed memory given back at the end of each task."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return wrapped


@contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """Let the Python functions of queries that run inside get at most ``TEXT_ROWS`` rows at a time."""
    before = spark.conf.get(_BATCH_ROWS)
    # no bound is written as zero or less
    if not 0 < int(before) <= TEXT_ROWS:
        spark.conf.set(_BATCH_ROWS, str(TEXT_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_ROWS, before)
