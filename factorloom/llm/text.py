"""Words and row keys that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Bytes of UTF-8 that belong to a word once A-Z are lower case; all others separate words.
_WORD_BYTES = bytes(
    b + 32 if chr(b) in UPPER else b if chr(b).isalnum() and b < 128 or b >= 128 else 32
    for b in range(256)
)

#: The same separators as a Java regular expression over lower-cased text.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all other letters as they are."""
    only_ascii = F.octet_length(text) == F.char_length(text)
    return F.when(only_ascii, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words(text: Column) -> Column:
    """Array of the words of a text; empty without a text."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def word_list(text: str | None) -> list[bytes]:
    """The same words for Python code, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


def keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """``doc_id``, a hash of the text, and ``more``.

    Results that depend on a text alone are joined back on both columns, null-safe, so rows that
    repeat a ``doc_id`` each keep their own result.
    """
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_key"),
        *more,
    )


def same_row(left: DataFrame, right: DataFrame) -> Column:
    """Join condition on the columns that ``keyed`` adds."""
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["text_key"] == right["text_key"])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded_side(table: DataFrame, max_rows: int) -> DataFrame:
    """``table`` marked for broadcast if it holds at most ``max_rows`` rows, else as it is.

    A join with the result is right either way; beyond the bound Spark shuffles both sides.
    ``table`` should be a written table, as its rows are counted.
    """
    return F.broadcast(table) if table.count() <= max_rows else table
