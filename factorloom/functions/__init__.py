"""Column factories shared by the operators."""

from .columns import (
    clean_double,
    equal_weighted,
    governing_july,
    in_universe,
    inner_breaks,
    interior_breaks,
    july_first,
    month_start,
    value_weighted,
)

__all__ = [
    "clean_double",
    "equal_weighted",
    "governing_july",
    "in_universe",
    "inner_breaks",
    "interior_breaks",
    "july_first",
    "month_start",
    "value_weighted",
]
