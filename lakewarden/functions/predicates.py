"""Format predicates and lenient casts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS_CLASS, strip

# Format patterns.
EMAIL_PATTERN = rf"^[^@{WS_CLASS}]+@[^@{WS_CLASS}]+\.[^@{WS_CLASS}]+$"
EIGHT_DIGITS = "^[0-9]{8}$"
ELEVEN_DIGITS = "^[0-9]{11}$"

DATE_FORMATS = (
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy/MM/dd",
    "dd/MM/yyyy",
)


def matches(col: Column, pattern: str) -> Column:
    """F7 on the trimmed value."""
    return strip(col.cast("string")).rlike(pattern)


def to_number(col: Column) -> Column:
    """F8: a value that is not a number becomes null."""
    return col.try_cast("double")


def to_timestamp(col: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """the first format that fits wins, otherwise null."""
    text = strip(col.cast("string"))
    return F.coalesce(
        *[F.try_to_timestamp(text, F.lit(f)) for f in formats], text.try_cast("timestamp")
    )
