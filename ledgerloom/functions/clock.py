"""Column functions over time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# Length of a time step, and the bounds that tell steps, seconds and milliseconds apart.
STEP_SECONDS = 10800
STEPS_BELOW = 1_000_000
MILLIS_ABOVE = 1e11


def epoch_us(c: Column | str) -> Column:
    return F.unix_micros(col(c).cast("timestamp"))


def to_utc(c: Column | str, fallback: Column | None = None) -> Column:
    """Text or number to a UTC timestamp; numbers over 1e11 are milliseconds."""
    text = F.trim(col(c).cast("string"))
    number = text.try_cast("double")
    seconds = F.when(number > MILLIS_ABOVE, number / 1000.0).otherwise(number)
    from_number = F.when(number.isNotNull(), F.timestamp_micros((seconds * 1e6).cast("long")))
    parsed = F.coalesce(from_number, text.try_cast("timestamp"))
    return parsed if fallback is None else F.coalesce(parsed, fallback)


def to_epoch(c: Column | str, steps: bool = True) -> Column:
    """Epoch seconds as double; small numbers are three-hour steps when `steps`."""
    text = F.trim(col(c).cast("string"))
    number = text.try_cast("double")
    scaled = F.when(number < STEPS_BELOW, number * STEP_SECONDS).otherwise(number) if steps else number
    return F.coalesce(scaled, F.unix_micros(text.try_cast("timestamp")) / 1e6)


def to_epoch_us(c: Column | str, steps: bool = True) -> Column:
    return F.round(to_epoch(c, steps) * 1e6).cast("long")
