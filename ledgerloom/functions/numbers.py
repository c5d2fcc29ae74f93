"""Rounding of reported figures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def snap(c: Column | str, digits: int) -> Column:
    """Round half up after removing float noise below nine digits.

    Sums of doubles depend on shuffle order in their last bits; without the first step a value that
    sits on a decimal tie could round either way from run to run.
    """
    return F.round(F.round(c, 9), digits)
