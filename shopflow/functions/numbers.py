"""Numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_avg(name: str) -> Column:
    """Mean of a double column summed as decimals and divided once, so that the order in which
    partitions are added can't change a digit."""
    return F.sum(F.col(name).cast("decimal(28,12)")).cast("double") / F.nullif(F.count(F.col(name)), F.lit(0))
