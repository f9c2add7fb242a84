"""BM25 (Robertson et al.) and score rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def idf(n: Column, df: Column) -> Column:
    """ln((n - df + 0.5) / (df + 0.5)): below zero for terms in more than half of the passages."""
    return F.log((n - df + 0.5) / (df + 0.5))


def contribution(weight: Column, freq: Column, length: Column, average: Column) -> Column:
    """A term's share of a passage's score, never below zero; zero where the average length is zero."""
    relative = F.when(average > 0, length / average).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), weight * (K1 + 1) * freq / (K1 * (1 - B + B * relative) + freq))


def up_to_float(value: Column) -> Column:
    """The least float at or above a non-negative double, so that it stays an upper bound."""
    near = value.cast("float")
    return F.when(near.cast("double") < value, (near.cast("double") * (1 + 0.75 * 2.0**-23)).cast("float")).otherwise(near)
