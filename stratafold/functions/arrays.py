"""Expressions over one bounded array, such as a stored patch or a row of scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v.cast("double"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, by binding it to a lambda variable."""
    return F.transform(F.array(value), body)[0]


def standardise(patch: Column) -> Column:
    """Minus the mean, over the population deviation plus 1e-6."""
    def moved(mean):
        squares = F.aggregate(patch, F.lit(0.0), lambda a, v: a + (v.cast("double") - mean) * (v.cast("double") - mean))
        return let(F.sqrt(squares / F.size(patch)) + 1e-6, lambda spread: F.transform(patch, lambda v: (v.cast("double") - mean) / spread))

    return let(array_sum(patch) / F.size(patch), moved)
