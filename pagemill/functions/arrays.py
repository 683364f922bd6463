"""Column functions on arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often and in whatever lambda f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def count_at_most(values: Column, x: Column) -> Column:
    """How many elements of an ascending array are at most x, by binary search."""
    steps = F.sequence(F.floor(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"), F.lit(0), F.lit(-1))
    power = lambda b: F.call_function("shiftleft", F.lit(1), b)
    return F.aggregate(steps, F.lit(0), lambda at, b: F.when((at + power(b) <= F.size(values)) & (F.get(values, at + power(b) - 1) <= x), at + power(b)).otherwise(at))
