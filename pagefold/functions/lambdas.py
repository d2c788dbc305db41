"""What lambdas over arrays share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value as a lambda's argument, so that it is computed, and stands in the plan, once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def best(xs: Column, score: Callable[[Column], Column]) -> Column:
    """The element with the largest score, the first of equals; null for an empty array."""
    return F.array_max(F.transform(xs, lambda x, i: F.struct(score(x).alias("score"), (-i).alias("minus"), x.alias("x"))))["x"]
