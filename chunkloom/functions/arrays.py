"""Small helpers over array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often the body uses it, in lambdas too.

    An ordinary column may be inlined by the optimizer where it is used, and then a lambda computes it for
    every element; a lambda's own variable never is.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def percentile(values: Column, q: float) -> Column:
    """Linear-interpolated percentile (q from 0 to 1) of an array, nulls left out; null of an empty one."""

    def pick(v: Column) -> Column:
        at = F.lit(q) * (F.size(v) - 1)
        low, high = F.get(v, F.floor(at).cast("int")), F.get(v, F.ceil(at).cast("int"))
        return low + (high - low) * (at - F.floor(at))

    return let(F.array_sort(F.filter(values, lambda x: x.isNotNull())), pick)
