"""Names for values inside column expressions."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` written, and evaluated, once."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def rounded(value: Column, digits: int) -> Column:
    """A double to ``digits`` digits by its product with their power of ten, half away from zero, as DuckDB does; ``F.round`` goes by the decimal."""
    whole = lambda v: F.when(F.abs(v - F.rint(v)) == 0.5, v + F.signum(v) * 0.5).otherwise(F.rint(v))
    return let(value * F.lit(10.0**digits), whole) / F.lit(10.0**digits)


def bound(f):
    """Binds every column argument, so that a function may use it often without its expression growing."""

    @functools.wraps(f)
    def g(*args, **more):
        def go(done: list, rest: list) -> Column:
            if not rest:
                return f(*done, **more)
            x, *others = rest
            if isinstance(x, Column):
                return let(x, lambda v: go([*done, v], others))
            return go([*done, x], others)

        return go([], list(args))

    return g
