"""Arrow functions that are made when they are called, so that modules can be imported without a session."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def settled(value: Column) -> Column:
    """The value, computed in a projection of its own.

    An Arrow function must get plain columns: the planner does not find it in an expression with deeply
    nested lambdas. A random number, twice which is never negative (the planner would see through once), keeps projections apart.
    """
    return F.when(F.rand(0) * 2 >= 0, value)


def arrow(kind: str) -> Callable:
    """Decorator: a function of Arrow arrays becomes one of Columns. It is evaluated once for a row, wherever its result is used."""

    def wrap(f: Callable) -> Callable[..., Column]:
        @functools.wraps(f)
        def call(*columns) -> Column:
            return F.arrow_udf(f, kind).asNondeterministic()(*columns)

        call.plain = f
        return call

    return wrap
