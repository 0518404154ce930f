"""Column functions; everything here stays inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once.

    An expression that is mentioned n times in another is computed n times
    inside lambdas and conditions; a one-element array binds it instead.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
