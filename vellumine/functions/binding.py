"""A value computed once inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once per row. Lambdas are interpreted and share no
    subexpressions, so a value used inside one would be computed again for every element."""
    return F.get(F.transform(F.array(value), use), 0)
