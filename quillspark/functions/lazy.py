"""Vectorised UDFs that need no session until they are used."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def lazy_udf(kind: str) -> Callable:
    """A vectorised function of columns with this result type (DDL)."""

    def over(f: Callable) -> Callable[..., Column]:
        @wraps(f)
        def call(*columns: Column | str) -> Column:
            return F.pandas_udf(f, kind)(*columns)

        return call

    return over


def lazy_arrow_udf(kind: str) -> Callable:
    """The same over Arrow arrays, where rows as Python objects would take too much memory."""

    def over(f: Callable) -> Callable[..., Column]:
        @wraps(f)
        def call(*columns: Column | str) -> Column:
            return F.arrow_udf(f, kind)(*columns)

        return call

    return over
