"""Order without a global sort: identifier ranges whose borders are identifiers of the table itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.content_sort import range_of


def id_borders(df: DataFrame, id_col: str, ranges: int) -> tuple[object, list]:
    """(smallest id or None, ascending border ids above it): ranges of about equal row counts.

    Reads the id column alone. Null ids belong before all others, to the first range.
    """
    shares = [k / ranges for k in range(1, ranges)] or [0.5]
    row = df.agg(
        F.min(id_col).alias("low"),
        F.percentile_approx(id_col, F.array(*map(F.lit, shares)), F.lit(max(10_000, 20 * ranges))).alias("cuts"),
    ).first()
    cuts = sorted({c for c in row["cuts"] or [] if c > row["low"]}) if ranges > 1 else []
    return row["low"], cuts


def id_range(col: Column, cuts: list) -> Column:
    """The number of the range that an id lies in; null: 0."""
    return F.coalesce(range_of(col, [F.lit(c) for c in cuts]), F.lit(0))
