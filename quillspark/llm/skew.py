"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy when it holds over 1 / HEAVY_KEYS of all rows; so there are fewer than HEAVY_KEYS.
HEAVY_KEYS = 1000


def join_counted(facts: DataFrame, dim: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of facts with dim, one row a key, whose column count says how many facts have it.

    Heavy keys, fewer than HEAVY_KEYS by definition, are broadcast, so that their facts stay where
    they are; the others are shuffled. facts is read twice: stage it first.
    """
    is_heavy = F.col(count) * HEAVY_KEYS > F.lit(total)
    heavy = F.broadcast(dim.where(is_heavy))
    light = dim.where(~is_heavy)
    hot = facts.join(heavy, key)
    cold = facts.join(F.broadcast(dim.where(is_heavy).select(key)), key, "left_anti").join(light, key)
    return hot.unionByName(cold).drop(count)
