"""Joins that stay balanced when one key holds a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it has more than 1/HOT_PARTS of all rows, so there are fewer than HOT_PARTS hot keys: what is broadcast has that bound.
HOT_PARTS = 1024


def lookup_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Inner join of left with right, whose keys are unique and whose column `weight` counts the rows of left for each key.

    Rows of hot keys meet their one row of right by a broadcast of fewer than HOT_PARTS rows and are never shuffled;
    all others go through an ordinary shuffle join. Null keys match nothing. `weight` is dropped.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    hot_at = max(total / HOT_PARTS, 1000)
    hot = F.broadcast(right.where(F.col(weight) > hot_at).drop(weight))
    rest = right.where(F.col(weight) <= hot_at).drop(weight)
    if total <= 1000:
        return left.join(rest, keys)
    return left.join(hot, keys).unionByName(left.join(hot.select(*keys), keys, "left_anti").join(rest, keys))
