"""Joins with keys that may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key of more than one in so many rows is hot, and so is none of so few rows: hot keys are no more than this.
HOT_KEYS, FEW_ROWS = 10_000, 1000


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], times: str, rows: int, how: str = "inner", *, most: int | None = None) -> DataFrame:
    """left joined with right, which has one row a key and, in ``times``, how many of left's ``rows`` rows have the key. Hot
    keys are joined where left's rows are, by a broadcast of HOT_KEYS rows at most; only the others are shuffled. most:
    what no key's ``times`` exceeds, if that is known; where it says that no key is hot, this is a plain join of one scan."""
    limit = max(FEW_ROWS, rows // HOT_KEYS)
    if min(rows, rows if most is None else most) <= limit:
        return left.join(right, keys, how)
    hot = right.where(F.col(times) > limit)
    here = left.join(F.broadcast(hot), keys)
    moved = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right.where(F.col(times) <= limit), keys, how)
    return here.unionByName(moved)
