"""The exact row at a place of a table's order, without a sort.

Keys are one or more columns of numbers, the first counting most. A column becomes 64-bit words whose order is that of its
values. A pass counts the rows that agree with what is known of the wanted key by the next DIGIT bits of it: tasks add up
first, and at most 2 ** DIGIT counts come to the driver, whatever the table's size. The digit in which the place falls is
known then. Leading bits that all rows share are skipped, so a column of a narrow range takes one pass or two and any column
64 / DIGIT at most. No task and no machine holds the rows, and a hot value costs nothing more than a cold one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, LongType

DIGIT = 16
LOWEST = -(1 << 63)


@F.pandas_udf(LongType())
def _bits_in_order(values: pd.Series) -> pd.Series:
    """Longs in the order of doubles: 0.0 and -0.0 are equal and NaN, of any bits, is the greatest, as in Spark."""
    x = values.to_numpy(np.float64, na_value=np.nan) + 0.0
    bits = np.where(np.isnan(x), np.float64("nan"), x).view(np.int64)
    bits = np.where(np.isnan(x), np.int64(0x7FF8 << 48), bits)
    return pd.Series(np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits))


def value_of_bits(word: int) -> float:
    """The double of a word of _bits_in_order."""
    return float(np.array([word if word >= 0 else word ^ ((1 << 63) - 1)], np.int64).view(np.float64)[0])


def ordered_word(df: DataFrame, name: str, descending: bool = False) -> Column:
    """A long in the order of a column of df, of doubles, floats or whole numbers; null for nulls."""
    c = F.col(name)
    if isinstance(df.schema[name].dataType, (DoubleType, FloatType)):
        word = F.when(c.isNotNull(), _bits_in_order(c.cast("double")))
    else:
        word = c.cast("long")
    return F.bitwise_not(word) if descending else word


def key_at(table: DataFrame, words: list[str], place: int) -> tuple[int, ...] | None:
    """The words of the row at a place (from 0) in the order of columns of longs; None beyond the end. Rows with a null word
    aren't counted. The table is read once a pass, so it should be a stored one."""
    full = table.select(*words).dropna()
    row = full.agg(F.count("*"), *(f(w) for w in words for f in (F.min, F.max))).first()
    if not 0 <= place < row[0]:
        return None
    known: list[int] = []
    for k, w in enumerate(words):
        low, high = (v - LOWEST for v in row[1 + 2 * k : 3 + 2 * k])  # as unsigned numbers
        left = (low ^ high).bit_length()
        word, rest = high >> left, full
        for name, value in zip(words, known, strict=False):
            rest = rest.where(F.col(name) == F.lit(value).cast("long"))
        bits = F.col(w).bitwiseXOR(F.lit(LOWEST))
        while left:
            step = min(DIGIT, left)
            mine = rest if left == 64 else rest.where(F.shiftrightunsigned(bits, left) == F.lit(word).cast("long"))
            digit = F.shiftrightunsigned(bits, left - step).bitwiseAND(F.lit((1 << step) - 1).cast("long"))
            for d, n in sorted(tuple(r) for r in mine.groupBy(digit.alias("d")).agg(F.count("*").alias("n")).collect()):
                if place < n:
                    word, left = (word << step) | d, left - step
                    break
                place -= n
        known.append(word + LOWEST)
    return tuple(known)


def value_at(values: DataFrame, name: str, place: int) -> float | int | None:
    """The value at a place (from 0) of a column in ascending order; None beyond the end. Nulls aren't counted."""
    found = key_at(values.select(ordered_word(values, name).alias("w")), ["w"], place)
    if found is None:
        return None
    return value_of_bits(found[0]) if isinstance(values.schema[name].dataType, (DoubleType, FloatType)) else found[0]
