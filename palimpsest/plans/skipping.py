"""Anti-joins that move only rows that may go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a key's hash that choose a 64-bit word of the bitmap: it has 2 ** 18 words at most, whatever the input.
WORD_BITS = 18
#: So many keys are broadcast themselves.
KEYS = 500_000


def bitmap(keys: DataFrame, key: str) -> DataFrame:
    """(_word, _bits): a bit for the hash of each key, 2 MiB of words at most; null keys set none."""
    h = F.xxhash64(key)
    bits = keys.where(F.col(key).isNotNull()).select(F.shiftrightunsigned(h, 64 - WORD_BITS).alias("_word"), F.expr(f"shiftleft(1L, cast(xxhash64(`{key}`) & 63 as int))").alias("_bit"))
    return bits.groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is not among gone's; rows of a null key stay.

    Up to KEYS distinct keys are broadcast, and no row of df moves. Of more, a bitmap of fixed size is broadcast: rows
    whose bit is clear stay where they are, and only the others are shuffled for the exact anti-join, which decides. Very
    many keys set most bits, so that more rows move, up to all of them; the result is the same. df and gone are read
    twice: give stored tables.
    """
    gone = gone.select(F.col(key).cast(df.schema[key].dataType).alias(key)).distinct()
    if gone.limit(KEYS + 1).count() <= KEYS:
        return df.join(F.broadcast(gone), key, "left_anti").select(*(F.col(f"`{c}`") for c in df.columns))
    marked = df.withColumn("_skip_hash", F.xxhash64(key)).join(F.broadcast(bitmap(gone, key)), F.shiftrightunsigned("_skip_hash", 64 - WORD_BITS) == F.col("_word"), "left")
    maybe = F.expr("coalesce(_bits & shiftleft(1L, cast(_skip_hash & 63 as int)), 0L) <> 0")
    columns = [F.col(f"`{c}`") for c in df.columns]
    return marked.where(~maybe).select(*columns).unionAll(marked.where(maybe).select(*columns).join(gone, key, "left_anti").select(*columns))
