"""Settings that bound memory, and joins that move little of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.plans.storage import discard, shared_dir
from palimpsest.plans.storage import kept as stored

__all__ = ["discard", "prepare", "shared_dir", "stored", "with_ids_of"]

#: Rows and bytes of an Arrow batch, so that a task holds little of a table of long texts; a longer text is a batch of its own.
ARROW_ROWS, ARROW_BYTES = 512, 8 << 20


def prepare(spark: SparkSession) -> None:
    """Bounds Arrow batches by rows and bytes for the session, where they are at Spark's defaults."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b") == "67108864b":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


#: 64-bit words of the filter below: its broadcast has so many rows at most, whatever the input.
FILTER_WORDS = 1 << 18


def with_ids_of(df: DataFrame, id_col: str, wanted: DataFrame, wanted_col: str) -> DataFrame:
    """Rows of df whose id may be among the wanted ones, and all of those that are: a hashed bitmap of fixed size is
    broadcast, so that a join that follows moves little of df. Rows of other ids that share a bit stay as well."""
    h = F.xxhash64(F.col(wanted_col).cast("long"))
    bits = wanted.select(F.shiftrightunsigned(h, 46).alias("_word"), F.expr(f"shiftleft(1L, cast(xxhash64(cast({wanted_col} as bigint)) & 63 as int))").alias("_bit"))
    words = bits.groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    own = df.withColumn("_h", F.xxhash64(F.col(id_col).cast("long")))
    hit = own.join(F.broadcast(words), F.shiftrightunsigned("_h", 46) == F.col("_word"))
    return hit.where("_bits & shiftleft(1L, cast(_h & 63 as int)) <> 0").select(*(F.col(c) for c in df.columns))
