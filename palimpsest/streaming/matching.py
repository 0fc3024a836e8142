"""An extension: new fingerprints as they arrive are matched with a stored table, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import join


def match_batch(new: DataFrame, stored_path: str, links_path: str, threshold: float, batch: int) -> None:
    """Writes links of the batch with itself and with what was stored before, whose rows aren't compared again, then the
    batch. A batch that runs again
    overwrites its own folders, so its rows appear once."""
    spark = new.sparkSession
    words = join.words_of(new)
    rows = new.select("id", *words)
    try:
        before = spark.read.option("basePath", stored_path).parquet(stored_path).where(F.col("batch") < batch).select("id", *words)
    except Exception as x:  # no batch has been stored yet
        if "PATH_NOT_FOUND" not in str(x) and "UNABLE_TO_INFER_SCHEMA" not in str(x):
            raise
        before = rows.limit(0)
    links = join.within(rows, threshold).unionAll(join.between(rows, before, threshold)).distinct()
    links.write.mode("overwrite").parquet(f"{links_path}/batch={batch}")
    rows.write.mode("overwrite").parquet(f"{stored_path}/batch={batch}")


def match_stream(stream: DataFrame, stored_path: str, links_path: str, threshold: float, checkpoint: str):
    return stream.writeStream.foreachBatch(lambda df, n: match_batch(df, stored_path, links_path, threshold, n)).option("checkpointLocation", checkpoint)


def links(spark: SparkSession, links_path: str) -> DataFrame:
    return spark.read.parquet(links_path).select("a", "b", "dist")
