"""Intermediate tables in the folder that spark.checkpoint.dir names, so that lost executors cost nothing that is done."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, SparkSession] = {}
#: Tables of the passing() block that is open.
_made: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where that is unset: a new temporary one in local mode, as in tests; an
    error on a cluster, whose machines don't see each other's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("palimpsest.shared.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("palimpsest.shared.dir", found)
    return found.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder as Parquet and reads it again: later steps don't depend on executors that held it,
    and nothing is computed twice. Removed by discard(), at the end of a passing() block, or when the
    application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/palimpsest/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _own[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    if (made := _made.get()) is not None:
        made.append(out)
    return out


@contextmanager
def passing() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that kept() makes inside are removed at the end of the block, also after an error, but for those that went
    through the function that it gives: these stay, or belong to the block around this one. What a block returns must
    read such tables alone."""
    outer, made = _made.get(), []
    token = _made.set(made)

    def lasting(df: DataFrame) -> DataFrame:
        made[:] = [x for x in made if x is not df]
        if outer is not None:
            outer.append(df)
        return df

    try:
        yield lasting
    finally:
        _made.reset(token)
        discard(*made)


def discard(*tables: DataFrame) -> None:
    """Removes tables made by kept() that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_kept_at", None)
        if path in _own:
            _delete(_own.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _end() -> None:
    for path, spark in _own.items():
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended already
            return


atexit.register(_end)
