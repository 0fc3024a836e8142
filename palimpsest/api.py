"""duplicates(), folder_duplicates() and compare(): the library's questions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import groups, join
from palimpsest.sources import files
from palimpsest.spec import DCT, DHASH, HashSpec

__all__ = ["DCT", "DHASH", "compare", "duplicates", "folder_duplicates"]


def _listed(spark: SparkSession, paths: DataFrame | Iterable[str]) -> DataFrame:
    return paths if isinstance(paths, DataFrame) else files.listed(spark, paths)


def duplicates(spark: SparkSession, spec: HashSpec, paths: DataFrame | Iterable[str]) -> tuple[DataFrame, DataFrame]:
    """(members, errors): members are (group_id, ord, id, path, dist), the seed first, then from the farthest.

    paths are strings, or a DataFrame (id, path[, content]). The same path twice is two items at distance 0.
    """
    return _grouped(*files.fingerprints(_listed(spark, paths), spec), spec)


def folder_duplicates(spark: SparkSession, spec: HashSpec, root: str, recursive: bool = False) -> tuple[DataFrame, DataFrame]:
    """duplicates() of a folder's images, in any store that Spark reads, in the order of paths; no file's bytes move."""
    return _grouped(*files.folder_fingerprints(spark, root, spec, recursive), spec)


def _grouped(prints: DataFrame, errors: DataFrame, spec: HashSpec) -> tuple[DataFrame, DataFrame]:
    named = groups.members_of(prints, spec.threshold).join(prints.select("id", "path"), "id")
    return named.select("group_id", "ord", "id", "path", "dist"), errors


def compare(spark: SparkSession, spec: HashSpec, target: str, paths: DataFrame | Iterable[str]) -> tuple[DataFrame, DataFrame]:
    """(matches (id, path, dist) from the farthest, errors). A target that can't be read raises."""
    one, wrong = files.fingerprints(files.listed(spark, [target]), spec)
    if (bad := wrong.first()) is not None:
        raise ValueError(bad["error"])
    prints, errors = files.fingerprints(_listed(spark, paths), spec)
    found = join.probe(one, prints, spec.threshold).join(prints.select("id", "path"), "id")
    return found.select("id", "path", "dist").orderBy(F.desc("dist"), "id"), errors
