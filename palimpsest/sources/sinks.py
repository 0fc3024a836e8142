"""What is done with groups: CSV rows, and moving, linking or deleting files. Files change on the driver only, never in a
task that might run twice."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.columns import base_name, csv_row, group_dir


# What is said before the rows.
NONE, FOUND, OF_TARGET = "No duplicate images found", "These {} images are duplicates", "These {} images are duplicates of {}"


def csv_rows(groups: DataFrame, members: str = "paths") -> DataFrame:
    """(group_id, value): a row of fields for each group, of its own width."""
    return groups.select("group_id", csv_row(F.col(members)).alias("value"))


def write_csv(groups: DataFrame, path: str, members: str = "paths") -> None:
    csv_rows(groups, members).orderBy("group_id").select("value").write.text(path)


def total(members: DataFrame) -> DataFrame:
    """Rows of all groups' members; one in two groups counts twice."""
    return members.agg(F.count("*").alias("total"))


def move_plan(members: DataFrame, folder: str) -> DataFrame:
    """(group_id, source, target) from (group_id, path): a folder for each group."""
    return members.select("group_id", F.col("path").alias("source"), F.concat_ws("/", group_dir(folder, F.col("group_id")), base_name(F.col("path"))).alias("target"))


def delete_plan(members: DataFrame, every: bool = False) -> DataFrame:
    """Distinct paths to delete: all but each group's first, or all. A path that is first in a group and also further down
    goes only if ``every``: otherwise its only file would be lost."""
    if every:
        return members.select("path").distinct()
    keep = members.where("ord = 0").select("path").distinct()
    return members.where("ord > 0").select("path").distinct().join(keep, "path", "left_anti")


def summary(n: int, target: str | None = None) -> str:
    if n == 0:
        return NONE
    return OF_TARGET.format(n, target) if target else FOUND.format(n)


def summary_line(total: Column) -> Column:
    """The same of a column of numbers, without a target."""
    return F.when(total == 0, NONE).otherwise(F.format_string(FOUND.replace("{}", "%d"), total))


def _each(items: Iterable, act) -> list[OSError]:
    errors = []
    for item in items:
        try:
            act(item)
        except OSError as x:
            errors.append(x)
    return errors


def move_files(paths: Iterable[str], folder: str) -> list[OSError]:
    """Errors don't stop the rest; a file of the same name in the folder is replaced."""
    os.makedirs(folder, mode=0o750, exist_ok=True)
    return _each(paths, lambda p: os.replace(p, os.path.join(folder, os.path.basename(p))))


def link_files(paths: Iterable[str], folder: str) -> list[OSError]:
    """Hard links, so on one file system only; an existing name is an error."""
    os.makedirs(folder, mode=0o750, exist_ok=True)
    return _each(paths, lambda p: os.link(p, os.path.join(folder, os.path.basename(p))))


def delete_files(paths: Iterable[str]) -> list[OSError]:
    return _each(paths, os.remove)
