"""A sink for rows of CSV text of their own widths: ``df.write.format("grouped_csv").mode(...).save(folder)``.

Each task writes its rows to a file of its own in a staging folder and tells the driver its name. Commit, which Spark calls
once all tasks have ended well, moves those files to the folder and then writes its list; abort removes the staging folder.
Files of attempts that failed or ran twice are in no task's message, so they never get into the folder, and a reader that
goes by the list sees all rows of a run or none. The folder is one that the driver and all executors mount.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: The list of a folder's files, a name a line, which commit writes last.
LIST = "_files"


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int


class GroupedCsv(DataSource):
    @classmethod
    def name(cls) -> str:
        return "grouped_csv"

    def writer(self, schema, overwrite: bool) -> GroupedCsvWriter:
        if schema.fieldNames() != ["value"]:
            raise ValueError("grouped_csv takes one column of text, value")
        return GroupedCsvWriter(self.options["path"].removeprefix("file://"), overwrite)


class GroupedCsvWriter(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool) -> None:
        self.folder, self.overwrite = folder, overwrite
        self.staging = os.path.join(folder, f"_staging-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator) -> Written:
        os.makedirs(self.staging, exist_ok=True)
        name, rows = f"part-{uuid.uuid4().hex}.csv", 0
        with open(os.path.join(self.staging, name), "w", encoding="utf-8", newline="") as f:
            for row in iterator:
                f.write(row["value"] + "\n")
                rows += 1
        return Written(name, rows)

    def commit(self, messages: list[Written | None]) -> None:
        os.makedirs(self.folder, exist_ok=True)
        old = [] if self.overwrite else listed(self.folder)
        new = [m.name for m in messages if m is not None and m.rows]
        for name in new:
            os.replace(os.path.join(self.staging, name), os.path.join(self.folder, name))
        with open(os.path.join(self.folder, LIST + ".new"), "w") as f:
            f.writelines(f"{name}\n" for name in [*old, *new])
        os.replace(os.path.join(self.folder, LIST + ".new"), os.path.join(self.folder, LIST))
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


def listed(folder: str) -> list[str]:
    """Names of the files that were committed to a folder."""
    try:
        with open(os.path.join(folder, LIST)) as f:
            return f.read().split()
    except FileNotFoundError:
        return []


def write_grouped_csv(rows: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """rows (value), one line of CSV each, to a folder; ``append`` adds to what is there."""
    rows.sparkSession.dataSource.register(GroupedCsv)
    rows.select("value").write.format("grouped_csv").mode(mode).save(os.path.abspath(folder))


def read_grouped_csv(spark: SparkSession, folder: str) -> DataFrame:
    """(value) of the committed lines; a quoted field that holds line ends comes as several lines."""
    names = listed(folder)
    if not names:
        return spark.createDataFrame([], "value string")
    return spark.read.text([f"file://{os.path.abspath(folder)}/{name}" for name in names])
