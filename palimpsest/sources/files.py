"""Lists of image files and their decoding to fingerprints."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.columns import IMAGE_EXTENSIONS
from palimpsest.functions.raster import hashes
from palimpsest.plans.numbering import numbered
from palimpsest.plans.storage import kept
from palimpsest.sources import gif, jpeg, png
from palimpsest.spec import HashSpec

FILES = "id long, path string"
_HASHED = "id long, path string, w0 long, w1 long, error string"
#: Bytes of files that are passed on together.
BATCH_BYTES = 32 << 20


def is_image_name(name: str) -> bool:
    return "." in name and name[name.rfind(".") :] in IMAGE_EXTENSIONS


def find_images(root: str, recursive: bool = False) -> list[str]:
    """What is named like an image below a local folder, the folder itself and folders among it, in lexical order. The
    first folder that can't be read ends the list."""
    out = [root] if is_image_name(os.path.basename(os.path.normpath(root))) else []
    todo = [_entries(root)]
    while todo:
        try:
            entry = next(todo[-1], None)
            if entry is None:
                todo.pop()
                continue
            if is_image_name(entry.name):
                out.append(entry.path)
            if recursive and entry.is_dir(follow_symlinks=False):
                todo.append(_entries(entry.path))
        except OSError:
            break
    return out


def _entries(folder: str) -> Iterator[os.DirEntry]:
    """In order; what goes wrong is raised when the first is asked for."""
    yield from sorted(os.scandir(folder), key=lambda e: e.name)


def image_or_dir(path: str) -> tuple[str, bool, bool]:
    """(absolute path, whether it is an image file, whether it is a folder)."""
    full = os.path.abspath(path) if path else ""
    if not path or not os.path.exists(path):
        return full, False, False
    folder = os.path.isdir(path)
    return full, not folder and is_image_name(os.path.basename(path)), folder


def expand(targets: Iterable[str], recursive: bool = False) -> list[str]:
    """Files of all targets in order; what is neither an image nor a folder is passed over. Repeats stay."""
    out = []
    for t in targets:
        _, image, folder = image_or_dir(t)
        out += [t] if image else find_images(t, recursive) if folder else []
    return out


def listed(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """Files (id, path): ids from 1 in the given order, whatever their extension."""
    return spark.createDataFrame([(i, p) for i, p in enumerate(paths, 1)], FILES)


def listed_paths(line: Column) -> Column:
    """The paths of a line of a list, split at single spaces; empty ones go."""
    return F.filter(F.split(line, " "), lambda p: p != "")


def list_from_text(spark: SparkSession, path: str) -> DataFrame:
    """(path) of a text file's lines."""
    return spark.read.text(path).select(F.explode(listed_paths(F.col("value"))).alias("path"))


def _folder(spark: SparkSession, root: str, recursive: bool) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*{.png,.jpg,.jpeg}").option("recursiveFileLookup", str(recursive).lower()).load(root)


def folder_files(spark: SparkSession, root: str, recursive: bool = False) -> DataFrame:
    """(id, path, length) of the images of a folder in any store that Spark reads, numbered in the order of paths. No file is
    opened, and the driver holds no list."""
    return numbered(_folder(spark, root, recursive).select("path", "length"), "path", "id", 1).select("id", "path", "length")


def folder_fingerprints(spark: SparkSession, root: str, spec: HashSpec, recursive: bool = False) -> tuple[DataFrame, DataFrame]:
    """fingerprints() of the images of a folder. A file's bytes are read once, by the task that decodes them, and stay there:
    its words and path alone go on to be numbered."""
    done = _folder(spark, root, recursive).select(F.lit(0).cast("long").alias("id"), "path", "content", F.lit(None).cast("string").alias("error"))
    hashed = done.mapInPandas(_hasher(spec.name), _HASHED).drop("id")
    return _parted(numbered(hashed, "path", "id", 1), spec)


def contents(files: DataFrame) -> DataFrame:
    """files with their bytes, read by tasks from a file system that all executors mount; null and an error where that fails."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows, size = [], 0
            for i, p in zip(frame["id"], frame["path"], strict=True):
                try:
                    with open(p.removeprefix("file://"), "rb") as f:
                        rows.append((i, p, f.read(), None))
                    size += len(rows[-1][2])
                except OSError as x:
                    rows.append((i, p, None, f"unable to load {p}: {x}"))
                if size > BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=["id", "path", "content", "error"])
                    rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=["id", "path", "content", "error"])

    return files.mapInPandas(run, "id long, path string, content binary, error string")


#: Decoders by how files of their kind begin.
DECODERS = ((png.SIGNATURE, png.decode), (b"\xff\xd8", jpeg.decode), (b"GIF8", gif.decode))


def decode(content: bytes) -> np.ndarray:
    """A raster from the bytes of a file, whose kind is that of its first bytes, whatever its name."""
    for begins, run in DECODERS:
        if content.startswith(begins):
            return run(content)
    raise ValueError("unknown format")


def _hasher(name: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for i, p, content, error in zip(frame["id"], frame["path"], frame["content"], frame["error"], strict=True):
                words: list[int] = []
                if content is not None and error is None:
                    try:
                        words = hashes(name, decode(bytes(content)))
                    except Exception as x:  # a broken file stops nothing but itself
                        error = f"unable to load {p}: {x}"
                rows.append((i, p, words[0] if words else None, words[1] if len(words) > 1 else None, error))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            # words beside nulls would become floating-point numbers in between
            yield pd.DataFrame({"id": columns[0], "path": columns[1], "w0": pd.array(columns[2], "Int64"), "w1": pd.array(columns[3], "Int64"), "error": columns[4]})

    return run


def fingerprints(files: DataFrame, spec: HashSpec) -> tuple[DataFrame, DataFrame]:
    """(fingerprints (id, path, w0[, w1]), errors (id, path, error)) of files (id, path[, content, error]).

    Files are decoded by the task that reads them, once. A file that fails is an
    error row and doesn't stop the rest; a null content without a note of an error
    has no fingerprint and no error.
    """
    held = files if "content" in files.columns else contents(files)
    if "error" not in held.columns:
        held = held.withColumn("error", F.lit(None).cast("string"))
    return _parted(kept(held.select("id", "path", "content", "error").mapInPandas(_hasher(spec.name), _HASHED), "fingerprints"), spec)


def _parted(done: DataFrame, spec: HashSpec) -> tuple[DataFrame, DataFrame]:
    words = ["w0", "w1"][: spec.words]
    return done.where("error is null").select("id", "path", *words), done.where("error is not null").select("id", "path", "error")
