"""Exact radius joins over a metric partition.

PIVOTS fingerprints that lie far from each other are picked from a bounded sample of SAMPLE kinds, those of the least
hashes. Each kind lives with its nearest pivot, in the ring of its distance to it. By the triangle inequality, what is
within radius r of x lives with a pivot q only if d(x, q) <= d(x, x's own pivot) + 2 r, and there in rings that
d(x, q) - r .. d(x, q) + r touch; x visits those that are lived in and no others. The sample decides how much is skipped,
never what is found. This is for small radii: where 2 r reaches from most rows to most pivots, blocks are cheaper. A ring of many kinds is cut into blocks, so that no task holds more than some of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from palimpsest.operators.join import BLOCK_ROWS, in_cells, items_of, kinds_of, unsigned, words_of
from palimpsest.plans.storage import kept

SAMPLE, PIVOTS, RING = 10_000, 64, 4
#: Residents and visitors that a task compares, about.
TASK_ROWS = 50_000


def far_apart(words: list[np.ndarray], n: int) -> list[np.ndarray]:
    """Up to n rows of a sample, each the farthest from those before; the first row is the first one."""
    to = lambda i: sum(np.bitwise_count(w ^ w[i]).astype(np.int32) for w in words)
    picked = [0]
    near = to(0)
    while len(picked) < n and near.max() > 0:
        picked.append(int(near.argmax()))
        near = np.minimum(near, to(picked[-1]))
    return [w[picked] for w in words]


def pivots_of(kinds: DataFrame, n: int = PIVOTS) -> list[np.ndarray]:
    """The words of n pivots or fewer, from the SAMPLE kinds of the least hashes."""
    words = words_of(kinds)
    sample = kinds.select(*words).orderBy(F.xxhash64(*words), *words).limit(SAMPLE).toArrow()
    return far_apart([sample[w].to_numpy().view(np.uint64) for w in words], n) if sample.num_rows else []


def _apart(batch: pa.RecordBatch, words: list[str], pivots: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distances to all pivots, the nearest pivot, its ring) of each row."""
    d = sum(np.bitwise_count(w[:, None] ^ p[None]).astype(np.int32) for w, p in zip(unsigned(batch, words), pivots, strict=True))
    home = d.argmin(axis=1)
    return d, home, d[np.arange(len(d)), home] // RING


def _at_home(words: list[str], pivots: list[np.ndarray]):
    """How many rows of a task live in each ring (k, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lives = np.zeros((len(pivots[0]), 64 * len(words) // RING + 1), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                _, home, ring = _apart(whole.slice(at, 4096), words, pivots)
                np.add.at(lives, (home, ring), 1)
        k, v = np.nonzero(lives)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(v, pa.int32()), pa.array(lives[k, v])], ["k", "v", "n"])

    return run


def _placed(words: list[str], pivots: list[np.ndarray], lived_in: np.ndarray, radius: int):
    """Rows (k, v, side, id, words): where each row lives (side 0: pivot, ring) and what it visits (side 1), of the rings
    that are lived in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.arange(lived_in.shape[1]) * RING  # the least distance of each ring
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                d, home, ring = _apart(batch, words, pivots)
                own = d[np.arange(len(d)), home]
                near = lived_in[None] & (d <= (own + 2 * radius)[:, None])[..., None]
                near &= (low <= (d + radius)[..., None]) & (low + RING > (d - radius)[..., None])
                row, k, v = np.nonzero(near)
                side, take = np.repeat([0, 1], [len(d), len(row)]), pa.array(np.concatenate([np.arange(len(d)), row]))
                out = [pa.array(np.concatenate(x), pa.int32()) for x in ((home, k), (ring, v))]
                yield pa.RecordBatch.from_arrays([*out, pa.array(side, pa.int32()), *(batch.column(c).take(take) for c in ("id", *words))], ["k", "v", "side", "id", *words])

    return run


def placed(kinds: DataFrame, threshold: float) -> DataFrame:
    """(k, v, side, id, words), stored: residents and visitors of the rings (pivot k, ring v)."""
    words, radius, pivots = words_of(kinds), int(-(-threshold // 1)) - 1, pivots_of(kinds)
    lived_in = np.zeros((len(pivots[0]), 64 * len(words) // RING + 1), bool)
    for k, v in kinds.select("id", *words).mapInArrow(_at_home(words, pivots), "k int, v int, n long").groupBy("k", "v").agg(F.sum("n")).select("k", "v").collect():
        lived_in[k, v] = True  # PIVOTS times the rings at most
    schema = StructType.fromDDL("k int, v int, side int").add(kinds.schema["id"])
    for w in words:
        schema = schema.add(kinds.schema[w])
    return kept(kinds.select("id", *words).mapInArrow(_placed(words, pivots, lived_in, radius), schema), "placed")


def rings(rows: DataFrame) -> DataFrame:
    """(k, v, residents, visitors) of the rings in which anything lives: PIVOTS * 129 / RING at most."""
    count = lambda side: F.sum((F.col("side") == side).cast("long"))
    return rows.groupBy("k", "v").agg(count(0).alias("residents"), count(1).alias("visitors")).where("residents > 0")


def linked_by_pivots(fingerprints: DataFrame, threshold: float) -> DataFrame:
    """(a, b, dist) as of join.linked_kinds(), by visits."""
    kinds = kept(kinds_of(fingerprints), "kinds")
    copies = items_of(fingerprints, kinds).where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(0).alias("dist"))
    if not kinds.limit(1).count() or threshold <= 1:  # different fingerprints are one bit apart at least
        return copies
    words, rows = words_of(kinds), placed(kinds, threshold)
    size = kept(rings(rows), "rings").where("visitors > 0").withColumn("blocks", F.ceil(F.greatest("residents", "visitors") / BLOCK_ROWS).cast("int"))
    moved = size.agg(F.coalesce(F.sum((F.col("residents") + F.col("visitors")) * F.col("blocks")), F.lit(0))).first()[0]
    met = in_cells(rows.join(F.broadcast(size.select("k", "v", "blocks")), ["k", "v"]), True, words, threshold, ["k", "v"], 4 + moved // TASK_ROWS)
    # x visits where y lives and y where x does: the visit to the one of the smaller id counts
    return met.where("a < b").unionAll(copies)
