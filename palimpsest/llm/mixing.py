"""Mixing sources to target weights by balanced sampling with the cube method.

Each source's weight gives it a target of words; a document's expected number of
copies is target / size of its source, whose fraction is an inclusion
probability. The flight phase of the cube method (Deville and Tille, 2004) moves
the fractional probabilities along directions in the null space of the balancing
constraints, numbers of documents and of words, until all but a few are 0 or 1.
It runs in blocks of a source's documents, so that no task holds a source; what
stays fractional in the blocks (two documents a block at most) meets in blocks
again, level by level, until one small landing problem a source remains. Landing
picks, among all roundings of those, the one nearest to the source's target, and
mends what a large document leaves.

Everything follows from ids and sizes: blocks by fixed hashes, coins from a
generator seeded by a block's sizes. A repeated run takes the same documents.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import prepare, stored

# Weights of sources in code-point order, repeating; share of all words that the mix has; most copies.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
BLOCK_ROWS = 4000
#: Documents left fractional by a block: one for each constraint; and those of a source that landing rounds.
CONSTRAINTS, LANDED = 2, 10
EPS = 1e-9
#: Up to so many rows, what is taken is broadcast as bits, in 500,000 words at most; beyond, it is joined.
MARKED_ROWS = 32_000_000


def source_targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> dict[str | None, float]:
    """Targets of the sources: shares by weight; those above ``most`` times their size stop there and the excess is
    shared again by weight until none is above. Sources of no words get 0."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    total, out = share * sum(sizes.values()), {}
    open_ = list(order)
    while open_:
        left = total - sum(out.values())
        scale = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * scale > most * sizes[s]]
        if not over:
            return out | {s: weight[s] * scale for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
            open_.remove(s)
    return out


def flight(p: np.ndarray, sizes: np.ndarray, leave: int = CONSTRAINTS) -> np.ndarray:
    """Probabilities after the flight phase, in which the sums of p and of p * size stay; so many units at most are left
    fractional, the last of the given order. Each step takes the first fractional unit along the direction nearest to its
    own in the null space of the two constraints: all others move a little, so a large unit is decided while many can
    make up for it, and small ones remain."""
    p, scaled = p.astype(np.float64).copy(), sizes / (float(np.max(sizes, initial=0)) or 1.0)
    open_ = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    coins = np.random.default_rng(zlib.crc32(np.asarray(sizes, np.float64).tobytes()))
    while len(open_) > leave:
        d = scaled[open_] - scaled[open_].mean()
        spread = float(d @ d)
        for first in range(len(open_)):
            u = -1.0 / len(open_) - (d * d[first] / spread if spread > 1e-18 else 0.0) * np.ones(len(open_))
            u[first] += 1
            if u[first] > 1e-9:  # else the constraints hold this unit fast, as one large among equal ones
                break
        else:
            break
        now = p[open_]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.min(np.where(u > 1e-15, (1 - now) / u, np.where(u < -1e-15, now / -u, np.inf)))
            down = np.min(np.where(u > 1e-15, now / u, np.where(u < -1e-15, (1 - now) / -u, np.inf)))
        now = now + (up if coins.random() * (up + down) < down else -down) * u
        p[open_] = np.where(now <= EPS, 0.0, np.where(now >= 1 - EPS, 1.0, now))
        open_ = open_[(now > EPS) & (now < 1 - EPS)]
    return p


def landing(p: np.ndarray, sizes: np.ndarray, words: float) -> np.ndarray:
    """Of all roundings of the fractional units, the one that takes nearest to so many words, and then comes nearest to
    their expected number. Where a large unit still leaves the words off by more than the smallest unit, other units
    change sides, each time the one that mends most, as long as that mends anything."""
    open_ = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    out = np.round(p)
    out[open_] = 0
    every = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
    off, docs = out @ sizes - words + every @ sizes[open_], np.abs((every - p[open_]).sum(axis=1))
    best = np.lexsort((docs, np.round(np.abs(off), 6)))[0]
    out[open_], off = every[best], float(off[best])
    while len(p) and abs(off) > sizes.min():
        after = off + (1 - 2 * out) * sizes
        k = int(np.argmin(np.abs(after)))
        if abs(after[k]) >= abs(off) - 1e-6:
            break
        out[k], off = 1 - out[k], float(after[k])
    return out


def _fly(last: bool):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["size", "order", "unit"], ascending=[False, True, True], kind="stable")
        p, sizes = frame["p"].to_numpy(np.float64), frame["size"].to_numpy(np.float64)
        done = landing(flight(p, sizes, LANDED), sizes, float(p @ sizes)) if last else flight(p, sizes)
        return pd.DataFrame({"unit": frame["unit"], "source": frame["source"], "size": frame["size"], "order": frame["order"], "p": done})

    return run


UNIT = "unit long, source string, size long, order long, p double"


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _taken(sized: DataFrame, weights: tuple[float, ...], share: float, most: float, block_rows: int) -> DataFrame:
    """sized (doc_id, source, size, unit and others; unit a number of the row), a stored table, with source_size, target
    and copies. The driver holds a row a source."""
    spark = sized.sparkSession
    # the order of sources and re-sharing is a fold over them
    sums = {r["source"]: (r["s"], r["n"]) for r in sized.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("n")).toLocalIterator()}
    targets = source_targets({s: v[0] for s, v in sums.items()}, weights, share, most)
    rows = [(s, v[0], float(targets[s]), float(targets[s]) / v[0] if v[0] else 0.0, int(max(1, -(-v[1] // block_rows)))) for s, v in sums.items()]
    plan = spark.createDataFrame(rows, "plan_source string, source_size long, target double, factor double, blocks int")
    joined = sized.join(F.broadcast(plan) if len(rows) <= 10_000 else plan, F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")
    whole = F.floor(F.col("factor") + 1e-12)
    units = joined.where("size > 0").withColumn("p", F.col("factor") - whole).where(f"p > {EPS}")
    left = units.withColumn("order", F.xxhash64("doc_id", "size")).withColumn("block", F.pmod(F.xxhash64("order"), F.col("blocks"))).select("unit", "source", "size", "order", "p", "block")
    chosen = []
    blocks = max([r[4] for r in rows], default=1)
    while True:
        last = blocks <= 1
        flown = stored(left.groupBy("source", "block").applyInPandas(_fly(last), UNIT), "mix-flight")
        chosen.append(flown.where(f"p > 1 - {EPS}").select("unit"))
        if last:
            break
        left = flown.where(f"p > {EPS} and p < 1 - {EPS}")
        blocks = -(-blocks * CONSTRAINTS // block_rows)
        left = left.withColumn("block", F.pmod(F.xxhash64("order"), F.lit(blocks)))
    taken = chosen[0]
    for more in chosen[1:]:
        taken = taken.unionAll(more)
    if sum(r[1] for r in sums.values()) <= MARKED_ROWS:
        # a bit a row, 64 to a word: no row of docs moves
        marks = taken.groupBy(F.shiftright("unit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(unit & 63 as int)))").alias("bits"))
        one = F.expr("coalesce(shiftrightunsigned(bits, cast(unit & 63 as int)) & 1, 0)")
        out = joined.join(F.broadcast(marks), F.shiftright("unit", 6) == F.col("word"), "left").withColumn("one", one).drop("word", "bits")
    else:
        out = joined.join(taken.withColumn("one", F.lit(1)), "unit", "left")
    copies = F.when(F.col("size") > 0, whole + F.coalesce("one", F.lit(0))).otherwise(0).cast("int")
    return out.withColumn("copies", copies).drop("factor", "blocks", "one")


def _sized(docs: DataFrame, *more) -> DataFrame:
    prepare(docs.sparkSession)
    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"), F.monotonically_increasing_id().alias("unit"), *more), "mix-documents")


def mix(docs: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, size, source_size, target, taken), a row per row of docs: taken is the words of its copies.

    A null text has no words; a null source is a source of its own, the last one.
    Rows of repeated ids are taken each for itself. Documents without words take
    none. An empty table gives an empty table.
    """
    out = _taken(_sized(docs), weights, share, most, block_rows)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


#: What mixed_documents() adds to docs' columns.
ADDED = ("size", "source_size", "target", "taken", "copies")


def mixed_documents(docs: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows of docs that the mix takes, with docs' columns and size, source_size, target, taken and copies: as mix()
    has it for the same rows. Rows taken no times go; rows of null and of repeated ids each have their own result.
    Where docs has a column of one of these names, it stays and the new one has ``mix_`` before its name."""
    held = _sized(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    out = _taken(held, weights, share, most, block_rows).where("copies > 0").withColumn("taken", (F.col("size") * F.col("copies")).cast("long"))
    name = lambda c: name(f"mix_{c}") if c.lower() in (x.lower() for x in docs.columns) else c
    return out.select("doc.*", *(F.col(c).alias(name(c)) for c in ADDED))
