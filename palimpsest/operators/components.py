"""Connected components by alternating large-star and small-star steps.

A graph of FEW_EDGES and fewer is solved by one task, which holds it as two arrays.
Of a larger one each step is a grouped minimum with partial sums and a join in which nodes with
very many neighbours are broadcast, so none is held in one task. Every step is
written to the shared folder, which cuts the lineage; steps are as many as the
graph needs (their number grows with the square of its logarithm at most).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.plans.skew import join_counted
from palimpsest.plans.storage import discard, kept


#: Edges that one task holds: 16 bytes each, and as much again for what it works out.
FEW_EDGES = 2_000_000


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the least node reachable from each): roots hook to the least root beside them, then paths are halved."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        hooked = root.copy()
        np.minimum.at(hooked, root[u], root[v])
        np.minimum.at(hooked, root[v], root[u])
        while not np.array_equal(flat := hooked[hooked], hooked):
            hooked = flat
        if np.array_equal(hooked, root):
            return nodes, nodes[root]
        root = hooked


def _solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = [(f["high"].to_numpy(np.int64), f["low"].to_numpy(np.int64)) for f in frames]
    if held:
        nodes, component = least_reachable(np.concatenate([h for h, _ in held]), np.concatenate([w for _, w in held]))
        for k in range(0, len(nodes), 100_000):
            yield pd.DataFrame({"node": nodes[k : k + 100_000], "component": component[k : k + 100_000]})


def _star(edges: DataFrame, n: int, small: bool) -> DataFrame:
    both = edges if small else edges.unionAll(edges.select(F.col("low").alias("high"), F.col("high").alias("low")))
    # in `both`, high is the centre and low its neighbour; small: only smaller neighbours
    least = both.groupBy("high").agg(F.min("low").alias("m"), F.count("*").alias("times")).select("high", F.least("high", "m").alias("m"), "times")
    joined = join_counted(both, least, ["high"], "times", 2 * n)
    if small:
        out = joined.select(F.col("low").alias("high"), F.col("m").alias("low")).unionAll(least.select("high", F.col("m").alias("low")))
    else:
        out = joined.where("low > high").select(F.col("low").alias("high"), F.col("m").alias("low"))
    return out.where("high <> low").distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of an edge; component is the least node reachable.

    Loops and nulls are ignored: a node that has only loops isn't returned. An
    empty table gives an empty table.
    """
    now = kept(edges.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).where(f"{a} is not null and {b} is not null and {a} <> {b}").distinct(), "edges")
    if now.count() <= FEW_EDGES:
        found = kept(now.repartition(1).mapInPandas(_solve, "node long, component long"), "components")
        discard(now)
        return found
    mark = None
    while True:
        row = now.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        if tuple(row) == mark or not row[0]:
            break
        mark = tuple(row)
        large = kept(_star(now, row[0], small=False), "large")
        discard(now)
        now = kept(_star(large, row[0], small=True), "small")
        discard(large)
    roots = now.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    return now.select(F.col("high").alias("node"), F.col("low").alias("component")).unionAll(roots)
