"""The k nearest items of many queries, exactly.

Queries go to blocks, items to chains, and a task takes one block through one chain: it holds the block's queries with the
k best items of each so far and reads the chain's items tile by tile. The distance of a query's k-th best is its radius,
which only shrinks: in most tiles nothing lies within it and the tile is passed over for that query; else the tile's k best
are selected, without sorting it, and merged. Spark merges the k best of each chain. No task holds the items, and a query's
rows are k a chain at most.

Items of one fingerprint are as near as each other, and ties go to the least ids, so of each fingerprint only its k + 1
least ids take part; queries of one fingerprint are compared once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from palimpsest.operators.join import items_of, kinds_of, unsigned, words_of
from palimpsest.plans.skew import join_counted
from palimpsest.plans.storage import kept

#: Queries of a block; items of a tile, and queries that are compared with it at once; tasks that are wanted, about; and
#: items of a chain at least.
BLOCK_QUERIES, TILE_ITEMS, TILE_QUERIES, TASKS, CHAIN_ITEMS = 16_384, 4096, 256, 256, 2048
NONE = np.iinfo(np.int32).max


class Best:
    """The k nearest items of each query of a block so far, by (distance, id)."""

    def __init__(self, queries: list[np.ndarray], k: int) -> None:
        self.queries, self.k = queries, k
        self.dist = np.full((len(queries[0]), k), NONE, np.int32)
        self.id = np.zeros((len(queries[0]), k), np.int64)

    def add(self, ids: np.ndarray, items: list[np.ndarray]) -> None:
        order = np.argsort(ids, kind="stable")
        ids, n = ids[order], len(ids)
        for at in range(0, len(self.dist), TILE_QUERIES):
            rows = slice(at, at + TILE_QUERIES)
            d = sum(np.bitwise_count(q[rows, None] ^ x[order][None]).astype(np.int32) for q, x in zip(self.queries, items, strict=True))
            hit = np.flatnonzero(d.min(axis=1) <= self.dist[rows, -1])  # an equal distance may have a smaller id
            if not len(hit):
                continue
            spot = d[hit].astype(np.int64) * n + np.arange(n)
            if n > self.k:
                spot = np.partition(spot, self.k - 1, axis=1)[:, : self.k]
            dist = np.concatenate([self.dist[rows][hit], (spot // n).astype(np.int32)], axis=1)
            id_ = np.concatenate([self.id[rows][hit], ids[spot % n]], axis=1)
            best = np.lexsort((id_, dist), axis=1)[:, : self.k]
            self.dist[at + hit], self.id[at + hit] = np.take_along_axis(dist, best, 1), np.take_along_axis(id_, best, 1)


def _through_chains(words: list[str], k: int):
    """(a, id, dist) of rows (block, chain, side, id, words) sorted by these: queries are side 0, items side 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, best = None, [], None

        def done() -> pa.RecordBatch:
            row, col = np.nonzero(best.dist < NONE)
            names = np.concatenate([h[0] for h in held])
            return pa.RecordBatch.from_arrays([pa.array(names[row]), pa.array(best.id[row, col]), pa.array(best.dist[row, col], pa.int32())], ["a", "id", "dist"])

        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("block", "chain", "side")]
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
            for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if start == stop:
                    continue
                if key != (now := (columns[0][start], columns[1][start])):
                    if best is not None:
                        yield done()
                    key, held, best = now, [], None
                part = batch.slice(start, stop - start)
                ids, values = part.column("id").to_numpy(), unsigned(part, words)
                if columns[2][start] == 0:
                    held.append((ids, values))
                elif held:
                    if best is None:
                        best = Best([np.concatenate(v) for v in zip(*(h[1] for h in held), strict=True)], k)
                    for t in range(0, len(ids), TILE_ITEMS):
                        best.add(ids[t : t + TILE_ITEMS], [v[t : t + TILE_ITEMS] for v in values])
        if best is not None:
            yield done()

    return run


def nearest(queries: DataFrame, fingerprints: DataFrame, k: int) -> DataFrame:
    """(query, rank, id, dist): for each query, of both (id, words), the k nearest items with other ids, ranked from 1 by
    distance, ties by the smaller id. A query has fewer where there are fewer items. Null fingerprints are no queries and
    near to nothing; a repeated row is one item."""
    words, every = words_of(fingerprints), k + 1  # a query may be its own nearest item
    asked = kept(kinds_of(queries), "asked")
    of_print = Window.partitionBy(*words).orderBy("id")
    rows = fingerprints.select("id", *words).dropna().distinct().withColumn("_n", F.row_number().over(of_print))
    items = kept(rows.where(F.col("_n") <= every).drop("_n"), "nearest-items")
    n, m = items.count(), asked.count()
    blocks = max(1, -(-m // BLOCK_QUERIES))
    chains = max(1, min(-(-TASKS // blocks), -(-n // CHAIN_ITEMS)))
    part = lambda of: F.pmod(F.xxhash64("id", *words), F.lit(of)).cast("int")
    all_of = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    dealt = asked.select(part(blocks).alias("block"), all_of(chains).alias("chain"), F.lit(0).alias("side"), "id", *words)
    dealt = dealt.unionAll(items.select(all_of(blocks).alias("block"), part(chains).alias("chain"), F.lit(1).alias("side"), "id", *words))
    dealt = dealt.repartition(2 * blocks * chains, "block", "chain").sortWithinPartitions("block", "chain", "side")
    kind = items.schema["id"].dataType
    near = dealt.mapInArrow(_through_chains(words, every), StructType([StructField("a", kind), StructField("id", kind), StructField("dist", IntegerType())]))
    best = near.withColumn("_n", F.row_number().over(Window.partitionBy("a").orderBy("dist", "id"))).where(F.col("_n") <= every)
    lists = best.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("dist", "id"))).alias("best"))  # k + 1 each
    lists = lists.join(asked.select(F.col("id").alias("a"), "copies"), "a").withColumnRenamed("a", "rep")
    own = join_counted(items_of(queries, asked).withColumnRenamed("id", "query"), lists, ["rep"], "copies", queries.count())
    others = F.slice(F.filter("best", lambda x: x["id"] != F.col("query")), 1, k)
    out = own.select("query", F.posexplode(others).alias("rank", "near"))
    return out.select("query", (F.col("rank") + 1).cast("long").alias("rank"), "near.id", "near.dist")
