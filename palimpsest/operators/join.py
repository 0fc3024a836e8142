"""Exact Hamming-radius joins of fingerprint tables (id, w0[, w1, ...]), of any number of words.

Strategies, all exact:
  broadcast  a nested loop against a broadcast side, only up to a checked size
  band       radius r over r + 1 disjoint bands: a match has an equal band, so rows are compared within a band's value only
  block      rows go to block pairs, all pairs of which are compared
Where bands have few rows a value on average, values of JOINED_ROWS rows and fewer are equi-joined. All other rows go to
cells, a block pair or a part of one band's value, and a cell is compared in NumPy, a tile at a time: no row is made of a
pair that doesn't match. A cell has BLOCK_ROWS rows a side on average, whatever the value's share, so a value that half of
all rows have costs no more than it must. A pair is reported by the first band that is equal. A row goes to as many block
pairs as there are blocks: at radii for which bands are too narrow, work grows with the square of the number of rows, and
what moves with its square by BLOCK_ROWS.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from palimpsest.functions.columns import band, distance
from palimpsest.plans.skew import join_counted
from palimpsest.plans.storage import kept

#: Rows of a side that may be broadcast: 24 bytes each.
BROADCAST_ROWS = 20_000
BLOCK_ROWS = 16_384
#: Bits that a band has at least for the strategy to be chosen.
BAND_BITS = 10
#: Rows a value of a band, on average, up to which bands are equi-joined, and rows of a value that are.
VALUE_ROWS, JOINED_ROWS = 64, 512
#: Pairs that are compared at once, 8 bytes each; matches that are gathered for a batch; tasks that cells are dealt to, at most.
TILE, BATCH, TASKS = 65_536, 200_000, 4000


def words_of(fingerprints: DataFrame) -> list[str]:
    return sorted((c for c in fingerprints.columns if re.fullmatch(r"w\d+", c)), key=lambda c: int(c[1:]))


def from_arrays(rows: DataFrame, column: str, words: int) -> tuple[DataFrame, DataFrame]:
    """(fingerprints (id, w0, w1, ...), errors (id, words, error)) of rows (id, an array of 64-bit words). Fingerprints of
    different lengths have no distance, so an array of another length, or with a null in it, is an error row and stops
    nothing else. A null array is no fingerprint and no error."""
    size, hole = F.size(column), F.exists(column, lambda w: w.isNull())
    said = F.when(size != words, F.concat(F.lit("a fingerprint of "), size.cast("string"), F.lit(f" words, where others have {words}"))).when(hole, "a fingerprint with a null word")
    held = rows.where(F.col(column).isNotNull()).select("id", F.col(column).alias("print"), size.alias("words"), said.alias("error"))
    return held.where("error is null").select("id", *(F.get("print", F.lit(k)).alias(f"w{k}") for k in range(words))), held.where("error is not null").select("id", "words", "error")


def band_plan(radius: int, words: int) -> list[tuple[int, int]]:
    """(first bit, bits) of bands: more bands than a match may have differing bits, none across words."""
    per_word = -(-(radius + 1) // words)
    out = []
    for w in range(words):
        cuts = [round(64 * k / per_word) for k in range(per_word + 1)]
        out += [(64 * w + a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return out


def choose(n: int, threshold: float, words: int) -> str:
    if n <= BROADCAST_ROWS:
        return "broadcast"
    radius = int(-(-threshold // 1)) - 1
    return "band" if radius + 1 <= 64 * words and min(size for _, size in band_plan(radius, words)) >= BAND_BITS else "block"


def matches(x: list[np.ndarray], y: list[np.ndarray], threshold: float, own: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in x, places in y, distances) of all pairs with a distance < threshold, in parts; x and y are words as
    unsigned numbers. own: x and y are the same rows, and each pair is taken once."""
    n, m, limit = len(x[0]), len(y[0]), int(-(-min(threshold, 64 * len(x) + 1) // 1))
    step = max(1, TILE // max(1, m))
    bits, more = np.empty(step * m, np.uint64), np.empty(step * m, np.uint8)
    ones = more.copy() if len(x) < 4 else np.empty(step * m, np.uint32)  # three words differ in 192 bits at most
    held, size = [], 0
    for i in range(0, n if m else 0, step):
        first, rows = i if own else 0, min(step, n - i)
        wide = m - first
        b, d, e = (t[: rows * wide].reshape(rows, wide) for t in (bits, ones, more))
        for k, (u, v) in enumerate(zip(x, y, strict=True)):
            np.bitwise_xor(u[i : i + rows, None], v[None, first:], out=b)
            np.bitwise_count(b, out=e if k else d)
            if k:
                np.add(d, e, out=d)
        hit = np.flatnonzero(d.ravel() < limit)
        r, c = np.divmod(hit, wide)
        if own:
            after = c > r
            hit, r, c = hit[after], r[after], c[after]
        if len(hit):
            held.append((r + i, c + first, d.ravel()[hit].astype(np.int32)))
            size += len(hit)
        if size >= BATCH:
            yield tuple(np.concatenate(t) for t in zip(*held, strict=True))
            held, size = [], 0
    if held:
        yield tuple(np.concatenate(t) for t in zip(*held, strict=True))


def unsigned(rows: pa.Table | pa.RecordBatch, words: list[str]) -> list[np.ndarray]:
    return [rows.column(w).to_numpy().view(np.uint64) for w in words]


def _cell_by_cell(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of one key after another, from batches sorted by keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(k).to_numpy() for k in keys]
        same = not held or all(held[-1].column(k)[-1].as_py() == v[0] for k, v in zip(keys, values, strict=True))
        changed = np.zeros(batch.num_rows, bool)
        changed[0] = not same
        for v in values:
            changed[1:] |= v[1:] != v[:-1]
        at = 0
        for cut in np.flatnonzero(changed).tolist():
            if cut > at:
                held.append(batch.slice(at, cut - at))
            if held:
                yield pa.Table.from_batches(held)
            held, at = [], cut
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def _compare(words: list[str], threshold: float, keys: list[str], plan: list[tuple[int, int]], own: bool, counted: bool):
    """Matches (a, b, dist) of cells (keys, side, id, words), sorted by keys and side. plan: bands, of which column k is
    the cell's one; a match of an earlier band is left to that. own: cells of p = q have one side, compared with itself.
    counted: of rows that stand for ``copies`` each, only (dist, pairs) of items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(64 * len(words) + 1, np.int64)
        for cell in _cell_by_cell(batches, keys):
            alone = own and cell["p"][0] == cell["q"][0]
            cut = cell.num_rows if alone else int(np.searchsorted(cell["side"].to_numpy(), 1))
            ids, values = cell["id"].combine_chunks(), unsigned(cell, words)
            copies = cell["copies"].to_numpy() if counted else None
            x, y, move = [v[:cut] for v in values], values if alone else [v[cut:] for v in values], 0 if alone else cut
            earlier = plan[: cell["k"][0].as_py()] if plan else []
            for i, j, dist in matches(x, y, threshold, alone):
                if earlier:
                    new = np.ones(len(i), bool)
                    for first, size in earlier:
                        w, mask = first // 64, np.uint64((1 << size) - 1)
                        new &= ((x[w][i] ^ y[w][j]) >> np.uint64(first % 64)) & mask != 0
                    i, j, dist = i[new], j[new], dist[new]
                if counted:
                    np.add.at(pairs, dist, copies[i] * copies[j + move])
                else:
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), ids.take(pa.array(j + move)), pa.array(dist, pa.int32())], ["a", "b", "dist"])
        if counted:
            found = np.flatnonzero(pairs)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(pairs[found], pa.int64())], ["dist", "pairs"])

    return run


def _sides(x: DataFrame, y: DataFrame | None, columns: list[str]) -> DataFrame:
    sides = [t.select(*columns, F.lit(side).alias("side")) for side, t in enumerate([x] if y is None else [x, y])]
    return sides[0] if y is None else sides[0].unionAll(sides[1])


def in_cells(rows: DataFrame, two: bool, words: list[str], threshold: float, by: list[str], cells: int, plan: list[tuple[int, int]] = [], counted: bool = False) -> DataFrame:  # noqa: B006
    """(a, b, dist), or (dist, pairs), of pairs of rows (by, id, words, side, blocks[, copies]) of one value of the columns
    ``by``: of both sides if there are two, or of two rows of one. blocks: parts that a value's rows are cut into; each pair
    of them is a cell. plan: the bands whose number and value ``by`` is."""
    keys = [*by, "p", "q"]
    rows = rows.withColumn("at", F.pmod(F.xxhash64("id", *words), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    if not two:
        rows = rows.withColumn("p", F.least("at", "other")).withColumn("q", F.greatest("at", "other")).withColumn("side", (F.col("at") > F.col("other")).cast("int"))
    else:
        rows = rows.withColumn("p", F.when(F.col("side") == 0, F.col("at")).otherwise(F.col("other"))).withColumn("q", F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("at")))
    dealt = rows.select(*keys, "side", "id", *words, *(["copies"] if counted else [])).repartition(min(TASKS, 2 * cells), *keys).sortWithinPartitions(*keys, "side")
    kind = rows.schema["id"].dataType
    schema = "dist int, pairs long" if counted else StructType([StructField("a", kind), StructField("b", kind), StructField("dist", IntegerType())])
    found = dealt.mapInArrow(_compare(words, threshold, keys, plan, not two, counted), schema)
    return found if counted else found.where("a <> b")


def _near(x: DataFrame, y: DataFrame | None, words: list[str], threshold: float, strategy: str, n: int, counted: bool = False) -> DataFrame:
    """(a, b, dist) of pairs of a row of x and one of y with other ids and dist < threshold; without y, of two rows of x,
    each pair once. Both (id, words), of distinct rows, n of them in the larger one. counted: rows of x stand for ``copies``
    items each, and the result is (dist, pairs) of items, in parts."""
    plan = band_plan(int(-(-threshold // 1)) - 1, len(words)) if strategy == "band" else []
    columns, two = ["id", *words, *(["copies"] if counted else [])], y is not None
    blocks = max(1, -(-n // BLOCK_ROWS))
    if strategy == "block":
        return in_cells(_sides(x, y, columns).withColumn("blocks", F.lit(blocks)), two, words, threshold, [], blocks * blocks, counted=counted)
    left, right = ([f"{side}_{c}" for c in columns] for side in "ab")
    of = lambda names: [F.col(c) for c in names[1 : 1 + len(words)]]
    dist = distance(of(left), of(right))
    near = (dist < threshold) & (F.col("a_id") != F.col("b_id") if two else F.col("a_id") < F.col("b_id"))
    out = [dist.alias("dist"), (F.col("a_copies") * F.col("b_copies")).alias("pairs")] if counted else [F.col("a_id").alias("a"), F.col("b_id").alias("b"), dist.alias("dist")]
    if strategy == "broadcast":
        return x.select(*columns).toDF(*left).join(F.broadcast((y if two else x).select(*columns).toDF(*right)), near).select(*out)
    values = F.array(*(F.struct(F.lit(k).alias("k"), band([F.col(w) for w in words], first, size).alias("v")) for k, (first, size) in enumerate(plan)))
    rows = _sides(x, y, columns).withColumn("value", F.explode(values)).select("*", "value.k", "value.v").drop("value")
    large = kept(rows.groupBy("k", "v").agg(F.count("*").alias("m")).where(F.col("m") > JOINED_ROWS), "large-values")
    fine, any_large = n <= VALUE_ROWS << min(size for _, size in plan), large.count()
    if any_large or not fine:
        rows = join_counted(rows, large, ["k", "v"], "m", 2 * n * len(plan), "left")
    cut = rows.withColumn("blocks", F.coalesce(F.ceil(F.col("m") / BLOCK_ROWS), F.lit(1)).cast("int")) if any_large or not fine else None
    if not fine:
        return in_cells(cut, two, words, threshold, ["k", "v"], len(plan) * max(2 ** min(size for _, size in plan), blocks * blocks), plan, counted)
    joined = rows.where("m is null").drop("m") if any_large else rows
    sides = [joined.where(F.col("side") == side).select("k", "v", *columns).toDF("k", "v", *names) for side, names in ((0, left), (int(two), right))]
    for k, (first, size) in enumerate(plan[:-1]):  # the first band that is equal reports a pair
        near &= (F.col("k") <= k) | (band(of(left), first, size) != band(of(right), first, size))
    found = sides[0].join(sides[1], ["k", "v"]).where(near).select(*out)
    return found.unionByName(in_cells(cut.where("m is not null"), two, words, threshold, ["k", "v"], any_large, plan, counted)) if any_large else found


def kinds_of(fingerprints: DataFrame) -> DataFrame:
    """(id, words, copies): a row for each distinct fingerprint, with the least id that has it."""
    words = words_of(fingerprints)
    return fingerprints.select("id", *words).dropna().groupBy(*words).agg(F.min("id").alias("id"), F.countDistinct("id").alias("copies"))


def within_kinds(kinds: DataFrame, threshold: float, strategy: str | None = None) -> DataFrame:
    """(a, b, dist) of all pairs a < b of distinct rows (id, words) with dist < threshold."""
    words, (n, ids) = words_of(kinds), kinds.agg(F.count("*"), F.countDistinct("id")).first()
    near = _near(kinds, None, words, threshold, strategy or choose(n, threshold, len(words)), n)
    out = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "dist")
    return out.distinct() if ids < n else out  # an id of several fingerprints may match by more than one


def items_of(fingerprints: DataFrame, kinds: DataFrame) -> DataFrame:
    """(id, rep): distinct items, and the least id that has the same fingerprint."""
    words = words_of(fingerprints)
    copies = kinds.select(*words, F.col("id").alias("rep"), "copies")
    return join_counted(fingerprints.select("id", *words).dropna().distinct(), copies, words, "copies", fingerprints.count()).select("id", "rep")


def within(fingerprints: DataFrame, threshold: float, strategy: str | None = None) -> DataFrame:
    """(a, b, dist) of all pairs a < b with dist < threshold. Null fingerprints match nothing; a repeated id is one item,
    and pairs of one id with itself don't count. Copies of a fingerprint make a row a pair here; linked_kinds() doesn't
    make those, and groups don't either."""
    return within_kinds(fingerprints.select("id", *words_of(fingerprints)).dropna().distinct(), threshold, strategy)


def linked_kinds(fingerprints: DataFrame, threshold: float, strategy: str | None = None) -> DataFrame:
    """(a, b, dist): each pair a < b of different fingerprints with dist < threshold, named by the least ids that have them;
    and, at distance 0, each other item b with the least one a of its fingerprint. All links follow from these rows, and m
    copies make m - 1 of them. Null fingerprints match nothing."""
    kinds = kept(kinds_of(fingerprints), "kinds")
    copies = items_of(fingerprints, kinds).where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(0).alias("dist"))
    return within_kinds(kinds, threshold, strategy).unionAll(copies)


def pair_counts(fingerprints: DataFrame, threshold: float, strategy: str | None = None) -> DataFrame:
    """(dist, pairs): pairs of items by distance, below a threshold. Copies are multiplied, not paired."""
    kinds = kept(kinds_of(fingerprints), "kinds")
    words, n = words_of(kinds), kinds.count()
    apart = _near(kinds, None, words, threshold, strategy or choose(n, threshold, len(words)), n, counted=True)
    same = kinds.where((F.col("copies") > 1) & F.lit(threshold > 0)).select(F.lit(0).alias("dist"), F.expr("copies * (copies - 1) div 2").alias("pairs"))
    return apart.unionAll(same).groupBy("dist").agg(F.sum("pairs").alias("pairs"))


def search(queries: DataFrame, fingerprints: DataFrame, threshold: float, *, listed: bool = False, strategy: str | None = None) -> DataFrame:
    """(kind, a, b, dist): what is near to any of many queries, both (id, words). ``match``: a query a and an item b with
    dist < threshold, each named by the least id of its fingerprint; ``query``: another query b of a's fingerprint; ``copy``:
    another item b of a's. A query's matches are those of its a, with their copies. Queries that are items themselves don't
    match themselves alone; listed: they do, as where the target of a search is among the files."""
    asked, kinds = kept(kinds_of(queries), "asked"), kept(kinds_of(fingerprints), "kinds")
    words, n, m = words_of(kinds), kinds.count(), asked.count()
    strategy = strategy or choose(m, threshold, len(words))
    near = _near(kinds, asked, words, threshold, strategy, max(n, m)).where("dist > 0").select(F.lit("match").alias("kind"), F.col("b").alias("a"), F.col("a").alias("b"), "dist")
    same = asked.select(*words, F.col("id").alias("a")).join(kinds.select(*words, F.col("id").alias("b"), "copies"), words)
    alone = F.lit(threshold > 0) if listed else F.lit(threshold > 0) & ((F.col("copies") > 1) | (F.col("a") != F.col("b")))
    others = [items_of(t, k).where("id <> rep").select(F.lit(name).alias("kind"), F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(0).alias("dist")) for t, k, name in ((queries, asked, "query"), (fingerprints, kinds, "copy"))]
    return near.unionAll(same.where(alone).select(F.lit("match").alias("kind"), "a", "b", F.lit(0).alias("dist"))).unionAll(others[0]).unionAll(others[1])


def between(new: DataFrame, old: DataFrame, threshold: float, strategy: str | None = None) -> DataFrame:
    """(a, b, dist), a < b, of all pairs of a row of new and a row of old with dist < threshold: old rows aren't compared
    with each other."""
    words = words_of(new)
    x, y = (t.select("id", *words).dropna().distinct() for t in (new, old))
    few = x.limit(BROADCAST_ROWS + 1).count()
    strategy = strategy or choose(few, threshold, len(words))
    n = 0 if strategy == "broadcast" else max(x.count(), y.count())
    near = _near(y, x, words, threshold, strategy, n)  # the new side is the one that may be broadcast
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "dist").distinct()


def probe(target: DataFrame, fingerprints: DataFrame, threshold: float) -> DataFrame:
    """Rows of fingerprints (id, dist) near a target of one row (words only): farthest first, then by id. The target has
    no id, so an item of the same picture does match."""
    words = words_of(fingerprints)
    one = target.select(*(F.col(w).alias(f"t{w}") for w in words)).limit(1)
    dist = distance([F.col(w) for w in words], [F.col(f"t{w}") for w in words])
    return fingerprints.join(F.broadcast(one), dist < threshold).select("id", dist.alias("dist")).orderBy(F.desc("dist"), "id")
