"""Near-duplicates by fast similarity sketching, banding and exact verification.

The sketch is that of Dahlgaard, Knudsen and Thorup ("Fast similarity
sketching", 2017). In rounds 0..t-1 every element falls into a hashed one of t
bins with value (round, hash); rounds t..2t-1 put every element into bin
round - t, so that each coordinate fills. A coordinate is its least value, and
rounds end once all are filled. Bands of coordinates are hashed to keys; texts
that share one are candidates.

Texts of equal shingle sets are one representative from the start. Within a
band's key, every representative pairs with the least one (a star, not all
pairs); components of the stars are the candidate groups. Groups are verified
on full sets of 64-bit shingle hashes, in two steps. First every representative
is compared with the hub that it shares most keys with: a group's sets move once,
and each hub's once a block of them. What so links is one class. Where a group
still has several classes, each sends one text to every key's bucket, which are
compared with one of them, by turns, as long as that merges many classes. Only
then are all texts outside a group's largest class compared with all of the group: exact intersection sizes from incidence products,
for each pair of blocks in a task of its own, so that no task holds a large group.
A task returns a spanning forest of its links only. Components of the links are
the result. A group of m texts of which u don't link to the largest class moves
m * u / BLOCK_TEXTS sets, so one whose texts are near to a common one moves m.

With the default 40 bands of 8 coordinates, a pair at the threshold 0.85 is
missed by all bands with probability 3e-6, and then still found if the stars of
other texts connect the two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.components import connected_components
from palimpsest.plans.skew import join_counted

from .shared import discard, prepare, stored, with_ids_of
from .textkernel import blocks, mix, ngrams, seeded, words_of

BANDS, ROWS = 40, 8
SHINGLE_WORDS, NUMERATOR, DENOMINATOR = 5, 80, 100
#: Classes of a group merge by turns while each turn merges such a share of them.
MERGED = 0.1
#: Elements (shingles) of a group that one block of verification holds, and texts.
BLOCK_SHINGLES, BLOCK_TEXTS = 400_000, 1000


def sketch(doc: np.ndarray, h: np.ndarray, n_docs: int, t: int) -> np.ndarray:
    """Coordinates, n_docs x t, of the sets {h where doc = d}; a set without elements keeps the largest value."""
    top = np.iinfo(np.uint64).max
    out = np.full((n_docs, t), top, np.uint64)
    for r in range(2 * t):
        if not len(doc):
            break
        x = seeded(h, r + 1)
        slot = doc * t + ((x >> np.uint64(40)).astype(np.int64) % t if r < t else r - t)
        np.minimum.at(out.reshape(-1), slot, (np.uint64(r) << np.uint64(40)) | (mix(x) >> np.uint64(24)))
        live = np.unique(doc)
        unfilled = np.zeros(n_docs, bool)
        unfilled[live] = (out[live] == top).any(axis=1)
        take = unfilled[doc]
        doc, h = doc[take], h[take]
    return out


def sets_of(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, shingle), distinct and sorted."""
    doc, h = ngrams(words_of(texts), n, whole_if_short=True)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        doc, h = doc[new], h[new]
    return doc, h


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def banded(bands: int, rows: int):
    """Keys of sets, as for _signer: ``bands`` a set, each of ``rows`` coordinates of its sketch."""

    def keys(doc: np.ndarray, h: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
        s = sketch(doc, h, n_docs, bands * rows).reshape(n_docs, bands, rows)
        key = np.tile(np.arange(bands, dtype=np.uint64), (n_docs, 1))
        for r in range(rows):
            key = mix(key * np.uint64(31) + s[:, :, r])
        return key.ravel(), np.full(n_docs, bands)

    return keys


def _signer(n: int, keys):
    """keys(doc, shingle, number of documents): (keys of all sets, document by document; how many each has)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in blocks(batch.column("text").to_pylist()):
                k = len(texts)
                doc, h = sets_of(texts, n)
                one, two = np.zeros(k, np.uint64), np.zeros(k, np.uint64)
                np.add.at(one, doc, mix(h))
                np.add.at(two, doc, seeded(h, 77))
                key, many = keys(doc, h, k)
                cuts = np.concatenate([[0], np.cumsum(many)])
                columns = [pa.array(x, pa.int64()) for x in (np.bincount(doc, minlength=k), _signed(one), _signed(two))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, k), *columns, pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(_signed(key), pa.int64()))], ["doc_id", "n_shingles", "one", "two", "keys"])

    return run


def _setter(n: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for first, texts in blocks(frame["text"]):
                doc, h = sets_of(texts, n)
                cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
                yield pd.DataFrame({"rep": frame["rep"].to_numpy()[first : first + len(texts)], "shingles": [_signed(h[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]})

    return run


def _linked(a: np.ndarray, b: np.ndarray, numerator: int, denominator: int) -> bool:
    """Of two sorted sets."""
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return denominator * both >= numerator * (len(a) + len(b) - both)


def _star_verifier(numerator: int, denominator: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by (hub, block, side); a hub's own sets come first, with side 0."""
        key, hubs = None, []
        for frame in frames:
            out = []
            for rep, hub, block, side, s in zip(frame["rep"], frame["hub"], frame["block"], frame["side"], frame["shingles"], strict=True):
                s = np.sort(np.asarray(s))
                if key != (hub, block):
                    key, hubs = (hub, block), []
                if side == 0:
                    hubs.append(s)
                elif any(_linked(s, h, numerator, denominator) for h in hubs):
                    out.append((rep, hub))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def spanning_links(reps: np.ndarray, sets: list[np.ndarray], side: np.ndarray, numerator: int, denominator: int) -> list[tuple[int, int]]:
    """Links of a spanning forest among the sets; only links between side 0 and side 1 count."""
    sizes = np.array([len(s) for s in sets], np.int64)
    n = len(sets)
    _, col = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), sizes)
    seen = np.bincount(col)
    ok = seen[col] > 1  # what one set alone has adds to no intersection
    row, col = row[ok], np.unique(col[ok], return_inverse=True)[1]
    width = int(col.max()) + 1 if len(col) else 0
    inter = np.zeros((n, n), np.int64)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    step = max(256, min(8192, 16_000_000 // max(1, n)))
    for start in range(0, width, step):
        a, b = np.searchsorted(col, (start, start + step))
        m = np.zeros((n, step), np.float32)
        m[row[a:b], col[a:b] - start] = 1
        inter += (m @ m.T).astype(np.int64)  # a step's counts are exact in single precision
    linked = denominator * inter >= numerator * (sizes[:, None] + sizes[None, :] - inter)
    linked &= side[:, None] != side[None, :]
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i in range(n):
        for j in np.flatnonzero(linked[i, :i]):
            p, q = root(i), root(int(j))
            if p != q:
                parent[p] = q
                out.append((int(reps[i]), int(reps[j])))
    return out


def _verifier(numerator: int, denominator: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by (cluster, p, q); a group may go over several batches."""
        key, held = None, []

        def done() -> pd.DataFrame:
            block = np.array([x[1] for x in held])
            found = spanning_links(np.array([x[0] for x in held]), [x[2] for x in held], block, numerator, denominator) if len(held) > 1 else []
            return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

        for frame in frames:
            for rep, cluster, p, q, block, s in zip(frame["rep"], frame["cluster"], frame["p"], frame["q"], frame["block"], frame["shingles"], strict=True):
                if key != (cluster, p, q):
                    if len(held) > 1:
                        yield done()
                    key, held = (cluster, p, q), []
                held.append((rep, block, np.asarray(s)))
        if len(held) > 1:
            yield done()

    return run


def _several(placed: DataFrame, n_reps: int, most: int) -> DataFrame:
    """placed (rep, cluster, class, n) of the clusters that have several classes, and whether a row is out of the largest.
    most: texts of the largest cluster."""
    kinds = placed.groupBy("cluster", "class").agg(F.count("*").alias("k")).groupBy("cluster").agg(F.max(F.struct("k", "class")).alias("most"), F.count("*").alias("kinds"), F.sum("k").alias("texts"))
    several = kinds.where("kinds > 1").select("cluster", F.col("most.class").alias("main"), "texts")
    return stored(join_counted(placed, several, ["cluster"], "texts", n_reps, most=most).select("rep", "cluster", "class", "n", (F.col("class") != F.col("main")).alias("out")), "several")


def _delegates_linked(keys: DataFrame, placed: DataFrame, sets: DataFrame, turn: int, n_keys: int, most: int, numerator: int, denominator: int) -> DataFrame:
    """(a, b, class_a, class_b): links between classes. In each bucket a class sends one of its texts, by a hash, and those
    are compared with one of them all. most: texts of the largest cluster, in which each bucket is."""
    own = F.struct(F.xxhash64("rep", "key", F.lit(turn)).alias("h"), "rep")
    sent = keys.join(placed.select("rep", "class"), "rep").groupBy("key", "class").agg(F.min(own).alias("d"))
    hubs = sent.groupBy("key").agg(F.min(F.struct("d", "class")).alias("hub"), F.count("*").alias("m")).where("m > 1")
    met = join_counted(sent, hubs, ["key"], "m", n_keys // 10, most=most).where(F.col("class") != F.col("hub.class"))
    pairs = met.select(F.col("d.rep").alias("a"), F.col("hub.d.rep").alias("b"), F.col("class").alias("class_a"), F.col("hub.class").alias("class_b")).distinct()
    both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    linked = both.where(denominator * shared >= numerator * (F.size("x") + F.size("y") - shared))
    return stored(linked.select("a", "b", "class_a", "class_b"), "delegates")


def _blocks_of(texts: DataFrame, of: str, shingles: str) -> DataFrame:
    """(group, texts, blocks): blocks of a group so that none has many texts or shingles, on average."""
    counted = texts.groupBy(of).agg(F.count("*").alias("texts"), F.sum(shingles).alias("_s"))
    return counted.select(of, "texts", F.greatest(F.ceil(F.col("texts") / BLOCK_TEXTS), F.ceil(F.col("_s") / BLOCK_SHINGLES)).cast("int").alias("blocks"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle_words: int = SHINGLE_WORDS, numerator: int = NUMERATOR, denominator: int = DENOMINATOR, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row per row of docs; texts link at
    denominator * |A and B| >= numerator * |A or B|.

    Null or empty texts, and those of white space only, have an empty set and
    link with nothing. Rows of a repeated id are one node. A null id gets a null
    component and kept = false. An empty table gives an empty table; other
    columns of docs are not looked at.
    """
    out = linked_sets(docs, id_col, text_col, banded(bands, rows), bands, shingle_words=shingle_words, numerator=numerator, denominator=denominator)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def linked_sets(docs: DataFrame, id_col: str, text_col: str, keys_of, bands: int, *, shingle_words: int, numerator: int, denominator: int) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row per row of docs: components of all links between sets that share a key of
    keys_of (see _signer), each link confirmed on full sets. bands: kinds of keys, of which some at a time merge classes."""
    prepare(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = stored(plain.mapInArrow(_signer(shingle_words, keys_of), "doc_id long, n_shingles long, one long, two long, keys array<long>"), "signed")
    digest = ["n_shingles", "one", "two"]
    full = signed.where("n_shingles > 0 and doc_id is not null")
    reps = stored(full.groupBy(*digest).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("keys").alias("keys")), "reps")
    made: list[DataFrame] = []

    def own(df: DataFrame, name: str | None = None) -> DataFrame:
        """A table, stored here if it has a name, that is removed once the links are known."""
        made.append(stored(df, name) if name else df)
        return made[-1]

    n_reps, n_keys, most_copies = reps.agg(F.count("*"), F.coalesce(F.sum(F.size("keys")), F.lit(0)), F.coalesce(F.max("copies"), F.lit(0))).first()
    keys = reps.select("rep", F.explode("keys").alias("key"))
    hubs = own(keys.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("m")).where("m > 1"), "hubs")
    shared = join_counted(with_ids_of(keys, "key", hubs, "key"), hubs, ["key"], "m", n_keys, most=hubs.agg(F.max("m")).first()[0] or 0).where("rep <> hub")  # most keys are of one text alone
    stars = own(shared.groupBy("rep", "hub").agg(F.count("*").alias("keys")), "stars")
    clusters = own(own(connected_components(stars, "rep", "hub")).withColumnRenamed("node", "rep"), "clusters")
    # texts of the largest cluster: hubs, classes and buckets lie in one cluster each, so none of them has more
    most = clusters.groupBy("component").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    texts = with_ids_of(plain, "doc_id", clusters, "rep").join(clusters.select("rep").distinct(), F.col("doc_id") == F.col("rep")).select("rep", "text")
    sets = own(texts.mapInPandas(_setter(shingle_words), "rep long, shingles array<long>"), "sets")

    # each with the hub that it shares most keys with
    best = stars.groupBy("rep").agg(F.max(F.struct("keys", (-F.col("hub")).alias("hub"))).alias("best")).select("rep", (-F.col("best.hub")).alias("hub"))
    sized = best.join(reps.groupBy("rep").agg(F.max("n_shingles").alias("n")), "rep")
    spokes = _blocks_of(sized, "hub", "n")
    members = join_counted(sized, spokes, ["hub"], "texts", n_reps, most=most).select("rep", "hub", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"))
    members = members.join(sets, "rep").select("rep", "hub", "block", F.lit(1).alias("side"), "shingles")
    centres = spokes.select(F.col("hub").alias("rep"), "hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).join(sets, "rep").select("rep", "hub", "block", F.lit(0).alias("side"), "shingles")
    dealt = members.unionAll(centres).repartition("hub", "block").sortWithinPartitions("hub", "block", "side")
    near = own(dealt.mapInPandas(_star_verifier(numerator, denominator), "a long, b long"), "near")
    classes = own(connected_components(near, "a", "b")).select(F.col("node").alias("rep"), F.col("component").alias("class"))

    # groups of several classes: those that link with each other become one, and the rest is compared block by block
    placed = clusters.join(classes, "rep", "left").select("rep", F.col("component").alias("cluster"), F.coalesce("class", "rep").alias("class"))
    placed = own(placed.join(reps.groupBy("rep").agg(F.max("n_shingles").alias("n")), "rep"), "placed")
    left, links, kinds = own(_several(placed, n_reps, most)), near, None
    held = own(keys.join(left.select("rep").distinct(), "rep", "left_semi"), "left-keys")
    for turn in range(bands):
        before, kinds = kinds, left.select("cluster", "class").distinct().count()
        if not kinds or (before and kinds > (1 - MERGED) * before):
            break
        more = own(_delegates_linked(held.where(F.pmod("key", F.lit(max(1, bands // 4))) == turn % max(1, bands // 4)), left, sets, turn, n_keys, most, numerator, denominator))
        merged = own(connected_components(more, "class_a", "class_b")).select(F.col("node").alias("class"), "component")
        left = own(_several(own(left.join(merged, "class", "left").select("rep", "cluster", F.coalesce("component", "class").alias("class"), "n"), "placed"), n_reps, most))
        links = links.unionAll(more.select("a", "b"))
    if kinds:  # else every group is one class, and no text is left to compare
        left = own(left.select("rep", "cluster", "n", "out"), "left")
        both = _blocks_of(left, "cluster", "n").withColumnRenamed("blocks", "q_blocks")
        both = both.join(_blocks_of(left.where("out"), "cluster", "n").select("cluster", F.col("blocks").alias("p_blocks")), "cluster")
        dealt_left = join_counted(left, both, ["cluster"], "texts", n_reps, most=most)
        dealt_to = lambda blocks: F.pmod(F.xxhash64("rep"), F.col(blocks)).cast("int")
        every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
        ps = dealt_left.where("out").select("rep", "cluster", dealt_to("p_blocks").alias("p"), every("q_blocks").alias("q"), F.lit(0).alias("block"))
        qs = dealt_left.select("rep", "cluster", every("p_blocks").alias("p"), dealt_to("q_blocks").alias("q"), F.lit(1).alias("block"))
        paired = ps.unionByName(qs).join(sets, "rep").select("rep", "cluster", "p", "q", "block", "shingles")
        grouped = paired.repartition("cluster", "p", "q").sortWithinPartitions("cluster", "p", "q")
        far = grouped.mapInPandas(_verifier(numerator, denominator), "a long, b long")
        links = links.unionAll(far)
    parts = connected_components(links, "a", "b")
    discard(*made)
    found = parts.select(F.col("node").alias("rep"), "component")
    named = reps.select(*digest, "rep", "copies").join(found, "rep", "left").select(*digest, "copies", F.coalesce("component", "rep").alias("component_id"))
    out = join_counted(signed.select("doc_id", *digest), named, digest, "copies", signed.count(), "left", most=most_copies)
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the rows whose component has a smaller id; repeated rows of a kept id, and rows of a null id, all stay."""
    found = near_duplicates(docs, id_col, text_col, **options)
    gone = found.where("not kept and doc_id is not null").select(F.col("doc_id").alias("_gone")).distinct()
    kept = docs.join(gone, docs[id_col].cast("long") == gone["_gone"], "left_anti")
    return kept
