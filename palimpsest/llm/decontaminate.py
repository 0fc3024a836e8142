"""Benchmark decontamination: rare n-gram seeds join passages of training texts
to test items, then Smith-Waterman alignment over words scores them, so that
edited and paraphrased copies are found as well as exact ones.

Steps: (1) seeds are four words of an item, in one of a few shapes: together, or
with other words between them, so that copies with an edit in every few words
still share some; (2) a first pass over the whole texts counts in how many
documents each seed occurs; (3) a seed is rare if few documents have it, and an
item's least frequent seeds count as rare however frequent they are; (4) a second
pass cuts, for each (document, item), the window of words around each cluster of
hits that has a rare seed, or frequent ones at places apart: a stock phrase that
many documents share, alone, opens no window; (5) windows are aligned with their
items, but for those that share too few words with the item, in any order, for
any alignment to reach the coverage. A window is as wide as the item allows:
twice its length on both sides of the hits.

The seeds go to the tasks in blocks of items of bounded bytes, so that a large
benchmark costs further passes, not memory. Equal windows are aligned once in a
task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import prepare
from .textkernel import Words, blocks, mix, words_of

#: Places of a seed's words.
SHAPES = ((0, 1, 2, 3), (0, 1, 2, 4), (0, 2, 3, 4), (0, 1, 3, 4), (0, 1, 4, 5), (0, 1, 3, 6))
SEED_WORDS = len(SHAPES[0])
#: A seed in so many documents or fewer is rare, and so are each item's rarest seeds, and all of items of so few words.
RARE_DOCS, LEAST_SEEDS, SHORT_ITEM = 50, 4, 8
#: Frequent seeds open a window if the first and the last are so many words apart.
APART = 4
#: Share of an item's words that an alignment must match, and the least number of words.
COVERAGE, LEAST_WORDS = 0.6, 6
MATCH, MISMATCH, GAP = 2, -1, -1
#: Words of an item that one alignment takes; longer items align in pieces.
PIECE_WORDS = 500
#: Matched words that make a passage of a longer item a copy, where that is asked for, and what a step without a match costs there.
PASSAGE_WORDS, PASSAGE_LOSS = 50, 4
#: Bytes of items whose seeds one pass holds in memory, but for a longer item, which has a pass of its own.
PASS_BYTES = 4 << 20


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """(best local score, matched words on its path, and on its best passage) of word hashes a (item) against b (window).

    The best passage is the stretch of the path with the greatest sum of 1 a matched word and -PASSAGE_LOSS another step.

    Row by row: a gap in b's direction is a running maximum of score + index.
    """
    n = len(b)
    score = np.zeros(n + 1, np.int32)
    index = np.arange(n + 1, dtype=np.int32) * -GAP
    rows = [score]
    equal = a[:, None] == b[None, :]
    for i in range(len(a)):
        best = np.zeros(n + 1, np.int32)
        best[1:] = np.maximum(score[:-1] + np.where(equal[i], MATCH, MISMATCH), score[1:] + GAP)
        np.maximum(best, 0, out=best)
        score = np.maximum.accumulate(best + index) - index
        rows.append(score)
    table = np.stack(rows)
    i, j = np.unravel_index(int(table.argmax()), table.shape)
    top, matched, sum_, since, best_sum, passage = int(table[i, j]), 0, 0, 0, 0, 0
    while i and j and table[i, j] > 0:
        here = table[i, j]
        if equal[i - 1, j - 1] and here == table[i - 1, j - 1] + MATCH:
            matched, sum_, since, i, j = matched + 1, sum_ + 1, since + 1, i - 1, j - 1
            if sum_ > best_sum:
                best_sum, passage = sum_, since
            continue
        sum_ -= PASSAGE_LOSS
        if sum_ < 0:
            sum_ = since = 0
        if not equal[i - 1, j - 1] and here == table[i - 1, j - 1] + MISMATCH:
            i, j = i - 1, j - 1
        elif here == table[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return top, matched, passage


def align_parts(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """The best alignment of a with b, which is taken in overlapping parts if it is long."""
    step = max(64, 8 * len(a))
    found = [align(a, b[s : s + step + 3 * len(a)]) for s in range(0, max(1, len(b) - 3 * len(a)), step)]
    return *max(f[:2] for f in found), max(f[2] for f in found)


def align_item(a: np.ndarray, b: np.ndarray, least: int = LEAST_WORDS) -> tuple[int, int, int]:
    """(score, matched words, matched words of the longest passage) of an item against a window, in memory that doesn't
    grow with the item: of an item of more than PIECE_WORDS words, the sums over its equal pieces that match so many
    words."""
    pieces = np.array_split(a, -(-len(a) // PIECE_WORDS))
    if len(pieces) > 1:  # a passage across the edge of two pieces lies in one that is moved by half
        moved = [a[(len(p) + len(q)) // -4 + at : (len(p) + len(q)) // 4 + at] for p, q, at in zip(pieces, pieces[1:], np.cumsum([len(p) for p in pieces]), strict=False)]
    else:
        moved = []
    found = [align_parts(p, b) for p in pieces]
    passage = max(f[2] for f in [*found, *(align_parts(p, b) for p in moved)])
    if len(pieces) > 1:
        found = [f for f in found if f[1] >= least]
    return sum(f[0] for f in found), sum(f[1] for f in found), passage


def seeds_in(w: Words, short: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, place among all words, hash) of every seed of a block of texts; short: runs of fewer words as well."""
    out, n = [], len(w.hash)
    for shape in (*SHAPES, *(tuple(range(k)) for k in range(1, SEED_WORDS if short else 1))):
        m = n - shape[-1]
        if m <= 0:
            continue
        h = np.full(m, np.uint64(sum(7 ** (at + 1) for at in shape) * 1_000_003), np.uint64)
        for at in shape:
            h = h * np.uint64(0x9FB21C651E98DF25) + w.hash[at : at + m]
        place = np.flatnonzero(w.doc[:m] == w.doc[shape[-1] :])
        out.append((w.doc[place], place, mix(h[place])))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Seeds:
    """Sorted seed hashes with the items that hold them; an item is the place of a (item_id, text) among those given."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.ids = [item for item, _ in items]
        w = words_of([(text or "").encode("utf-8", "surrogatepass") for _, text in items])
        cuts = np.searchsorted(w.doc, np.arange(len(items) + 1))
        self.words = {i: w.hash[a:b] for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a}
        size = np.diff(cuts)
        self.short = bool(((size > 0) & (size < SEED_WORDS)).any())
        item, _, h = seeds_in(w, False)
        for i in np.flatnonzero((size > 0) & (size < SEED_WORDS)):  # an item of fewer words than a seed has is a seed as a whole
            whole = seeds_in(words_of([items[i][1].encode("utf-8", "surrogatepass")]), True)[2][-1:]
            item, h = np.append(item, i), np.append(h, whole)
        order = np.lexsort((item, h))
        item, h = item[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (item[1:] != item[:-1])
        self.item, self.hash = item[new].astype(np.int64), h[new]
        self.reach = 2 * size
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.hash >> np.uint64(44)).astype(np.int64)] = True
        self.bags = {i: np.unique(x, return_counts=True) for i, x in self.words.items()}
        self.first = np.flatnonzero(np.concatenate([np.ones(min(1, len(self.hash)), bool), self.hash[1:] != self.hash[:-1]]))
        self.rare = np.ones(len(self.hash), bool)

    def choose(self, docs: np.ndarray, rare_docs: int) -> None:
        """Which seeds are rare, from the documents that each distinct hash occurs in."""
        docs = np.repeat(docs, np.diff(np.append(self.first, len(self.hash))))
        order = np.lexsort((self.hash, docs, self.item))
        item = self.item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        self.rare = docs <= rare_docs
        self.rare[order[rank < LEAST_SEEDS]] = True
        self.rare |= self.reach[self.item] < 2 * SHORT_ITEM

    def most(self, item: int, window: np.ndarray) -> int:
        """No alignment of the item with the window can match more words than this."""
        word, times = self.bags[item]
        at = np.minimum(np.searchsorted(word, window), len(word) - 1)
        have = np.bincount(at[word[at] == window], minlength=len(word))
        if len(self.words[item]) > PIECE_WORDS:  # pieces may match the same words of the window
            return int(times[have > 0].sum())
        return int(np.minimum(have, times).sum())

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into h, index into the distinct hashes) of those that are seeds."""
        maybe = np.flatnonzero(self.seen[(h >> np.uint64(44)).astype(np.int64)])
        known = self.hash[self.first]
        at = np.minimum(np.searchsorted(known, h[maybe]), max(0, len(known) - 1))
        ok = known[at] == h[maybe] if len(known) else np.zeros(len(maybe), bool)
        return maybe[ok], at[ok]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into h, row of the seed table) of every hit."""
        at, key = self.hits(h)
        lo = self.first[key]
        count = np.append(self.first[1:], len(self.hash))[key] - lo
        at = np.repeat(at, count)
        return at, np.repeat(lo, count) + np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)


def enough(matched: int, words: int, coverage: float, least: int, passage: int = 0, passage_words: int | None = None) -> bool:
    """Whether so many matched words of an item of so many make a copy; or those of its longest passage."""
    return (matched >= min(least, words) and matched >= coverage * words) or (passage_words is not None and passage >= passage_words)


def _counter(handle):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(seed, docs): a task's documents with each distinct hash."""
        seeds = handle.value
        docs = np.zeros(len(seeds.first), np.int64)
        for frame in frames:
            for _, texts in blocks(frame["text"]):
                doc, _, h = seeds_in(words_of(texts), seeds.short)
                at, key = seeds.hits(h)
                pair = np.unique(doc[at] * len(docs) + key)
                docs += np.bincount(pair % max(1, len(docs)), minlength=len(docs))
        seed = np.flatnonzero(docs)
        yield pd.DataFrame({"seed": seed, "docs": docs[seed]})

    return run


def _finder(handle, coverage: float, least: int, passage_words: int | None):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seeds = handle.value
        for frame in frames:
            for first, texts in blocks(frame["text"]):
                w = words_of(texts)
                starts = np.concatenate([[0], np.cumsum(w.per_doc())])
                doc, place, h = seeds_in(w, seeds.short)
                at, seed = seeds.find(h)
                if not len(at):
                    continue
                d, p, item = doc[at], place[at], seeds.item[seed]
                order = np.lexsort((p, item, d))
                d, p, item, rare = d[order], p[order], item[order], seeds.rare[seed[order]]
                reach = seeds.reach[item]
                new = np.ones(len(d), bool)
                new[1:] = (d[1:] != d[:-1]) | (item[1:] != item[:-1]) | (p[1:] - p[:-1] > reach[1:])
                cut = np.flatnonzero(new)
                last = np.append(cut[1:], len(d)) - 1
                opens = np.logical_or.reduceat(rare, cut) | (p[last] - p[cut] >= APART)
                out = []
                for a, b in zip(cut[opens].tolist(), last[opens].tolist(), strict=True):
                    lo, hi, i = max(starts[d[a]], p[a] - reach[a]), min(starts[d[a] + 1], p[b] + SHAPES[-1][-1] + 1 + reach[a]), int(item[a])
                    window = w.hash[lo:hi]
                    most = seeds.most(i, window)
                    if enough(most, len(seeds.words[i]), coverage, least, most, passage_words):
                        out.append((d[a], i, window.view(np.int64)))
                ids = frame["doc_id"].to_numpy()
                if out:
                    yield pd.DataFrame({"doc_id": [ids[first + x[0]] for x in out], "item_id": [x[1] for x in out], "window": [x[2] for x in out]})

    return run


def _aligner(handle, coverage: float, least: int, passage_words: int | None):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, ids, known = handle.value.words, handle.value.ids, {}
        for frame in frames:
            rows = []
            for doc, item, window in zip(frame["doc_id"], frame["item_id"], frame["window"], strict=True):
                a = words[item]
                b = np.asarray(window, np.int64).view(np.uint64)
                key = (item, b.tobytes())
                found = known.get(key)
                if found is None:
                    found = align_item(a, b)
                    if len(known) < 20_000 and len(b) < 2000:
                        known[key] = found
                score, matched, passage = found
                if enough(matched, len(a), coverage, least, passage, passage_words):
                    rows.append((doc, ids[item], score, matched, matched / len(a)))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "matched_words", "coverage"]).astype({"doc_id": "int64", "item_id": "int64", "score": "int64", "matched_words": "int64", "coverage": "float64"})

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, *, rare_docs: int = RARE_DOCS, coverage: float = COVERAGE, least_words: int = LEAST_WORDS, passage_words: int | None = None) -> DataFrame:
    """(doc_id, item_id, score, matched_words, coverage), a row for each document and item it has a copy of.

    Null and empty texts and items match nothing; rows without an id are passed
    over. Different texts of an item_id are aligned each for itself;
    of repeated ids the best alignment stays. Very long items
    align in pieces (align_item). Empty tables give an empty table. With
    ``passage_words``, so many matched words of one passage are a copy as well,
    whatever share of the item they are; coverage says that share.
    """
    spark = docs.sparkSession
    prepare(spark)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    passes = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PASS_BYTES))
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = []
    for k in range(passes):
        held = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).orderBy("item_id", "text").toArrow().to_pydict()
        seeds = Seeds(list(zip(held["item_id"], held["text"], strict=True)))
        counts = np.zeros(len(seeds.first), np.int64)
        for row in plain.mapInPandas(_counter(spark.sparkContext.broadcast(seeds)), "seed long, docs long").groupBy("seed").agg(F.sum("docs").alias("docs")).toLocalIterator():  # seeds of the pass at most
            counts[row["seed"]] = row["docs"]
        seeds.choose(counts, rare_docs)
        handle = spark.sparkContext.broadcast(seeds)
        near = plain.mapInPandas(_finder(handle, coverage, least_words, passage_words), "doc_id long, item_id long, window array<long>")
        parts.append(near.repartition(tasks).mapInPandas(_aligner(handle, coverage, least_words, passage_words), "doc_id long, item_id long, score long, matched_words long, coverage double"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionAll(more)
    best = F.max(F.struct("score", "matched_words", "coverage")).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.score", "best.matched_words", "best.coverage")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the rows that hold a copy of a benchmark item. Rows of a null id stay."""
    gone = contaminated(docs, benchmark, **options).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
