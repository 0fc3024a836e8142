"""Quality classifier: hashed word n-gram logistic regression, trained with
follow-the-regularised-leader updates and scored as sparse dot products.

A text is a sequence of runs: of letters, of digits, of other marks. Each run
counts as a word. Features are hashed n-grams of two kinds of words: the
lower-cased runs themselves (one and two words) and their shapes (one to three:
kind, capitals, length class, whether the run repeats the one before it or
occurred in the text before). A feature's value is its share of the text's
words, so a score doesn't depend on the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import fitted, sigmoid
from .shared import prepare
from .textkernel import LOWER, SPACE, blocks, mix, running_sums

SIZE_BITS = 17
#: Labelled rows that training takes at most, chosen by a hash of their id.
TRAIN_ROWS = 4000
SCALE = 20.0
THRESHOLD = 0.7
_KIND = np.full(256, 3, np.int8)
_KIND[SPACE] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_SMALL = np.zeros(256, np.int64)
_SMALL[97:123] = 1


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, index, words of doc): one entry for each n-gram, repeated as it repeats."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    kind = _KIND[data]
    cut = np.flatnonzero(np.diff(kind, prepend=0))
    at = cut[kind[cut] > 0]
    end = np.append(cut, len(data))[np.searchsorted(cut, at) + 1]
    doc = np.searchsorted(ends, at, side="right")
    sums = running_sums(LOWER[data])
    from .textkernel import _power_tables

    word = mix((sums[end] - sums[at]) * _power_tables(len(data) + 1)[1][at] + (end - at).astype(np.uint64))
    up, low = np.concatenate([[0], np.cumsum(_UPPER[data])]), np.concatenate([[0], np.cumsum(_SMALL[data])])
    ups, lows, size = up[end] - up[at], low[end] - low[at], end - at
    case = np.where(ups == 0, 0, np.where(lows > 0, 1, np.where(ups > 1, 3, 2)))
    same_doc = np.zeros(len(at), bool)
    same_doc[1:] = doc[1:] == doc[:-1]
    again = np.zeros(len(at), bool)
    again[1:] = same_doc[1:] & (word[1:] == word[:-1])
    pair = word.copy()
    pair[1:] = np.where(same_doc[1:], mix(word[:-1] * np.uint64(3) + word[1:]), word[1:])
    before = np.ones(len(at), bool)
    if len(at):
        before[np.unique(pair ^ mix(doc.astype(np.uint64) + np.uint64(1)), return_index=True)[1]] = False
    shape = (kind[at].astype(np.int64) * 4 + case) * 8 + np.minimum(7, np.int64(np.log2(size + 0.5) * 2))
    shape = ((shape * 2 + again) * 2 + before).astype(np.uint64)
    docs, index = [], []
    for seq, n, seed in ((word, 1, 1), (word, 2, 2), (shape, 1, 3), (shape, 2, 4), (shape, 3, 5)):
        m = len(at) - n + 1
        if m <= 0:
            continue
        h = np.full(m, np.uint64(seed), np.uint64)
        for k in range(n):
            h = h * np.uint64(0x9FB21C651E98DF25) + seq[k : k + m]
        ok = doc[:m] == doc[n - 1 :]
        docs.append(doc[:m][ok])
        index.append((mix(h[ok]) >> np.uint64(64 - SIZE_BITS)).astype(np.int32))
    count = np.bincount(doc, minlength=len(texts))
    if not docs:
        return np.empty(0, np.int64), np.empty(0, np.int32), count
    return np.concatenate(docs), np.concatenate(index), count


def _rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for first, texts in blocks(frame["text"]):
            doc, index, count = features(texts)
            key, times = np.unique(doc * (1 << SIZE_BITS) + index, return_counts=True)
            cuts = np.searchsorted(key, np.arange(len(texts) + 1) << SIZE_BITS)
            index = (key & ((1 << SIZE_BITS) - 1)).astype(np.int32)
            part = frame.iloc[first : first + len(texts)]
            yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "label": part["label"].to_numpy(), "index": [index[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], "value": [np.float32(SCALE * times[a:b] / max(1, n)) for a, b, n in zip(cuts[:-1], cuts[1:], count, strict=True)]})


def sample_of_labels(labels: DataFrame, label: str, folds: int, out: int, limit: int) -> DataFrame:
    """(doc_id, label) of at most ``limit`` rows outside the held-out fold, by a hash of the id. Null labels and ids go;
    of several labels of an id the largest counts."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    return known.where(F.crc32(F.col("doc_id").cast("string")) % folds != out).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", folds: int = 4, out: int = 2, limit: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """(weights, bias). Without usable labels: zero weights."""
    prepare(docs.sparkSession)
    chosen = sample_of_labels(labels, label, folds, out, limit)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = plain.join(F.broadcast(chosen), "doc_id").mapInPandas(_rows, "doc_id long, label int, index array<int>, value array<float>")
    return fitted(rows, 1 << SIZE_BITS)


def _scorer(weights: np.ndarray, bias: float):
    def run(texts: list[bytes]) -> np.ndarray:
        doc, index, count = features(texts)
        return sigmoid(bias + SCALE * np.bincount(doc, weights[index], minlength=len(texts)) / np.maximum(1, count))

    return run


def score(docs: DataFrame, model: tuple[np.ndarray, float], name: str = "quality_score") -> DataFrame:
    """docs with a column of this name (0 to 1, never null; an empty or null text gets what the bias says), in the place
    of one that docs may have of that name."""
    prepare(docs.sparkSession)
    handle = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def quality(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = _scorer(*handle.value)
        for texts in parts:
            yield pd.Series(np.concatenate([run(block) for _, block in blocks(texts)] or [np.empty(0)]))

    return docs.withColumn(name, quality("text"))


def classify(docs: DataFrame, labels: DataFrame, *, folds: int = 4, out: int = 2, threshold: float = THRESHOLD, limit: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    A null id counts as not held out and has no label; a null text is an empty one. Rows of a repeated id are scored
    each for itself and share their label; of several labels the largest counts. Whole texts are scored, however long.
    An empty table gives an empty table, and without usable labels every score is the same. Other columns of docs, of
    any name, aren't looked at.
    """
    scored = score(docs.select("doc_id", "text"), train(docs, labels, folds=folds, out=out, limit=limit))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == out, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with docs' own columns, whatever their names. Null and empty texts get
    what the bias says; rows of repeated ids and of null ids are judged each by its text; an empty table stays empty."""
    threshold, name = options.pop("threshold", THRESHOLD), "_quality"
    while any(c.lower() == name for c in docs.columns):
        name += "_"
    scored = score(docs, train(docs, labels, **options), name)
    return scored.where(F.col(name) >= threshold).select(*(F.col(f"`{c}`") for c in docs.columns))
