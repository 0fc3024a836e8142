"""Importance resampling of documents towards a target distribution, over hashed word features.

Features are the runs of one and two words of a text. Their CRC-32 puts them
into BUCKETS buckets, and a bucket's gain is the logarithm of how much more often
the target texts use it than all documents do. A document's weight is the mean
gain of its features; with Gumbel noise from a hash of its id added, the highest
scores are a draw without replacement in proportion to the weights.

Counts are arrays of BUCKETS numbers that tasks add up over their rows before
Spark adds them up; gains are as many numbers, whatever the corpus, and go to all
tasks. Scores are stored as four numbers a document. The k-th best key (score,
doc_id) is found by counting digits (operators.selection), so only the selected
rows are sorted, by ranges. Everything covers whole texts and all documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.selection import key_at, ordered_word
from palimpsest.plans.numbering import numbered

from .shared import prepare, stored
from .textkernel import LOWER, blocks

BUCKETS, UNIT = 10_000, 1000
SEED, MIN_WORDS, PERCENT = 7, 20, 25
#: Words up to so many bytes take their checksums from arrays; longer ones one at a time.
ARRAY_BYTES = 32

#: Bytes of words: digits, letters, and all of characters beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_POLYNOMIAL = np.uint32(0xEDB88320)


@cache
def _byte_table() -> np.ndarray:
    """The CRC register after one byte, by the low byte of register and data."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & np.uint32(1), _POLYNOMIAL ^ (t >> np.uint32(1)), t >> np.uint32(1))
    return t


@cache
def _shift_tables() -> np.ndarray:
    """[n, k, b]: what byte k, of value b, of a checksum becomes after n zero bytes; a checksum of joined texts is that of
    the first one moved on by the second one's length, xor the second one's."""
    out = np.zeros((ARRAY_BYTES + 1, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    t = _byte_table()
    for n in range(ARRAY_BYTES):
        out[n + 1] = t[out[n] & np.uint32(255)] ^ (out[n] >> np.uint32(8))
    return out


def _moved(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    t = _shift_tables()
    out = t[n, 0, crc & np.uint32(255)]
    for k in (1, 2, 3):
        out = out ^ t[n, k, (crc >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def word_checksums(raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of the spans raw[at : at + size]."""
    table, out = _byte_table(), np.empty(len(at), np.uint32)
    short = np.flatnonzero(size <= ARRAY_BYTES)
    order = short[np.argsort(-size[short], kind="stable")]
    register, start = np.full(len(order), 0xFFFFFFFF, np.uint32), at[order]
    left = np.searchsorted(-size[order], -np.arange(1, ARRAY_BYTES + 1), side="right")  # words of so many bytes and more
    for i, n in enumerate(left.tolist()):
        if not n:
            break
        r = register[:n]
        register[:n] = table[(r ^ raw[start[:n] + i]) & np.uint32(255)] ^ (r >> np.uint32(8))
    out[order] = register ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > ARRAY_BYTES).tolist():
        out[i] = zlib.crc32(raw[at[i] : at[i] + size[i]])
    return out


def features_of(texts: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, document of each feature, its bucket), in no certain order; repeats count."""
    raw = LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    edges = np.flatnonzero(np.diff(_WORD[raw].view(np.int8), prepend=0))
    at, size = edges[::2], edges[1::2] - edges[::2]
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), at, side="right")
    one = word_checksums(raw, at, size)
    first = np.flatnonzero(doc[1:] == doc[:-1])  # the words that another of the same text follows
    second, two = first + 1, np.empty(len(first), np.uint32)
    near = size[second] <= ARRAY_BYTES
    f, s = first[near], second[near]
    spaced = _byte_table()[((one[f] ^ np.uint32(0xFFFFFFFF)) ^ np.uint32(32)) & np.uint32(255)] ^ ((one[f] ^ np.uint32(0xFFFFFFFF)) >> np.uint32(8)) ^ np.uint32(0xFFFFFFFF)
    two[near] = _moved(spaced, size[s]) ^ one[s]
    for i in np.flatnonzero(~near).tolist():
        b = second[i]
        two[i] = zlib.crc32(raw[at[b] : at[b] + size[b]], zlib.crc32(b" ", int(one[first[i]])))
    return np.bincount(doc, minlength=len(texts)), np.concatenate([doc, doc[first]]), np.concatenate([one, two]) % np.uint32(buckets)


def _counter(buckets: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for frame in frames:
            for _, texts in blocks(frame["text"]):
                total += np.bincount(features_of(texts, buckets)[2], minlength=buckets)
        found = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": found, "n": total[found]})

    return run


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of the features of all texts; buckets without any are left out."""
    plain = texts.select(F.col(text_col).alias("text"))
    return plain.mapInPandas(_counter(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket, as whole thousandths: ``buckets`` numbers, which all tasks get."""
    own, wanted = (np.zeros(buckets) for _ in range(2))
    for held, counts in ((own, bucket_counts(docs, text_col, buckets)), (wanted, bucket_counts(target, target_text_col, buckets))):
        for bucket, n in counts.collect():  # at most ``buckets`` rows
            held[bucket] = n
    return np.floor(UNIT * np.log((wanted + 1) * (own.sum() + buckets) / ((own + 1) * (wanted.sum() + buckets)))).astype(np.int64)


def _weigher(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in blocks(batch.column("text").to_pylist()):
                words, doc, bucket = features_of(texts, len(gain))
                n = np.bincount(doc, minlength=len(texts))
                total = np.zeros(len(texts), np.int64)
                np.add.at(total, doc, gain[bucket])
                ids = batch.column("doc_id").slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (words, n, total // np.maximum(n, 1)))], ["doc_id", "n_words", "n_features", "weight"])

    return run


def scored(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of each row; a null id gets a null score."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-UNIT * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    return plain.mapInArrow(_weigher(gain), "doc_id long, n_words long, n_features long, weight long").withColumn("score", F.col("weight") + noise)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", *, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs. Of the N rows with an id and at least min_words words,
    the percent * N // 100 best by score get ranks from 1, ties by the smaller id; all others have none.

    Null, empty and wordless texts have no features and weight 0; very long ones
    are read whole. Rows of a repeated id each count, and where their scores are
    equal too the one of fewer features comes first. A row with a null id is
    returned with a null score and isn't drawn. An empty target or empty docs
    need no other treatment: no docs give no rows. Other columns aren't looked at.
    """
    prepare(docs.sparkSession)
    gain = gains(docs, target, text_col, target_text_col, buckets)
    rows = stored(scored(docs, gain, id_col, text_col, seed), "scored")
    keys = ["by_score", "by_id", "by_size"]
    open_ = rows.where((F.col("n_words") >= min_words) & F.col("doc_id").isNotNull()).withColumns({k: ordered_word(rows, c, descending=c == "score") for k, c in zip(keys, ("score", "doc_id", "n_features"), strict=True)})
    take = open_.count() * percent // 100
    out = ["doc_id", "n_features", "weight", "score"]
    rank = F.lit(None).cast("long").alias("rank")
    last = key_at(open_, keys, take - 1) if take else None
    if last is None:
        return rows.select(*out, rank)
    a, b, c = (F.lit(v).cast("long") for v in last)
    best = (F.col("by_score") < a) | ((F.col("by_score") == a) & ((F.col("by_id") < b) | ((F.col("by_id") == b) & (F.col("by_size") <= c))))
    ranked = numbered(open_.where(best).select(*out, *keys), keys, "place", 1)
    drawn = ranked.select(*out, F.when(F.col("place") <= take, F.col("place")).alias("rank"))  # rows equal to the last one may be more than there is room for
    closed = rows.where((F.col("n_words") < min_words) | F.col("doc_id").isNull())
    return closed.select(*out, rank).unionAll(open_.where(~best).select(*out, rank)).unionAll(drawn)
