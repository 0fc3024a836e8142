"""Phrases whose words go together, by exact counts of all runs of words, language by language.

Texts are split into pieces and those into words. A task takes the words of its
texts as numbers, shard after shard of about SHARD_WORDS words, and builds each
shard's suffix array by prefix doubling: positions are ranked by their first
word, then by their first two, four and so on, until the longest wanted phrase is
covered. Neighbours in that order share a prefix of so many words (LCP), and an
interval of the order in which all share m words is a phrase of m words, as often
as the interval is long. Spark adds up the shards' counts by (lang, phrase).

Three passes keep what moves small, and exact: single words, then pairs, then all
phrases. A phrase of LEAST occurrences has only words and pairs of as many, so
runs are cut at words, then at pairs, that are rarer. Tasks know the frequent ones
by a filter of hashed bits, of 32 MiB at most whatever the vocabulary; what it
lets through by accident is counted like the rest and dropped by its count. The
second pass serves that filter alone and adds up pairs by hashes: two that share
one pass together, and the last pass counts them by their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.plans.skew import join_counted

from .shared import discard, prepare, stored
from .textkernel import LOWER, Words, mix, running_sums, to_bytes

LEAST, MOST_WORDS, TOP, UNIT = 100, 5, 2000, 1000
#: A candidate goes if a longer one that holds its words occurs so many times per hundred of its own.
ABSORBED = 100
NO_LANG = "und"
#: Words of a shard, about; bytes that are hashed together, unless a piece is longer.
SHARD_WORDS, BLOCK_BYTES = 1 << 20, 1 << 21
#: Bits of the filter for each frequent phrase, and of a filter at most.
BITS_EACH, FILTER_BITS = 16, 1 << 28

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_BREAK
_WORD[[0x20, 0x09]] = False


def lang_key(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _cut(text: bytes) -> Iterator[bytes]:
    """A text in parts of whole pieces, of BLOCK_BYTES at most unless a piece is longer."""
    raw, at = np.frombuffer(text, np.uint8), 0
    while len(text) - at > BLOCK_BYTES:
        inside = np.flatnonzero(_BREAK[raw[at : at + BLOCK_BYTES]])
        if len(inside):
            end = at + int(inside[-1]) + 1
        else:
            end = at + BLOCK_BYTES
            while end < len(text) and not _BREAK[raw[end]]:
                later = np.flatnonzero(_BREAK[raw[end : end + BLOCK_BYTES]])
                end = end + int(later[0]) if len(later) else min(len(text), end + BLOCK_BYTES)
        yield text[at:end]
        at = end
    yield text[at:]


class Shard:
    """Words of several blocks. key: a hash of language and word; lang: place in names; piece: words of one piece have the
    same number; at, size: the word's bytes in raw, where words follow each other with one space between."""

    def __init__(self) -> None:
        self.names: dict[str, int] = {}
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.words = self.pieces = self.bytes = 0

    def add(self, texts: list[bytes], langs: list[str]) -> None:
        data = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        inside = _WORD[data]
        edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0))
        at, end = edges[::2], edges[1::2]
        text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), at, side="right")
        hashes = Words(len(texts), data, text, at, end, np.empty(0), running_sums(data)).span_hash(at, end)
        lang = np.array([self.names.setdefault(name, len(self.names)) for name in langs], np.int64)[text]
        salt = np.array([lang_key(name) for name in langs], np.uint64)[text]
        piece = np.cumsum(_BREAK[data])[at]
        data[end], inside[end] = 32, True
        size = end - at
        self.parts.append((mix(hashes + salt), lang, piece + self.pieces, np.cumsum(size + 1) - size - 1 + self.bytes, size, data[inside]))
        self.words, self.pieces, self.bytes = self.words + len(at), self.pieces + int(_BREAK[data].sum()) + len(texts) + 1, self.bytes + int(inside.sum())

    def joined(self) -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate(x) for x in zip(*self.parts, strict=True))


def pair_keys(keys: np.ndarray) -> np.ndarray:
    """Of each word and the next."""
    return mix(keys[:-1] * np.uint64(0x9FB21C651E98DF25) + keys[1:])


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether a filter has keys: both of two bits are set for all that were put in, and for few others."""
    last = np.uint64(len(bits) * 8 - 1)
    out = np.ones(len(keys), bool)
    for h in (keys, mix(keys)):
        spot = h & last
        out &= (bits[(spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 != 0
    return out


def suffix_order(ids: np.ndarray, left: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions in the order of the runs that begin there, words that each shares with the one before), as far as
    ``longest`` words. ids: numbers from 1; left: how many words the run has from a position on."""
    n = len(ids)
    rank, span = np.unique(ids, return_inverse=True)[1].astype(np.int64) + 1, 1
    while span < longest:
        after = np.zeros(n, np.int64)
        after[: n - span] = np.where(left[: n - span] > span, rank[span:], 0)
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64) + 1
        span *= 2
    order = np.argsort(rank, kind="stable")
    shared, same = np.zeros(n, np.int64), np.ones(max(0, n - 1), bool)
    for m in range(longest):
        a, b = order[:-1] + m, order[1:] + m
        same &= (left[order[:-1]] > m) & (left[order[1:]] > m)
        same[same] = ids[a[same]] == ids[b[same]]
        shared[1:] += same
    return order, shared


def phrase_counts(ids: np.ndarray, left: np.ndarray, shortest: int, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(m, where a phrase of m words first stands in the order, how often it occurs) for each m: intervals of the suffix
    array that share m words."""
    order, shared = suffix_order(ids, left, longest)
    for m in range(shortest, longest + 1):
        first = np.flatnonzero(shared < m)
        times = np.diff(np.append(first, len(order)))
        whole = left[order[first]] >= m
        yield m, order[first[whole]], times[whole]


def _counts_of(shard: Shard, shortest: int, longest: int, words: np.ndarray | None, pairs: np.ndarray | None, hashed: bool) -> Iterator[pa.RecordBatch]:
    key, lang, piece, at, size, raw = shard.joined()
    go_on = piece[1:] == piece[:-1]  # whether the run goes on after a word
    if pairs is not None:
        go_on[go_on] = passes(pairs, pair_keys(key)[go_on])
    if words is not None:
        known = passes(words, key)
        go_on &= known[1:] & known[:-1]
    # words in runs that are too short for any phrase wanted go at once
    run = np.concatenate([[0], np.cumsum(~go_on)])
    length = np.bincount(run)
    take = length[run] >= shortest
    if shortest == 1 and words is not None:
        take &= known
    key, lang, at, size, run = key[take], lang[take], at[take], size[take], run[take]
    if not len(key):
        return
    last = np.flatnonzero(np.append(run[1:] != run[:-1], True))
    left = np.repeat(last, np.diff(np.concatenate([[-1], last]))) + 1 - np.arange(len(run))
    names = pa.array(list(shard.names), pa.string())
    for m, where, times in phrase_counts(np.unique(key, return_inverse=True)[1] + 1, left, shortest, longest):
        if hashed:
            yield pa.RecordBatch.from_arrays([pa.array(pair_keys(key)[where].view(np.int64)), pa.array(times, pa.int64())], ["key", "n"])
            continue
        for k in range(0, len(where), 100_000):
            w = where[k : k + 100_000]
            start, stop = at[w], at[w + m - 1] + size[w + m - 1]
            wide = stop - start
            offsets = np.concatenate([[0], np.cumsum(wide)])
            spots = np.repeat(start - offsets[:-1], wide) + np.arange(offsets[-1])
            phrase = pa.StringArray.from_buffers(len(w), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw[spots].tobytes()))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(lang[w])), phrase, pa.array(times[k : k + 100_000], pa.int64())], ["lang", "phrase", "n"])


def _counter(shortest: int, longest: int, words=None, pairs=None, hashed: bool = False):
    """Counts of phrases of so many words in the rows (lang, text) of a task, a shard after the other. words, pairs:
    broadcast filters, or none. hashed: of pairs, named by pair_keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [None if b is None else np.frombuffer(b.value, np.uint8) for b in (words, pairs)]
        shard, texts, langs, size = Shard(), [], [], 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for part in _cut(to_bytes(text)):
                    if texts and size + len(part) > BLOCK_BYTES:
                        shard.add(texts, langs)
                        texts, langs, size = [], [], 0
                        if shard.words >= SHARD_WORDS:
                            yield from _counts_of(shard, shortest, longest, *bits, hashed)
                            shard = Shard()
                    texts.append(part)
                    langs.append(lang)
                    size += len(part) + 1
        if texts:
            shard.add(texts, langs)
            yield from _counts_of(shard, shortest, longest, *bits, hashed)

    return run


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    """A table's keys (key), or those of its words (lang, phrase)."""
    if "key" in batch.schema.names:
        return batch.column("key").to_numpy().view(np.uint64)
    shard = Shard()
    shard.add([to_bytes(t) for t in batch.column("phrase").to_pylist()], batch.column("lang").to_pylist())
    return shard.joined()[0]


def _filter_parts(n_bits: int):
    part = min(n_bits, 1 << 20)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bits that a task's phrases set, as rows of up to 2 ** 20 bits."""
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                keys = _keys(batch)
                spots = np.unique(np.concatenate([keys, mix(keys)]) & np.uint64(n_bits - 1)).astype(np.int64)
                for p in np.unique(spots // part).tolist():
                    own = spots[spots // part == p] % part
                    np.bitwise_or.at(held.setdefault(p, np.zeros(part // 8, np.uint8)), own >> 3, (1 << (own & 7)).astype(np.uint8))
        for p, bits in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([bits.tobytes()], pa.binary())], ["part", "bits"])

    return run


def filter_of(frequent: DataFrame):
    """A broadcast filter of stored words (lang, phrase) or keys (key): FILTER_BITS at most."""
    n = frequent.count()
    n_bits = min(FILTER_BITS, 1 << max(10, (BITS_EACH * n - 1).bit_length()))
    out = np.zeros(n_bits // 8, np.uint8)
    parts = min(64, 1 + n // 100_000)  # each sends the filter's bytes at most
    for row in frequent.coalesce(parts).mapInArrow(_filter_parts(n_bits), "part long, bits binary").toLocalIterator():
        bits = np.frombuffer(row["bits"], np.uint8)
        out[row["part"] * len(bits) : (row["part"] + 1) * len(bits)] |= bits
    return frequent.sparkSession.sparkContext.broadcast(out.tobytes())


def frequent_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", *, least: int = LEAST, most_words: int = MOST_WORDS) -> tuple[DataFrame, DataFrame]:
    """(phrases (lang, phrase, words, n) of 1 to most_words words that occur ``least`` times, words a language (lang, n)),
    as stored tables."""
    prepare(docs.sparkSession)
    plain = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text_col).alias("text"))

    def counted(by: list[str], *how, hashed: bool = False) -> DataFrame:
        kinds = ", ".join(f"{c} {'long' if c == 'key' else 'string'}" for c in by)
        return plain.mapInArrow(_counter(*how, hashed=hashed), f"{kinds}, n long").groupBy(*by).agg(F.sum("n").alias("n"))

    named, enough = ["lang", "phrase"], F.col("n") >= least
    every = stored(counted(named, 1, 1), "words")
    totals = stored(every.groupBy("lang").agg(F.sum("n").alias("n")), "lang-words")
    out = stored(every.where(enough), "frequent-words")
    discard(every)
    if most_words >= 2:
        words = filter_of(out)
        keys = stored(counted(["key"], 2, 2, words, hashed=True).where(enough).select("key"), "frequent-pairs")
        out = out.unionAll(stored(counted(named, 2, most_words, words, filter_of(keys)).where(enough), "frequent-phrases"))
        discard(keys)
    return out.withColumn("words", F.size(F.split("phrase", " ")).cast("long")), totals


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", *, least: int = LEAST, most_words: int = MOST_WORDS, top: int = TOP, absorbed: int = ABSORBED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``top`` phrases of each language, as counted in docs.

    a, l, r are the counts of the phrase and of the two parts of its weakest cut,
    n of the language's words. Products are decimals of 38 digits: exact up to
    10 ** 16 occurrences. Null and empty texts have no words, a null language is
    ``und``; repeated rows count as often as they are there; texts of any length
    are read whole, in parts of whole pieces. Ties go to the more frequent phrase,
    then to the lesser one by bytes. An empty table, or one in which nothing is
    frequent, gives no rows; columns of other names aren't looked at.
    """
    phrases, totals = frequent_phrases(docs, lang_col, text_col, least=least, most_words=most_words)
    candidates = phrases.where("words >= 2")
    inner = candidates.where("words >= 3").select("lang", F.explode(F.array(F.expr("substring_index(phrase, ' ', cast(words - 1 as int))"), F.expr("substring_index(phrase, ' ', cast(1 - words as int))"))).alias("phrase"), F.col("n").alias("longer"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))  # a phrase inside one of more words is inside one of one word more, at least as frequent
    kept = candidates.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < absorbed * F.col("n"))).drop("longer")
    kept = stored(kept, "candidates")
    size = kept.groupBy("lang").agg(F.count("*").alias("times"))
    of_lang = totals.withColumnRenamed("n", "n_lang").join(size, "lang")
    cuts = join_counted(kept, of_lang, ["lang"], "times", kept.count()).withColumn("k", F.explode(F.expr("sequence(1, cast(words - 1 as int))")))
    cuts = cuts.select("lang", "phrase", "n", "n_lang", "k", F.expr("substring_index(phrase, ' ', k)").alias("first"), F.expr("substring_index(phrase, ' ', cast(k - words as int))").alias("rest"))
    counts = phrases.select("lang", F.col("phrase").alias("part"), F.col("n").alias("times"))
    sides = cuts.join(counts.toDF("lang", "first", "l"), ["lang", "first"]).join(counts.toDF("lang", "rest", "r"), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(16,0)")
    above, below = F.lit(UNIT).cast("decimal(5,0)") * wide("n") * wide("n_lang"), wide("l") * wide("r")
    scored = sides.withColumns({"above": above, "below": below}).withColumn("score", F.expr("above div below"))
    weakest = scored.groupBy("lang", "phrase", "n", "n_lang").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = weakest.select("lang", "phrase", F.col("n").alias("a"), "cut.l", "cut.r", F.col("n_lang").alias("n"), F.col("cut.score").cast("long").alias("score"))
    return out.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
