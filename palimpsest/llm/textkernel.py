"""Vectorised tokenising and hashing of whole texts, shared by the operators.

A block of texts is one byte array. Words are the runs of bytes outside
``\\x20\\x09-\\x0D``; since UTF-8 never uses those bytes inside a longer
character, this equals the regular expression ``[^\\x20\\x09-\\x0D]+`` over code
points. A word's hash comes from one running sum of ``T[byte] * P**index`` over
the block: the difference of two entries, divided by ``P**start`` (P is odd and
so has an inverse modulo 2**64), depends on the word's bytes only.

Null texts count as empty. Nothing is cut: blocks are split between texts, and
a text longer than the limit has a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

BLOCK_BYTES = 1 << 21
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_T = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 21)
        for k, base in enumerate((_P, _P_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def seeded(h: np.ndarray, seed: int) -> np.ndarray:
    return mix(h + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64)))


def to_bytes(text: object) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def blocks(texts, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, encoded texts), at most ``limit`` bytes unless one text is longer."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        data = to_bytes(text)
        if held and size + len(data) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(data)
        size += len(data) + 1
    if held:
        yield first, held


@dataclass
class Words:
    """Words of a block, in order. doc: the word's text; at, end: byte offsets in raw."""

    n_docs: int
    raw: np.ndarray
    doc: np.ndarray
    at: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    sums: np.ndarray

    def span_hash(self, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte spans, as those of whole words."""
        _, inverse = _power_tables(len(self.raw) + 1)
        h = (self.sums[end] - self.sums[at]) * inverse[at]
        return mix(h + (end - at).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def per_doc(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)


def running_sums(raw: np.ndarray) -> np.ndarray:
    powers, _ = _power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_T[raw] * powers[: len(raw)], out=sums[1:])
    return sums


def words_of(texts: list[bytes], lower: bool = True) -> Words:
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    raw = LOWER[data] if lower else data
    ends_of_docs = np.cumsum([len(t) + 1 for t in texts])
    inside = ~SPACE[raw]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0))
    at, end = edges[::2], edges[1::2]
    words = Words(len(texts), raw, np.searchsorted(ends_of_docs, at, side="right"), at, end, np.empty(0), running_sums(raw))
    words.hash = words.span_hash(at, end)
    return words


def ngrams(words: Words, n: int, whole_if_short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash) of every run of n words. whole_if_short: a text of fewer words gives its whole sequence as one."""
    count = words.per_doc()
    m = len(words.hash) - n + 1
    salt = np.uint64(n)
    if m > 0:
        h = np.full(m, salt, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x9FB21C651E98DF25) + words.hash[k : k + m]
        ok = words.doc[:m] == words.doc[n - 1 :]
        doc, h = words.doc[:m][ok], mix(h[ok])
    else:
        doc, h = np.empty(0, np.int64), np.empty(0, np.uint64)
    if whole_if_short:
        firsts = np.concatenate([[0], np.cumsum(count)])
        short = np.flatnonzero((count > 0) & (count < n))
        more = []
        for d in short:
            x = np.full(1, np.uint64(count[d]), np.uint64)
            for w in words.hash[firsts[d] : firsts[d + 1]]:
                x = x * np.uint64(0x9FB21C651E98DF25) + w
            more.append(mix(x))
        if more:
            doc, h = np.concatenate([doc, short]), np.concatenate([h, *more])
    return doc, h
