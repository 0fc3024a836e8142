"""N-gram Jaccard joins by PartEnum signatures: exact, without candidates missed.

The signatures are those of Arasu, Ganti and Kaushik ("Efficient exact set-similarity
joins", 2006). Sizes of sets fall into bands, each GROWTH times as wide as the one
before. Sets of sizes up to u that link at a similarity of numerator /
denominator differ in at most k = 2 u (denominator - numerator) / (denominator +
numerator) shingles. A hash deals the domain of shingles to n1 parts of PARTS
subparts each, where n1 * (SPARE + 1) > k: so in one part at least, the two sets
differ in no more than SPARE subparts, and they are the same in some PARTS - SPARE
of them. A set's signatures are the hashes of its share of every such choice of
subparts, for its own band, and for the next one where a set of that band can be
as near. Two sets that link share a signature; that isn't a matter of chance.

Copies of a set are one from the start, so sets that differ in nothing (k = 0)
need no signature. A signature's sets aren't compared with each other: each forms
a star with the least one, components of the stars are groups, and links in a
group are confirmed on full sets, block by block, as in near-duplicates.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame

from .minhash import DENOMINATOR, NUMERATOR, SHINGLE_WORDS, linked_sets
from .textkernel import mix, seeded

#: Subparts of a part, and how many of them a signature leaves out.
PARTS, SPARE = 3, 1
GROWTH_NUMERATOR, GROWTH_DENOMINATOR = 3, 2
#: Kinds that signatures are dealt to, of which some at a time merge the classes of a group.
KINDS = 40


def bands_of(largest: int, numerator: int, denominator: int) -> np.ndarray:
    """Least sizes of the bands up to that of the largest set, and of the next one. A set and one of the band after the next
    never link."""
    out = [1]
    while out[-1] <= largest:
        low = out[-1]
        out.append(max(-(-low * GROWTH_NUMERATOR // GROWTH_DENOMINATOR), low * denominator // numerator + 1))
    out.append(max(-(-out[-1] * GROWTH_NUMERATOR // GROWTH_DENOMINATOR), out[-1] * denominator // numerator + 1))
    return np.array(out, np.int64)


def most_different(largest: int | np.ndarray, numerator: int, denominator: int):
    """Shingles that only one of two linked sets has, at most, where neither has more than ``largest``."""
    return 2 * largest * (denominator - numerator) // (denominator + numerator)


def signatures(numerator: int, denominator: int):
    """Keys of sets, as minhash's signer takes them."""
    choices = list(combinations(range(PARTS), PARTS - SPARE))

    def keys(doc: np.ndarray, h: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
        size = np.bincount(doc, minlength=n_docs)
        low = bands_of(int(size.max(initial=1)), numerator, denominator)
        own = np.searchsorted(low, size, side="right") - 1
        content, found, of = seeded(h, 77), [], []
        for later in (0, 1):
            band = np.minimum(own + later, len(low) - 2)
            k = most_different(low[band + 1] - 1, numerator, denominator)
            near = (denominator * size >= numerator * low[band]) & (own + later < len(low) - 1) if later else size > 0
            parts = np.where(near & (k > 0), k // (SPARE + 1) + 1, 0)
            first = np.concatenate([[0], np.cumsum(parts * PARTS)])
            if not first[-1]:
                continue
            salt = seeded(band.astype(np.uint64), 5)
            take = parts[doc] > 0
            d, e = doc[take], h[take]
            spot = ((mix(e + salt[d]) >> np.uint64(32)) * (parts[d] * PARTS).astype(np.uint64)) >> np.uint64(32)
            sums = np.zeros(first[-1], np.uint64)
            np.add.at(sums, first[d] + spot.astype(np.int64), content[take])
            sums = mix(sums).reshape(-1, PARTS)
            owner = np.repeat(np.arange(n_docs), parts)
            place = (np.arange(len(owner)) - first[owner] // PARTS).astype(np.uint64)
            for n, choice in enumerate(choices):
                key = seeded(salt[owner] + place * np.uint64(len(choices)) + np.uint64(n), 9)
                for c in choice:
                    key = mix(key * np.uint64(31) + sums[:, c])
                found.append(key)
                of.append(owner)
        if not found:
            return np.empty(0, np.uint64), np.zeros(n_docs, np.int64)
        key, of = np.concatenate(found), np.concatenate(of)
        return key[np.argsort(of, kind="stable")], np.bincount(of, minlength=n_docs)

    return keys


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle_words: int = SHINGLE_WORDS, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row per row of docs: texts link at denominator * |A and B| >= numerator * |A or
    B|, and a component is named by its least id.

    Null and empty texts, and those of white space only, have an empty set and
    link with nothing; very long ones have as many signatures as their size asks
    for. Rows of a repeated id are one node. A null id gets a null component. An
    empty table gives an empty table; columns of other names aren't looked at.
    """
    return linked_sets(docs, id_col, text_col, signatures(numerator, denominator), KINDS, shingle_words=shingle_words, numerator=numerator, denominator=denominator)
