import random

import numpy as np
import pytest

from palimpsest.llm import partenum
from palimpsest.llm.textkernel import mix


def shingles(text, n):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def components(rows, n, numerator, denominator):
    sets = [(i, shingles(t, n)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and denominator * len(a & b) >= numerator * len(a | b):
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    return {i: root(i) for i in parent}


@pytest.mark.parametrize("numerator", [80, 90])
def test_linked_sets_share_a_signature(numerator):
    rng, keys_of = np.random.default_rng(3), partenum.signatures(numerator, 100)
    missed = pairs = 0
    for _ in range(400):
        size = int(rng.integers(1, 900))
        a = np.unique(mix(rng.integers(0, 1 << 62, size, dtype=np.uint64)))
        # as different as is allowed: some go and some come
        gone = int(rng.integers(0, len(a) * (100 - numerator) // 100 + 1))
        come = int(rng.integers(0, len(a) * (100 - numerator) // 100 + 1))
        b = np.unique(np.concatenate([a[gone:], mix(rng.integers(0, 1 << 62, come, dtype=np.uint64) + np.uint64(7))]))
        both = len(np.intersect1d(a, b))
        if not both or len(np.union1d(a, b)) == both or 100 * both < numerator * (len(a) + len(b) - both):
            continue
        key, many = keys_of(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), 2)
        pairs += 1
        missed += not len(np.intersect1d(key[: many[0]], key[many[0] :]))
    assert pairs > 100 and missed == 0


def test_bands_leave_no_pair_out():
    for numerator in (50, 80, 85, 90, 99):
        low = partenum.bands_of(10**6, numerator, 100)
        assert all(low[t + 2] * numerator > (low[t + 1] - 1) * 100 for t in range(len(low) - 2))


def words_changed(rng, words, n):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"new{rng.random()}"
    return " ".join(out)


def test_join_is_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, t) for i, t in enumerate([None, "", " \t\n", "a", "A", "a b", "a b c", "a b  C"])]
    for base in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([9, 12, 40, 150, 400]))]
        for _ in range(rng.randrange(1, 9)):
            rows.append((len(rows), words_changed(rng, words, rng.randrange(0, max(1, len(words) // 25) + 1))))
    rows += [(rows[20][0], "another text of the same id, as long as that"), (None, "a b c"), (len(rows), " ".join(f"x{i}" for i in range(20_000)))]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, rep string, keys int")
    for n, numerator in ((3, 90), (5, 80)):
        got = partenum.jaccard_join(df, shingle_words=n, numerator=numerator, denominator=100).collect()
        want = components(rows, n, numerator, 100)
        assert len(got) == len(rows)
        assert all(r.component_id == want.get(r.doc_id) for r in got)
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles) for r in got) == sorted((i is None, i or 0, len(shingles(t, n))) for i, t in rows)
    assert partenum.jaccard_join(df.limit(0)).count() == 0


def test_a_large_group_of_near_copies_is_one(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, words_changed(rng, words, 1)) for i in range(3000)] + [(i, words_changed(rng, [f"y{i}-{k}" for k in range(60)], 1)) for i in range(3000, 3050)]
    got = partenum.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=3, numerator=90, denominator=100).collect()
    assert {r.component_id for r in got if r.doc_id < 3000} == {0} and all(r.component_id == r.doc_id for r in got if r.doc_id >= 3000)
