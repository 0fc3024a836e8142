import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import join, nearest, pivots


def clustered(rng, n, words=1, kinds=None):
    """Prints near to some centres, with copies."""
    out, centres = [], [[rng.getrandbits(64) for _ in range(words)] for _ in range(6)]
    for i in range(n):
        w = list(rng.choice(centres))
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(words)] ^= 1 << rng.randrange(64)
        out.append((i, *w))
    return out + [(n + k, *out[0][1:]) for k in range(5)]


def frame(spark, rows):
    signed = lambda w: w if w is None or w < 1 << 63 else w - (1 << 64)
    return spark.createDataFrame([(r[0], *map(signed, r[1:])) for r in rows], "id long, " + ", ".join(f"w{k} long" for k in range(len(rows[0]) - 1)))


def distance(a, b):
    return sum((x ^ y).bit_count() for x, y in zip(a[1:], b[1:], strict=True))


def linked(rows, threshold):
    """What linked_kinds() gives, from all pairs."""
    least = {}
    for r in rows:
        least[r[1:]] = min(r[0], least.get(r[1:], r[0]))
    kinds = [(i, *w) for w, i in least.items()]
    out = {(min(a[0], b[0]), max(a[0], b[0]), distance(a, b)) for k, a in enumerate(kinds) for b in kinds[:k] if distance(a, b) < threshold}
    return out | {(least[r[1:]], r[0], 0) for r in rows if least[r[1:]] != r[0]}


@pytest.mark.parametrize("words", [1, 2])
def test_linked_kinds_by_each_strategy(spark, words, monkeypatch):
    monkeypatch.setattr(join, "JOINED_ROWS", 20)
    monkeypatch.setattr(join, "BLOCK_ROWS", 50)
    rows = clustered(random.Random(words), 250, words)
    df = frame(spark, [*rows, rows[3], (900, *[None] * words)])
    for strategy in ("broadcast", "band", "block"):
        got = [tuple(r) for r in join.linked_kinds(df, 6, strategy).collect()]
        assert len(got) == len(set(got)) and set(got) == linked(rows, 6)
    assert {tuple(r) for r in pivots.linked_by_pivots(df, 6).collect()} == linked(rows, 6)


def test_pair_counts_multiply_copies(spark, monkeypatch):
    monkeypatch.setattr(join, "JOINED_ROWS", 20)
    rows = clustered(random.Random(5), 200)
    want = {}
    for k, a in enumerate(rows):
        for b in rows[:k]:
            if (d := distance(a, b)) < 5:
                want[d] = want.get(d, 0) + 1
    for strategy in ("broadcast", "band", "block"):
        assert {r.dist: r.pairs for r in join.pair_counts(frame(spark, rows), 5, strategy).collect()} == want


@pytest.mark.parametrize("listed", [False, True])
def test_search_of_many(spark, listed):
    rows = clustered(random.Random(9), 200)
    df = frame(spark, [*rows, (901, None)])
    for strategy in ("broadcast", "block"):
        got = [tuple(r) for r in join.search(df.where("id % 20 = 0"), df, 6, listed=listed, strategy=strategy).collect()]
        assert len(got) == len(set(got))
        named = {kind: {} for kind in ("query", "copy")}
        for kind, a, b, _ in got:
            if kind != "match":
                named[kind].setdefault(a, {a}).add(b)
        found = {(q, i, d) for kind, a, b, d in got if kind == "match" for q in named["query"].get(a, {a}) for i in named["copy"].get(b, {b}) if listed or q != i}
        assert found == {(q[0], r[0], distance(q, r)) for q in rows if q[0] % 20 == 0 for r in rows if distance(q, r) < 6 and (listed or q[0] != r[0])}


def test_copies_make_no_pairs(spark):
    df = spark.range(100_000).select("id", F.lit(7).cast("long").alias("w0"))
    got = join.linked_kinds(df, 10)
    assert got.count() == 99_999 and got.where("a <> 0 or dist <> 0").count() == 0
    assert join.pair_counts(df, 10).collect()[0].pairs == 100_000 * 99_999 // 2


def test_a_hot_band_costs_little_more_than_a_cold_one(spark):
    words = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 30_000)
    hot = words.copy()
    hot[::2] &= ~np.int64((1 << 13) - 1)  # half of all rows share the lowest 13 bits
    took = {}
    for name, w in (("warm", words), ("cold", words), ("hot", hot)):
        df = spark.createDataFrame(enumerate(w.tolist()), "id long, w0 long").repartition(4)
        began = time.time()
        join.linked_kinds(df, 5, "band").count()
        took[name] = time.time() - began
    assert took["hot"] < 2.5 * took["cold"] + 2


@pytest.mark.parametrize("k", [1, 4])
def test_nearest_is_brute_force(spark, k, monkeypatch):
    for name, value in (("BLOCK_QUERIES", 7), ("TILE_ITEMS", 13), ("TILE_QUERIES", 3), ("CHAIN_ITEMS", 40)):
        monkeypatch.setattr(nearest, name, value)
    rows = clustered(random.Random(3), 150, 2)
    df = frame(spark, [*rows, rows[3], (901, None, None)])
    got = sorted(tuple(r) for r in nearest.nearest(df.where("id % 5 = 0"), df, k).collect())
    want = []
    for q in rows:
        if q[0] % 5 == 0:
            best = sorted((distance(q, r), r[0]) for r in rows if r[0] != q[0])[:k]
            want += [(q[0], n, i, d) for n, (d, i) in enumerate(best, 1)]
    assert got == sorted(want)
    assert nearest.nearest(df, df.limit(0), k).count() == 0 and nearest.nearest(df.limit(0), df, k).count() == 0


def test_nearest_of_fewer_items_than_asked_and_of_many_copies(spark):
    df = spark.range(5000).select("id", F.lit(7).cast("long").alias("w0")).unionAll(spark.sql("select 9000L, 6L"))
    got = nearest.nearest(df.where("id in (0, 2, 4999, 9000)"), df, 3).collect()
    assert sorted((r.query, r["rank"], r.id, r.dist) for r in got) == [(0, 1, 1, 0), (0, 2, 2, 0), (0, 3, 3, 0), (2, 1, 0, 0), (2, 2, 1, 0), (2, 3, 3, 0), (4999, 1, 0, 0), (4999, 2, 1, 0), (4999, 3, 2, 0), (9000, 1, 0, 1), (9000, 2, 1, 1), (9000, 3, 2, 1)]
    few = frame(spark, [(1, 5), (2, 4)])
    assert [tuple(r) for r in nearest.nearest(few, few, 9).orderBy("query").collect()] == [(1, 1, 2, 1), (2, 1, 1, 1)]


@pytest.mark.parametrize("threshold", [4, 8])
def test_pivots_skip_cells_and_lose_nothing(spark, threshold, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK_ROWS", 60)  # the ring of a dense cluster is cut
    rng = np.random.default_rng(7)
    centres = rng.integers(-(1 << 63), 1 << 63, 200)
    w = np.concatenate([centres[rng.integers(0, 200, 3000)] ^ (np.int64(1) << rng.integers(0, 63, 3000)) ^ (np.int64(1) << rng.integers(0, 63, 3000)), np.full(300, centres[0]) ^ (np.int64(1) << rng.integers(0, 63, 300))])
    df = spark.createDataFrame(enumerate(w.tolist()), "id long, w0 long")
    want = {tuple(r) for r in join.linked_kinds(df, threshold, "block").collect()}
    assert {tuple(r) for r in pivots.linked_by_pivots(df, threshold).collect()} == want and len(want) > 1000
    kinds = join.kinds_of(df)
    n, compared = kinds.count(), pivots.rings(pivots.placed(kinds, threshold)).selectExpr("sum(residents * visitors)").first()[0]
    print(f"threshold {threshold}: {1 - compared / n / n:.3f} of all comparisons are skipped")
    assert compared < 0.3 * n * n


def test_fingerprints_of_five_words(spark):
    """Distances beyond what a byte holds, groups and nearest items as by brute force."""
    rng = random.Random(12)
    rows = clustered(rng, 150, 5) + [(900, *[0] * 5), (901, *[2**64 - 1] * 5)]  # 320 bits apart
    want = sorted((a[0], b[0], distance(a, b)) for a in rows for b in rows if a[0] < b[0] and distance(a, b) < 300)
    for strategy in ("broadcast", "block"):
        assert sorted(map(tuple, join.within(frame(spark, rows), 300, strategy).collect())) == want
    counts = {}
    for a in rows:
        for b in rows:
            if a[0] < b[0]:
                counts[distance(a, b)] = counts.get(distance(a, b), 0) + 1
    assert {r["dist"]: r["pairs"] for r in join.pair_counts(frame(spark, rows), 321, "block").collect()} == counts and 320 in counts
    near = {(r["query"], r["rank"]): (r["id"], r["dist"]) for r in nearest.nearest(frame(spark, rows).where("id = 900"), frame(spark, rows), len(rows)).collect()}
    order = sorted((distance(rows[-2], b), b[0]) for b in rows if b[0] != 900)
    assert near == {(900, k): (i, d) for k, (d, i) in enumerate(order, 1)}


def test_arrays_of_other_lengths_are_errors(spark):
    rows = [(1, [1, 2, 3, 4]), (2, [1, 2, 3]), (3, None), (4, [1, None, 3, 4]), (5, []), (6, [1, 2, 3, 5])]
    found, errors = join.from_arrays(spark.createDataFrame(rows, "id long, words array<long>"), "words", 4)
    assert sorted(map(tuple, join.linked_kinds(found, 2).collect())) == [(1, 6, 1)]
    assert sorted((r["id"], r["words"], r["error"]) for r in errors.collect()) == [(2, 3, "a fingerprint of 3 words, where others have 4"), (4, 4, "a fingerprint with a null word"), (5, 0, "a fingerprint of 0 words, where others have 4")]
