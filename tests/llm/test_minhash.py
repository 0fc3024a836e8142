"""Near-duplicates of large groups, and how much verification moves."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import minhash


def group(n, edits, words=80, seed=1):
    r = random.Random(seed)
    base = [f"b{k}" for k in range(words)]
    rows = []
    for i in range(n):
        copy = list(base)
        for _ in range(edits):
            copy[r.randrange(words)] = f"e{r.randrange(10**9)}"
        rows.append((i, " ".join(copy)))
    return rows


def moved(spark, rows, monkeypatch):
    """Sets that verification deals to tasks."""
    seen = []
    for name in ("_star_verifier", "_verifier"):
        def count(*args, make=getattr(minhash, name)):
            run = make(*args)
            n = spark.sparkContext.accumulator(0)
            seen.append(n)

            def counted(frames):
                def passed():
                    for f in frames:
                        n.add(len(f))
                        yield f
                return run(passed())
            return counted
        monkeypatch.setattr(minhash, name, count)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    monkeypatch.undo()
    return {r["component_id"] for r in got}, sum(n.value for n in seen)


def test_sets_of_a_large_near_copy_group_move_in_proportion(spark, monkeypatch):
    ids, small = moved(spark, group(1000, 1), monkeypatch)
    assert ids == {0}
    ids, large = moved(spark, group(20_000, 1), monkeypatch)
    assert ids == {0} and large < 1.3 * 20 * small and large < 3 * 20_000


def test_chains_that_no_hub_holds(spark, monkeypatch):
    """Each text links with the next only: what the stars don't link is compared block by block."""
    monkeypatch.setattr(minhash, "BLOCK_TEXTS", 7)
    rows = [(i, " ".join(f"w{k}" for k in range(3 * i, 3 * i + 60))) for i in range(40)] + [(100 + i, " ".join(f"v{i}x{k}" for k in range(30))) for i in range(5)]
    s = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    linked = lambda a, b: 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])
    assert linked(0, 1) and not linked(0, 3)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), bands=60, rows=5).collect()}
    assert got == {i: 0 if i < 40 else i for i, _ in rows}


def test_recall_of_candidates(spark):
    """Pairs a little above the threshold, against brute force."""
    r = random.Random(9)
    rows, pairs = [], []
    for k in range(400):
        base = [f"p{k}w{j}" for j in range(100)]
        copy = list(base)
        for at in r.sample(range(2, 98), 2):
            copy[at] = f"x{k}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
        a, b = ({tuple(t[j : j + 5]) for j in range(96)} for t in (base, copy))
        if 100 * len(a & b) >= 80 * len(a | b):
            pairs.append(2 * k)
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(pairs) > 300 and sum(got[p + 1] == p for p in pairs) >= 0.99 * len(pairs)
    assert all(got[2 * k + 1] == 2 * k + 1 for k in range(400) if 2 * k not in pairs)


def test_links_of_two_sets():
    r = np.random.default_rng(2)
    for _ in range(200):
        a, b = (np.unique(r.integers(0, 40, r.integers(1, 40))) for _ in range(2))
        both = len(set(a.tolist()) & set(b.tolist()))
        assert minhash._linked(a, b, 3, 10) == (10 * both >= 3 * (len(a) + len(b) - both))


def test_many_exact_copies_and_one_hot_key(spark):
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "one text that a third of all rows share with each other").otherwise(F.concat(F.lit("text number "), F.col("id").cast("string"), F.lit(" of its own kind"))).alias("text"))
    got = minhash.near_duplicates(df).groupBy("kept").count().collect()
    assert dict(map(tuple, got)) == {True: 20_001, False: 9_999}
    with pytest.raises(Exception, match="no_such"):
        minhash.near_duplicates(df, "no_such").count()
