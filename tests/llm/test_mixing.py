import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import mixing

ADDED = ["size", "source_size", "target", "taken", "copies"]


def plain_sums(rows):
    out = {}
    for r in rows:
        out.setdefault((r["source"], r["source_size"], r["target"]), [0, 0])[0] += r["taken"]
        out[r["source"], r["source_size"], r["target"]][1] += r["size"]
    return out


def test_taken_words_come_near_the_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    one = docs.select("doc_id", "source").dropDuplicates(["doc_id"])
    got = mixing.mix(docs).join(one, "doc_id").collect()
    sizes = {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    targets = mixing.source_targets(sizes)
    for (source, source_size, target), (taken, size) in plain_sums(got).items():
        assert source_size == size and target == pytest.approx(targets[source])
        assert abs(taken - target) <= max(5, 0.002 * target)
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in got)


def test_large_units_are_decided_first():
    r = np.random.default_rng(3)
    sizes = np.sort(np.concatenate([r.integers(1, 60, 300), r.integers(300, 1500, 20)]).astype(float))[::-1]
    p = np.full(len(sizes), 0.37)
    done = mixing.flight(p, sizes, mixing.LANDED)
    open_ = (done > 1e-9) & (done < 1 - 1e-9)
    assert open_.sum() <= mixing.LANDED and sizes[open_].max(initial=0) < 60
    assert done @ sizes == pytest.approx(p @ sizes) and done.sum() == pytest.approx(p.sum())
    landed = mixing.landing(done, sizes, p @ sizes)
    assert set(landed) <= {0, 1} and abs(landed @ sizes - p @ sizes) < 2


def test_landing_mends_what_a_large_unit_leaves():
    sizes = np.array([15_000.0, 15_000, 15_000, *range(60, 0, -2)])
    p = np.full(len(sizes), 0.37)
    landed = mixing.landing(mixing.flight(p, sizes, mixing.LANDED), sizes, p @ sizes)
    best = min(abs(k * 15_000 + s - p @ sizes) for k in range(4) for s in range(0, 931, 2))
    assert abs(abs(landed @ sizes - p @ sizes) - best) < 3


def test_flight_keeps_inclusion_probabilities():
    """Over many different sizes at the end, which seed the coins, the mean of each probability stays."""
    mean = np.zeros(6)
    for k in range(3000):
        sizes = np.array([9000, 700, 60, 50, 7 + k % 53, 6 + k % 59], float)
        mean += mixing.flight(np.full(6, 0.3), sizes) / 3000
    assert np.abs(mean - 0.3).max() < 0.05


@pytest.mark.parametrize("sizes", [[5.0] * 9, [1000.0, 5, 5, 5, 5], [7.0], [], [3.0, 3, 8, 8, 8]])
def test_flight_on_ties(sizes):
    sizes = np.array(sizes)
    p = np.full(len(sizes), 0.4)
    done = mixing.flight(p, sizes)
    assert done.sum() == pytest.approx(p.sum()) and done @ sizes == pytest.approx(p @ sizes)
    assert ((done > 1e-9) & (done < 1 - 1e-9)).sum() <= 3


def test_mixed_documents_of_null_and_repeated_ids(spark):
    r = random.Random(6)
    rows = [(r.choice([None, 1, 2, k]), " ".join("w" for _ in range(r.randrange(0, 60))) if k % 11 else None, f"s{k % 4}" if k % 4 else None, f"tag{k}") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, tag string")
    got = mixing.mixed_documents(docs, block_rows=16)
    assert got.columns == [*docs.columns, *ADDED]
    got = got.collect()
    by_tag = {r[3]: r for r in rows}
    sizes = {}
    for _, text, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    targets = mixing.source_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    assert len({r["tag"] for r in got}) == len(got)
    for r in got:
        assert tuple(r)[:4] == by_tag[r["tag"]]
        assert r["size"] == len(r["text"].split()) and r["taken"] == r["size"] * r["copies"] and 1 <= r["copies"] <= 2
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - targets[s]) <= 3 for s in sizes)
    assert {r["doc_id"] for r in got} >= {None, 1, 2}
    same = sorted((r["tag"], r["copies"]) for r in mixing.mixed_documents(docs, block_rows=16).collect())
    assert same == sorted((r["tag"], r["copies"]) for r in got)
    both = mixing.mix(docs, block_rows=16).collect()
    assert sorted((r["doc_id"] or -1, r["taken"]) for r in both if r["taken"]) == sorted((r["doc_id"] or -1, r["taken"]) for r in got)


def test_mixed_documents_keep_columns_of_the_same_names(spark):
    docs = spark.createDataFrame([(k, "some words here", "s") for k in range(9)], "doc_id long, text string, source string")
    for c in ("size", "Taken", "mix_size", "unit", "doc", "order", "p", "one", "factor"):
        docs = docs.withColumn(c, F.lit(f"own {c}"))
    got = mixing.mixed_documents(docs)
    assert got.columns == [*docs.columns, "mix_mix_size", "source_size", "target", "mix_taken", "copies"]
    assert all(r["size"] == "own size" and r["mix_mix_size"] == 3 and r["unit"] == "own unit" for r in got.collect())
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


def test_crc(spark):
    """The folds that operators hold out are those of this function."""
    assert spark.range(50).select((F.crc32(F.col("id").cast("string")) % 7).alias("f")).collect() == [(zlib.crc32(str(i).encode()) % 7,) for i in range(50)]
