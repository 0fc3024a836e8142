"""Anti-joins behind a bitmap, and tables that go with the block that made them."""

import os

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import groups
from palimpsest.plans import skipping, storage


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("gone", [[], [5], list(range(0, 4000, 3)), [None, 7, 7, 7]])
@pytest.mark.parametrize("bits, keys", [(1, 0), (18, 0), (18, 500_000)])
def test_equals_the_anti_join(spark, monkeypatch, gone, bits, keys):
    """Also where nearly all bits are set, with null and repeated keys, and with keys of another width."""
    monkeypatch.setattr(skipping, "WORD_BITS", bits)
    monkeypatch.setattr(skipping, "KEYS", keys)
    df = spark.createDataFrame([(k // 2 if k else None, f"x{k}") for k in range(3000)], "id long, other string")
    skip = spark.createDataFrame([(k,) for k in gone], "id int")
    assert rows(skipping.without(df, skip, "id")) == rows(df.join(skip, "id", "left_anti").select("id", "other"))
    assert skipping.without(df, skip, "id").columns == df.columns
    assert skipping.without(df.limit(0), skip, "id").count() == 0


def test_the_bitmap_is_bounded(spark):
    n = spark.range(2_000_000).withColumnRenamed("id", "k")
    assert skipping.bitmap(n, "k").count() <= 1 << skipping.WORD_BITS


def test_rows_that_stay_do_not_move(spark, monkeypatch):
    """Of 20,000 rows, those that meet the exact join are the ones whose bit is set."""
    df, skip = spark.range(20_000), spark.range(100)
    bits = {r["_word"]: r["_bits"] & (2**64 - 1) for r in skipping.bitmap(skip, "id").collect()}
    hashes = [r["h"] & (2**64 - 1) for r in df.select(F.xxhash64("id").alias("h")).collect()]
    maybe = sum(bits.get(h >> (64 - skipping.WORD_BITS), 0) >> (h & 63) & 1 for h in hashes)
    assert 100 <= maybe < 110
    monkeypatch.setattr(skipping, "KEYS", 0)
    assert skipping.without(df, skip, "id").count() == 19_900


def files(spark):
    root = storage.shared_dir(spark).removeprefix("file://") + "/palimpsest"
    return set(os.listdir(root)) if os.path.exists(root) else set()


def test_tables_of_steps_go(spark, monkeypatch):
    monkeypatch.setattr(groups, "HEAD", 25)
    df = spark.range(200).select("id", (F.col("id") * 37 % 64).alias("w0"))
    before = files(spark)
    for strategy in ("block", "band"):
        got = groups.members_of(df, 3, strategy)
        left = files(spark) - before
        assert len(left) == 2 and got.count() > 0
        before |= left


def test_blocks_in_blocks(spark):
    before = files(spark)
    with storage.passing() as outer:
        with storage.passing() as inner:
            a, b = inner(storage.kept(spark.range(3), "a")), storage.kept(spark.range(4), "b")
        assert len(files(spark) - before) == 1 and a.count() == 3
        c = outer(storage.kept(a.unionAll(a), "c"))
    assert len(files(spark) - before) == 1 and c.count() == 6
    with pytest.raises(ValueError), storage.passing():
        storage.kept(spark.range(5), "d")
        raise ValueError(b)
    assert len(files(spark) - before) == 1
