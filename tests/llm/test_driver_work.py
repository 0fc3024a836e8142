"""How many jobs near-duplicates ask of the driver: each costs it buffers, plans and threads."""

import uuid

import pytest

from palimpsest.llm import minhash, partenum
from palimpsest.plans.skew import join_counted
from tests.llm.test_minhash import group


def jobs(spark, run):
    name = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name)), out


@pytest.mark.parametrize(("operator", "most"), [(minhash.near_duplicates, 78), (partenum.jaccard_join, 114)])  # 72 and 106; before 86 and 125
def test_small_groups_take_few_jobs(spark, operator, most):
    rows = group(40, 1, words=400) + [(100 + n, " ".join(f"w{n}x{k}" for k in range(30))) for n in range(40)]
    df = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string").repartition(2)
    n, got = jobs(spark, lambda: operator(df, shingle_words=3).collect())
    assert {r["doc_id"]: r["component_id"] for r in got} == {k: 0 if k < 40 else k for k in [r[0] for r in rows] + [900, 901]}
    assert n <= most


def test_join_without_hot_keys_is_one_join(spark):
    left = spark.createDataFrame([(k % 7 if k % 11 else None, k) for k in range(3000)], "k int, v int")
    right = left.where("k < 6").groupBy("k").count().withColumnRenamed("count", "n")
    for how in ("inner", "left"):
        plain, dealt = join_counted(left, right, ["k"], "n", 3000, how, most=500), join_counted(left, right, ["k"], "n", 3_000_000, how)
        assert plain._jdf.queryExecution().analyzed().toString().count("Join") == 1 < dealt._jdf.queryExecution().analyzed().toString().count("Join")
        assert plain.columns == dealt.columns and sorted(map(repr, plain.collect())) == sorted(map(repr, dealt.collect()))


def test_hot_keys_are_dealt_apart_though_their_number_is_known(spark):
    left = spark.createDataFrame([(0 if k % 2 else k, k) for k in range(4000)], "k int, v int")
    right = left.groupBy("k").count().withColumnRenamed("count", "n")
    found = join_counted(left, right, ["k"], "n", 4000, most=2001)
    assert found._jdf.queryExecution().analyzed().toString().count("Join") == 3 and found.count() == 4000
