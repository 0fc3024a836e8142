import math
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators.selection import key_at, ordered_word, value_at, value_of_bits


@pytest.mark.parametrize("kind", ["double", "long"])
def test_every_place_is_the_sorted_one(spark, kind):
    rng = random.Random(4)
    if kind == "double":
        values = [rng.choice([rng.uniform(-1, 1), rng.uniform(-1e300, 1e300), 0.25, -0.25]) for _ in range(300)] + [math.inf, -math.inf, 5e-324, -5e-324, 0.0]
    else:
        values = [rng.choice([rng.randrange(-(1 << 63), 1 << 63), rng.randrange(-5, 5)]) for _ in range(300)] + [-(1 << 63), (1 << 63) - 1]
    df = spark.createDataFrame([(v,) for v in [*values, None]], f"x {kind}")
    for place in (0, 1, 77, 150, len(values) - 1):
        assert value_at(df, "x", place) == sorted(values)[place]
    assert value_at(df, "x", len(values)) is None and value_at(df, "x", -1) is None
    assert value_at(df.limit(0), "x", 0) is None


def test_zeros_are_equal_and_nan_is_the_greatest(spark):
    df = spark.createDataFrame([(math.nan,), (-0.0,), (0.0,), (math.inf,)], "x double")
    words = [r.w for r in df.select(ordered_word(df, "x").alias("w")).collect()]
    assert words[1] == words[2] and words[0] == max(words) and math.isnan(value_of_bits(max(words)))


def test_keys_of_two_columns_with_a_hot_value(spark):
    rows = [(7 if i % 3 else -i, i * 7919 % 1000) for i in range(900)]
    df = spark.createDataFrame(rows, "score long, id long")
    keyed = df.select(ordered_word(df, "score", descending=True).alias("s"), F.col("id"))
    want = sorted((~s, i) for s, i in rows)
    for place in (0, 3, 450, 599, 600, 899):
        assert key_at(keyed, ["s", "id"], place) == want[place]
