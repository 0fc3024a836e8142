"""The two classifiers against plain versions."""

import math
import random
import re
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import linear, quality, textkernel, toxicity

M = (1 << 64) - 1


def plain_ftrl(rows, labels, alpha, beta, l1, l2, passes, seed):
    """FTRL-proximal (McMahan and others, 2013), weight by weight."""
    n, positive = len(labels), sum(labels)
    start = math.log((positive + 1) / (n - positive + 1))
    z, g2, zb, gb = {}, {}, 0.0, 0.0

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((beta + math.sqrt(g2.get(i, 0.0))) / alpha + l2)

    order = np.random.Generator(np.random.PCG64(seed))
    for _ in range(passes):
        for k in order.permutation(n):
            index, value = rows[k]
            w = [weight(i) for i in index]
            bias = start - zb / ((beta + math.sqrt(gb)) / alpha)
            p = 1 / (1 + math.exp(-(sum(a * v for a, v in zip(w, value, strict=True)) + bias)))
            for i, v, a in zip(index, value, w, strict=True):
                g = (p - labels[k]) * v
                had = g2.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(had + g * g) - math.sqrt(had)) / alpha * a
                g2[i] = had + g * g
            e = p - labels[k]
            zb += e - (math.sqrt(gb + e * e) - math.sqrt(gb)) / alpha * (bias - start)
            gb += e * e
    return {i: weight(i) for i in z}, start - zb / ((beta + math.sqrt(gb)) / alpha)


def test_ftrl():
    r = np.random.default_rng(4)
    rows = [(r.choice(60, 7, replace=False), r.normal(0, 1, 7)) for _ in range(120)]
    labels = np.array([float(v[i == i.min()][0] > 0) for i, v in rows])
    got, bias = linear.train_ftrl(rows, labels, 60, alpha=0.3, beta=1.0, l1=0.5, l2=1.0, passes=2, seed=7)
    want, plain_bias = plain_ftrl([(i.tolist(), v.tolist()) for i, v in rows], labels.tolist(), 0.3, 1.0, 0.5, 1.0, 2, 7)
    assert bias == pytest.approx(plain_bias) and got.tolist() == pytest.approx([want.get(i, 0.0) for i in range(60)], abs=1e-6)
    assert linear.train_ftrl([], np.empty(0), 8)[1] == 0 and linear.train_ftrl(rows, np.ones(120), 60)[1] == pytest.approx(math.log(121))


def kind(b):
    return 0 if b in textkernel.SPACE.nonzero()[0] else 1 if chr(b).isalpha() and b < 128 or b > 127 else 2 if 48 <= b <= 57 else 3


def hashed(data):
    """The hash of a run, from the kernel's own table, alone in a block of its own."""
    raw = np.frombuffer(data, np.uint8)
    return int(textkernel.mix(np.array([(int(textkernel.running_sums(textkernel.LOWER[raw])[len(raw)]) + len(raw)) & M], np.uint64))[0])


def mixed(x):
    return int(textkernel.mix(np.array([x & M], np.uint64))[0])


def plain_quality(text):
    """Counter of feature indices, and the number of words: run by run."""
    runs = [m.group() for m in re.finditer(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff \t\n\x0b\x0c\r]+", text)]
    words, shapes, seen, last = [], [], set(), None
    for run in runs:
        word = hashed(run)
        ups, lows = sum(65 <= b <= 90 for b in run), sum(97 <= b <= 122 for b in run)
        case = 0 if not ups else 1 if lows else 3 if ups > 1 else 2
        pair = word if last is None else mixed(last * 3 + word)
        shape = (kind(run[0]) * 4 + case) * 8 + min(7, int(math.log2(len(run) + 0.5) * 2))
        shapes.append((shape * 2 + (last == word)) * 2 + (pair in seen))
        seen.add(pair)
        words.append(word)
        last = word
    out = Counter()
    for seq, n, seed in ((words, 1, 1), (words, 2, 2), (shapes, 1, 3), (shapes, 2, 4), (shapes, 3, 5)):
        for i in range(len(seq) - n + 1):
            h = seed
            for k in range(n):
                h = (h * 0x9FB21C651E98DF25 + seq[i + k]) & M
            out[mixed(h) >> (64 - quality.SIZE_BITS)] += 1
    return out, len(runs)


def test_quality_features_and_scores(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()] + ["", None, "A", "Go go GO 12 12 !!! é É", " \n", "the cat the cat the cat"]
    r = np.random.default_rng(3)
    weights, bias = np.where(r.random(1 << quality.SIZE_BITS) < 0.5, r.normal(0, 1, 1 << quality.SIZE_BITS), 0).astype(np.float32), 0.25
    got = quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), (weights, bias)).collect()
    for x in got:
        found, n = plain_quality((x["text"] or "").encode())
        z = bias + sum(quality.SCALE * c / max(1, n) * float(weights[i]) for i, c in found.items())
        assert x["quality_score"] == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-5)


def test_quality_trains_on_the_fold_alone(spark):
    """Labels of the held-out fold, and what other columns say, change nothing."""
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, other = quality.train(docs, labels), quality.train(docs.withColumn("source", F.lit("x")).withColumn("lang", F.lit("y")), flipped)
    assert one[1] == other[1] and (one[0] == other[0]).all() and one[0].any()


def test_kept_documents_keep_their_columns(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("quality_score", F.lit("mine")).withColumn("_quality", F.lit(1)).withColumn("a.b", F.lit(2))
    kept = quality.keep_good(df, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    assert kept.columns == df.columns and {r["quality_score"] for r in kept.select("quality_score").distinct().collect()} == {"mine"}


def every_reading(word, model):
    """The least cost over all paths of the lattice, each spelled out."""
    best = []
    for path in product(*toxicity.lattice(word)):
        said, cost = "".join(s for s, _ in path), sum(c for _, c in path)
        s = f"  {said} "
        best.append((cost + sum(model.nats(s[i - 2 : i + 1]) for i in range(2, len(s))), said))
    return min(best)[0], {said for cost, said in best if cost <= min(best)[0] + 1e-9}


def test_decoding_is_the_best_path_of_the_lattice():
    model = toxicity.CharModel(Counter({"the": 50, "idiot": 5, "moron": 5, "scum": 5, "clown": 5, "trash": 9, "village": 8, "street": 8, "boss": 6, "aisle": 4}))
    r = random.Random(6)
    for _ in range(300):
        word = "".join(r.choice("aeilostrm0134$@!|.-*") * r.choice((1, 1, 1, 2, 3)) for _ in range(r.randrange(1, 7)))
        _, readings = every_reading(word, model)
        assert toxicity.decode(word, model) in readings, word


def test_character_costs_add_up_to_one():
    model = toxicity.CharModel(Counter({"abba": 3, "cab": 2}))
    letters = [*"abc "]
    for context in ("  ", " a", "ab", "bb"):
        known = sum(math.exp(-model.nats(context + c)) for c in letters)
        assert 0.5 < known <= 1.000001


def plain_toxic(text, weights, bias):
    """Words, and the first four and five bytes of longer ones, marks at the ends aside; each counts once."""
    found = set()
    for word in re.findall(rb"[^ \t-\r]+", text.lower()):
        word = re.sub(rb"^[^a-z0-9\x80-\xff]+|[^a-z0-9\x80-\xff]+$", b"", word)
        for k in (4, 5, 0):
            part = word[:k] if k else word
            if len(word) > k and part:
                w = textkernel.words_of([part])
                h = int(w.span_hash(np.array([0]), np.array([len(part)]))[0])
                found.add(mixed(h + k * 1000003 + 17) >> (64 - toxicity.SIZE_BITS))
    return 1 / (1 + math.exp(-(bias + sum(float(weights[i]) for i in found))))


def test_toxic_features_and_scores(spark):
    texts = ["the quick brown foxes", "", None, "A word, another (word)!", "été 2024 x", "y" * 40] + [f"number {k} of some words" for k in range(30)]
    r = np.random.default_rng(8)
    weights = np.where(r.random(1 << toxicity.SIZE_BITS) < 0.5, r.normal(0, 1, 1 << toxicity.SIZE_BITS), 0).astype(np.float32)
    model = toxicity.CharModel(Counter({"the": 5, "word": 5}))
    restore = toxicity.Restorer(model)
    got = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), (model, weights, -0.5)).collect()
    for x in got:
        assert x["toxic_score"] == pytest.approx(plain_toxic(restore.text(x["text"]).encode(), weights, -0.5), rel=1e-5)


def test_planted_toxic_documents_are_found(spark):
    """Of held-out documents of sf0.1 with a label, at the query's threshold."""
    d = "/root/testdata/sf0.1"
    known = spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.classify(spark.read.parquet(f"{d}/documents.parquet").join(known.select("doc_id"), "doc_id", "left_semi"), known).where("held_out").join(known, "doc_id").select("predicted", "toxic").collect()
    toxic = [r for r in got if r["toxic"] == 1]
    clean = [r for r in got if r["toxic"] == 0]
    print(len(toxic), sum(r["predicted"] for r in toxic) / len(toxic), sum(r["predicted"] for r in clean) / len(clean))
    assert sum(r["predicted"] for r in toxic) >= 0.8 * len(toxic) and sum(r["predicted"] for r in clean) <= 0.02 * len(clean)


def test_character_counts_are_bounded_in_any_alphabet(spark):
    r = np.random.default_rng(3)
    texts = ["".join(map(chr, 0x4E00 + r.integers(0, 20_000, 2000))) for _ in range(100)]
    grams = toxicity.trigrams(Counter(texts))
    assert len(grams) <= (27 + toxicity.CLASSES) ** 3 and sum(grams.values()) == 2001 * 100
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(1000, "été à 1d10t"), (1001, None), (1002, "")], "doc_id long, text string")
    got = toxicity.classify(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")).collect()
    assert len(got) == 103 and all(0 <= x["score"] <= 1 for x in got)


def test_accented_letters_stay_apart():
    model = toxicity.CharModel(Counter({"été": 50, "eta": 1}))
    assert model.nats(" ét") < model.nats(" èt") and model.nats("été") < model.nats("étè")
