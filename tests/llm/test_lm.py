"""The language model against a plain one that goes bit by bit."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import lm

TEXTS = [b"the cat sat on the mat", b"the dog sat", b"", b"a cat and a dog and the mat", "é ç x".encode()]
HELD = [b"the mat sat on a cat", b"zebra"]


def plain_counts(texts, order):
    """How often each (context, bits before) has a zero, and a one, next."""
    out = Counter()
    for t in texts:
        s = b"\xff" * lm.CONTEXT + t + b"\xff"
        for i in range(lm.CONTEXT, len(s)):
            bits = f"{s[i]:08b}"
            for k in range(8):
                out[s[i - order : i], bits[:k], bits[k]] += 1
    return out


def plain_inputs(counts, context, byte, left_out):
    """For each bit of the byte: inputs, and the gate."""
    bits, out = f"{byte:08b}", []
    for k in range(8):
        x, sure = [], 0
        for order, c in zip(lm.ORDERS, counts, strict=True):
            own = c[context[-order:], bits[:k], bits[k]] - left_out
            other = c[context[-order:], bits[:k], "10"[int(bits[k])]]
            x.append(math.log((own + 0.4) / (other + 0.4)))
            sure += order >= 2 and own + other > 2
        out.append(([*x, 0.3 if bits[k] == "1" else -0.3], k * lm.SURE + sure))
    return out


def plain_nats(model, counts, context, byte, power):
    total, bits = 0.0, f"{byte:08b}"
    for k, (x, gate) in enumerate(plain_inputs(counts, context, byte, 0)):
        sign = 1 if bits[k] == "1" else -1
        z = sign * max(-12, min(12, sum(a * w for a, w in zip(x, model.weights[gate], strict=True))))
        one = 1 / (1 + math.exp(-z))
        zeros, ones = model.map[gate, min(lm.BINS - 1, max(0, round((z + 8) * 2)))]
        one = (one + (ones + 8 * one) / (zeros + ones + 8)) / 2
        both = sign * power * math.log(one / (1 - one))
        total -= math.log1p(math.exp(-both))
    return total


def table(texts, more=()):
    gram, times = np.unique(lm.grams_of(texts)[1], return_counts=True)
    more = np.setdiff1d(np.array(more, np.uint64), gram)
    gram, times = np.concatenate([gram, more]), np.concatenate([times, np.zeros(len(more), np.int64)])
    order = np.argsort(gram)
    return gram[order], times[order]


def counted(gram, times):
    return [lm.Counted(*lm.summed(lm.keys_of(gram, k), times)) for k in lm.ORDERS]


def some_model():
    r, model = np.random.default_rng(7), lm.Model()
    model.weights = r.normal(0.3, 0.2, model.weights.shape)
    model.map = np.floor(r.random(model.map.shape) * 20)
    return model


@pytest.mark.parametrize("left_out", [0, 1])
def test_inputs_and_gates_bit_by_bit(left_out):
    gram, times = table(TEXTS, [] if left_out else lm.grams_of(HELD)[1])
    plain = [plain_counts(TEXTS, k) for k in lm.ORDERS]
    x, gate = lm.inputs(gram, counted(gram, times), left_out)
    for i, g in enumerate(gram.tolist()):
        raw = g.to_bytes(8, "big")[-lm.CONTEXT - 1 :]
        for k, (values, at) in enumerate(plain_inputs(plain, raw[:-1], raw[-1], left_out)):
            assert gate[k, i] == at and [float(v[k, i]) for v in x] == pytest.approx(values, rel=1e-5, abs=1e-6)


def test_predictions_bit_by_bit():
    model, (gram, times) = some_model(), table(TEXTS, lm.grams_of(HELD)[1])
    plain = [plain_counts(TEXTS, k) for k in lm.ORDERS]
    got = model.nats(*lm.inputs(gram, counted(gram, times)), lm.signs_of(gram))
    for i, g in enumerate(gram.tolist()):
        raw = g.to_bytes(8, "big")[-lm.CONTEXT - 1 :]
        assert got[i].tolist() == pytest.approx([plain_nats(model, plain, raw[:-1], raw[-1], p) for p in lm.POWERS], rel=2e-3)


def test_predictions_are_a_distribution():
    model = some_model()
    for context in lm.grams_of(TEXTS)[1][[3, 10]]:
        every = (int(context) & ~255) + np.arange(256, dtype=np.uint64)
        gram, times = table(TEXTS, every)
        assert np.allclose(np.exp(model.nats(*lm.inputs(every, counted(gram, times)), lm.signs_of(every))).sum(axis=0), 1, atol=1e-4)


def test_a_step_goes_down_the_gradient():
    gram, times = table(TEXTS * 3)
    model, at = lm.Model(), times.astype(np.float32)
    x, gate = lm.inputs(gram, counted(gram, times), 1)
    loss = lambda: float((np.log1p(np.exp(-model.mixed(x, gate))) * at).sum())
    began, start = loss(), model.weights.copy()
    total, grad = np.zeros(lm.SETS), np.zeros_like(start)
    for i, n in enumerate(times):
        for k in range(8):
            v = np.array([float(a[k, i]) for a in x])
            total[gate[k, i]] += n
            grad[gate[k, i]] += n * v / (1 + math.exp(max(-12, min(12, start[gate[k, i]] @ v))))
    model.learn(x, gate, at)
    assert model.weights == pytest.approx(start + lm.RATE * grad / (total[:, None] + 1), rel=1e-4, abs=1e-5)
    for _ in range(20):
        model.learn(x, gate, at)
    assert loss() < began


def test_scores_of_whole_texts_bit_by_bit(spark, monkeypatch):
    """Counts, weights and map as score() has them, then each text byte by byte."""
    models = []
    monkeypatch.setattr(lm, "_valuer", lambda handle, make=lm._valuer: models.append(handle.value[0]) or make(handle))
    rows = [(i, t.decode()) for i, t in enumerate([*TEXTS * 2, *HELD])]
    got = {r["doc_id"]: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    train = [t.encode() for i, t in rows if not got[i]["held_out"]]
    assert len(train) < len(rows)
    plain = [plain_counts(train, k) for k in lm.ORDERS]
    for i, t in rows:
        s = b"\xff" * lm.CONTEXT + t.encode() + b"\xff"
        each = [sum(plain_nats(models[0], plain, s[j - lm.CONTEXT : j], s[j], p) for j in range(lm.CONTEXT, len(s))) for p in lm.POWERS]
        assert got[i]["score"] == pytest.approx(math.log10(sum(map(math.exp, each)) / len(each)), rel=1e-3)


def test_model_beats_its_base_on_most_held_out_texts(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    held = lm.score(df).where("held_out").agg(F.sum("score").alias("score"), F.sum("base_score").alias("base"), F.avg((F.col("score") > F.col("base_score")).cast("int")).alias("better")).first()
    assert held["score"] > held["base"] and held["better"] > 0.7


def test_parts_hold_whole_contexts(spark, monkeypatch):
    """Many small parts and one give the same counts, so scores differ only by the weights' averaging."""
    rows = [(i, t.decode()) for i, t in enumerate(TEXTS * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one = {r["doc_id"]: r["score"] for r in lm.score(df).collect()}
    monkeypatch.setattr(lm, "PART_BYTES", 200)
    many = {r["doc_id"]: r["score"] for r in lm.score(df).collect()}
    assert all(many[i] == pytest.approx(one[i], rel=0.35, abs=1.0) for i in one)


def test_packing():
    r = np.random.default_rng(5)
    for n in (0, 1, 5000):
        key = np.unique(r.integers(0, 1 << 64, n, dtype=np.uint64))
        times = r.integers(0, 1 << 40, len(key))
        back = lm.unpacked(lm.packed(key, times))
        assert (back[0] == key).all() and (back[1] == times).all()


def test_most_frequent_grams_are_no_more_than_asked_for():
    classes = np.array([50, 30, 10, 5, 1])
    assert [lm._least(classes, k) for k in (0, 1, 6, 15, 16, 1000)] == [5, 4, 3, 3, 2, 0]


@pytest.mark.parametrize("bits", [3, 9, 16])
def test_few_grams_are_searched(monkeypatch, bits):
    """Slots that several share give what a plain search gives; a search is for grams whose two slots others have."""
    r = np.random.default_rng(bits)
    gram = np.append(np.unique(r.integers(0, 2**56, 400, dtype=np.uint64)), np.iinfo(np.uint64).max)
    nats = np.append(r.random((len(gram) - 1, 3)), np.zeros((1, 3)), axis=0).astype(np.float32)
    asked = np.concatenate([r.choice(gram[:-1], 5000), r.integers(0, 2**56, 5000, dtype=np.uint64)])
    at = np.searchsorted(gram, asked)
    known, searched = lm.Known(gram, nats, bits), []
    plain = np.searchsorted
    monkeypatch.setattr(lm.np, "searchsorted", lambda a, v, *more: searched.append(len(v)) or plain(a, v, *more))
    got, strange = known.look_up(asked)
    assert (got == np.where((gram[at] == asked)[:, None], nats[at], 0)).all()
    assert strange.tolist() == np.flatnonzero(gram[at] != asked).tolist()
    assert sum(searched) < {3: 10_001, 9: 4000, 16: 40}[bits]
