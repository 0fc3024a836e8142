"""Decontamination against Smith-Waterman alignment of every text with every item, without seeds."""

import random

import numpy as np
import pandas as pd
import pytest

from palimpsest.llm import decontaminate as dc


def hashes(text):
    return dc.words_of([text.encode()]).hash


def edited(r, words, share, vocabulary):
    """A copy with so many of its words replaced, left out or put in."""
    out = []
    for w in words:
        if r.random() >= share:
            out.append(w)
            continue
        kind = r.randrange(4)
        if kind < 2:
            out.append(r.choice(vocabulary))
        elif kind == 2:
            out += [w, r.choice(vocabulary)]
    return out


def made(seed, share, n_items=40, n_docs=160):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(2000)]
    weights = [1 / (k + 10) for k in range(2000)]
    prose = lambda n: r.choices(vocabulary, weights, k=n)
    stock = prose(6)
    items = [[*prose(r.randrange(10, 40)), *(stock if k % 3 == 0 else [])] for k in range(n_items)]
    docs = []
    for k in range(n_docs):
        body = prose(r.randrange(0, 60))
        if k % 4:
            body += edited(r, r.choice(items[:20]), share, vocabulary)
        docs.append(body + (stock if k % 2 else []) + prose(r.randrange(0, 60)))
    return [(i, " ".join(x)) for i, x in enumerate(docs)], [(i, " ".join(x)) for i, x in enumerate(items)]


def plain(docs, items):
    out = set()
    for i, item in items:
        a = hashes(item)
        for d, text in docs:
            if dc.enough(dc.align_item(a, hashes(text))[1], len(a), dc.COVERAGE, dc.LEAST_WORDS):
                out.add((d, i))
    return out


@pytest.mark.parametrize("share", [0.1, 0.2, 0.3])
def test_recall_against_alignment_of_everything(spark, share):
    docs, items = made(round(share * 10), share)
    want = plain(docs, items)
    got = {(x["doc_id"], x["item_id"]) for x in dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got <= want and len(got) >= (0.95 if share < 0.3 else 0.9) * len(want) and len(want) > 60


def test_regular_edits_are_found(spark):
    item = [f"a{k}" for k in range(40)]
    docs = [(n, " ".join(["x"] * 9 + [w if k % n != n - 1 else f"y{k}" for k, w in enumerate(item)] + ["z"] * 9)) for n in (3, 4, 5, 7)]
    got = {x["doc_id"] for x in dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert got == {3, 4, 5, 7}


class Held:
    def __init__(self, value):
        self.value = value


def test_rarity_decides():
    """A stock phrase that many documents share opens no window; a seed of few documents does, and so do an item's rarest,
    and frequent seeds at places apart."""
    stock = "one of the following is true"
    items = [(1, f"{stock} alpha beta gamma delta epsilon zeta"), (2, "of the following words another item has some about water and stone and wood")]
    texts = [f"text {k} {stock} and so on" for k in range(200)] + ["x alpha beta gamma delta y one of the following", items[1][1], f"{stock} alpha beta gamma u v w"] + [f"{stock} alpha beta gamma delta epsilon zeta"] * 60
    docs = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    seeds = dc.Seeds(items)
    counts = np.zeros(len(seeds.first), np.int64)
    for part in dc._counter(Held(seeds))(iter([docs[:90], docs[90:]])):
        counts += np.bincount(part["seed"], part["docs"], minlength=len(counts)).astype(np.int64)
    seeds.choose(counts, 50)
    where = dict(zip(seeds.hash[seeds.first].tolist(), counts.tolist(), strict=True))
    rare = {h: bool(x) for h, i, x in zip(seeds.hash.tolist(), seeds.item.tolist(), seeds.rare, strict=True) if i == 0}
    of_stock = dc.seeds_in(dc.words_of([stock.encode()]), False)[2].tolist()
    assert all(where[h] >= 200 and not rare[h] for h in of_stock) and sum(rare.values()) >= dc.LEAST_SEEDS
    # coverage 0: whatever opens a window stays
    opened = {(d, i) for part in dc._finder(Held(seeds), 0.0, 0, None)(iter([docs])) for d, i in zip(part["doc_id"], part["item_id"], strict=True)}
    assert not any((d, 0) in opened for d in range(200)) and (200, 0) in opened and (201, 1) in opened and (202, 0) in opened and (262, 0) in opened


def test_counts_are_of_documents():
    seeds = dc.Seeds([(1, "a b c d e f")])
    texts = ["a b c d x a b c d", "a b c d e", "b c d e f", ""]
    out = next(dc._counter(Held(seeds))(iter([pd.DataFrame({"text": texts})])))
    n = dict(zip(seeds.hash[seeds.first][out["seed"]].tolist(), out["docs"].tolist(), strict=True))
    first = dc.seeds_in(dc.words_of([b"a b c d"]), False)[2][0]
    assert n[int(first)] == 2


def test_many_passes_find_the_same(spark, monkeypatch):
    docs, items = made(7, 0.1, 12, 40)
    args = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (50, "two words"), (51, None)], "item_id long, text string")
    one = sorted(map(tuple, dc.contaminated(*args).collect()))
    monkeypatch.setattr(dc, "PASS_BYTES", 400)
    assert sorted(map(tuple, dc.contaminated(*args).collect())) == one and one
