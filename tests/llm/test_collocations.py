import random
import re
from collections import Counter

import numpy as np

from palimpsest.llm import collocations


def plain(docs, least, most_words=5, top=2000, absorbed=100):
    n, f = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, most_words + 1):
                f.update((lang, tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in candidates.items():
        if any(x == lang and len(q) > len(p) and inside(p, q) and 100 * b >= absorbed * a for (x, q), b in candidates.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, rank, p.decode(), -a, left, right, n[lang], -score) for lang, rows in out.items() for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1))


def test_collocations_are_brute_force(spark):
    rng = random.Random(6)
    common = ["new York city", "a b c d e f", "Straße é", "the"]
    make = lambda: " ".join(rng.choice([*common, "x", "y,", "z.", f"u{rng.randrange(40)}", "\tq \n", "end!"]) for _ in range(rng.randrange(0, 60)))
    docs = [(rng.choice(["en", "de", None, "und"]), make()) for _ in range(150)]
    docs += [("en", None), ("de", ""), ("fr", " .,; "), docs[0], docs[0], ("en", "a b c d e f " * 3000)]
    df = spark.createDataFrame([(k, t, 1, "p") for k, t in docs], "lang string, text string, n long, phrase string").repartition(3)
    names = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    for options in ({"least": 8}, {"least": 5, "top": 7, "most_words": 3}, {"least": 6, "absorbed": 60}, {"least": 4, "most_words": 2}):
        got = sorted(tuple(r[c] for c in names) for r in collocations.collocations(df, **options).collect())
        assert got == plain(docs, **options) and got
    assert collocations.collocations(df, least=10**6).count() == 0
    assert collocations.collocations(df.limit(0)).count() == 0


def test_suffix_order_is_sorted_and_shares_are_right():
    rng = np.random.default_rng(2)
    ids = rng.integers(1, 5, 400)
    run = np.cumsum(rng.random(400) < 0.2)
    last = np.flatnonzero(np.append(run[1:] != run[:-1], True))
    left = np.repeat(last, np.diff(np.concatenate([[-1], last]))) + 1 - np.arange(400)
    order, shared = collocations.suffix_order(ids, left, 5)
    prefix = [tuple(ids[i : i + min(5, left[i])].tolist()) for i in order]
    assert sorted(order.tolist()) == list(range(400))
    for k in range(1, 400):
        same = 0
        while same < min(len(prefix[k]), len(prefix[k - 1])) and prefix[k][same] == prefix[k - 1][same]:
            same += 1
        assert shared[k] == same
    for m in range(1, 6):  # equal prefixes are neighbours
        firsts = [p[:m] for p in prefix if len(p) >= m]
        assert len({p for p in firsts}) == 1 + sum(a != b for a, b in zip(firsts, firsts[1:], strict=False))


def test_long_texts_are_cut_at_pieces_only():
    text = b"aa bb. " * 500_000 + b"x" * 5_000_000 + b" y. end"
    parts = list(collocations._cut(text))
    assert b"".join(parts) == text and len(parts) > 2
    assert all(p.endswith(b".") or q.startswith(b".") for p, q in zip(parts, parts[1:], strict=False))


def test_products_beyond_64_bits_are_exact(spark):
    a, n, x, y = 9 * 10**12, 7 * 10**15, 9 * 10**12 + 1, 10**13 + 7
    wide = "cast({} as decimal(16,0))".format
    got = spark.sql(f"select (cast(1000 as decimal(5,0)) * {wide(a)} * {wide(n)}) div ({wide(x)} * {wide(y)}) as s").first().s
    assert got == 1000 * a * n // (x * y)
