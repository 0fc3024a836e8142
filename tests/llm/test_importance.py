import hashlib
import math
import random
import re
import zlib

from palimpsest.llm import importance


def plain(docs, target, buckets=50, percent=25, least=3, seed=7):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return words, [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]

    place = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [d[1] for d in docs]), (t, target)):
        for text in texts:
            for f in features(text)[1]:
                counts[place(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out = []
    for i, text in docs:
        words, found = features(text)
        weight = sum(gain[place(f)] for f in found) // len(found) if found else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(found), weight, score, None, len(words)])
    open_ = sorted((r for r in out if r[0] is not None and r[5] >= least), key=lambda r: (-r[3], r[0], r[1]))
    for rank, r in enumerate(open_[: len(open_) * percent // 100], 1):
        r[4] = rank
    return sorted((repr(tuple(r[:5])) for r in out))


def rows_of(df):
    return sorted(repr((r.doc_id, r.n_features, r.weight, r.score, r["rank"])) for r in df.collect())


def test_features_are_those_of_plain_code():
    rng = random.Random(1)
    texts = ["", "Hello wOrld 12", "é ü ß foo.bar " + "x" * 40 + " y " + "z" * 33 + " end", "  .. ", "q" * 100_000] + [" ".join("".join(rng.choice("abcdefé9ABC-") for _ in range(rng.randrange(1, 50))) for _ in range(100)) for _ in range(20)]
    words, doc, bucket = importance.features_of([t.encode() for t in texts])
    for i, text in enumerate(texts):
        found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        assert words[i] == len(found)
        assert sorted(bucket[doc == i].tolist()) == sorted(zlib.crc32(f.encode()) % 10_000 for f in [*found, *(f"{a} {b}" for a, b in zip(found, found[1:]))])


def test_resample_is_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"{a}{b}" for a in "abcdeé" for b in ("", "1", "zz")]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs = [(i, text(rng.randrange(0, 30))) for i in range(120)] + [(500, None), (501, ""), (502, "... !"), (None, text(10)), (7, "one two three"), (7, "one two three"), (7, "one two three four"), ((1 << 62) + 1, text(9)), (-5, text(3000))]
    target = [text(12) for _ in range(9)] + [None]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, score long, by_id long")
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    options = {"buckets": 50, "min_words": 3}
    assert rows_of(importance.resample(df, wanted, **options)) == plain(docs, target)
    assert rows_of(importance.resample(df, wanted, percent=100, **options)) == plain(docs, target, percent=100)
    assert rows_of(importance.resample(df, wanted, percent=0, **options)) == plain(docs, target, percent=0)
    assert rows_of(importance.resample(df, wanted.limit(0), **options)) == plain(docs, [])
    assert importance.resample(df.limit(0), wanted).count() == 0
