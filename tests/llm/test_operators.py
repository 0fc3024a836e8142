import hashlib
import random
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import chat, decontaminate, licenses, lm, minhash, mixing, quality, secrets, tiff, toxicity
from palimpsest.operators.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASH = ("score", "size", "row", "word", "rep", "cluster", "block", "key", "label", "unit", "p", "target", "_h", "a", "b", "_gone", "seeds", "redacted", "f", "held_out")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def corpus():
    r = random.Random(1)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7))) for _ in range(300)]
    texts = []
    for _ in range(40):
        base = [r.choice(vocabulary) for _ in range(r.randrange(1, 80))]
        texts.append(" ".join(base))
        for _ in range(r.randrange(4)):
            copy = list(base)
            for _ in range(r.randrange(4)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += ["", None, "  \n\t ", "One", "one", "é ç x", "x" * 50_000, " ".join(r.choice(vocabulary) for _ in range(20_000)), texts[0], texts[0]]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(i, t, "en", f"s{i % 3}" if i % 7 else None) for i, t in corpus()], "doc_id long, text string, lang string, source string")
    df = df.unionAll(spark.createDataFrame([(None, "a row without id", "en", "s1")], df.schema))
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 3 and 1, int(i % 5 == 0)) for i, _ in corpus() if i % 2] + [(None, 1, 1), (3, None, None), (5, 1, 1)], "doc_id long, quality int, toxic int")


def sets(n):
    out = {}
    for i, t in corpus():
        w = words(t)
        out[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    return out


@pytest.mark.parametrize(("n", "num"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, n, num):
    s = sets(n)
    parent = {i: i for i in s}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in s:
        for j in range(i):
            both = len(s[i] & s[j])
            if s[i] and s[j] and 100 * both >= num * (len(s[i]) + len(s[j]) - both):
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    got = minhash.near_duplicates(docs, shingle_words=n, numerator=num, denominator=100).collect()
    assert len(got) == docs.count()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got if r["doc_id"] is not None} == {i: (len(s[i]), root(i), root(i) == i) for i in s}
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, False)]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_large_groups_are_verified_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_TEXTS", 10)
    r = random.Random(2)
    base = [str(r.random()) for _ in range(100)]
    rows = [(i, " ".join(w if k != i % 97 else "x" + w for k, w in enumerate(base))) for i in range(60)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {0}


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(None, 4), (7, 7)]
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    near = {}
    for a, b in edges:
        if a is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for start in near:
        seen, todo = {start}, [start]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert got[start] == min(seen)
    assert set(got) == set(near)


@pytest.mark.parametrize(("op", "folds", "out", "cut"), [(quality, 4, 2, 0.7), (toxicity, 5, 0, 0.5)])
def test_classifiers_on_odd_rows(docs, labels, op, folds, out, cut):
    got = op.classify(docs, labels).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % folds == out)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut)
    assert op.classify(docs.limit(0), labels).count() == 0
    assert op.classify(docs, labels.limit(0)).count() == docs.count()


def auc(score, y):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize(("op", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_held_out_accuracy(spark, op, label):
    d = "/root/testdata/sf0.01"
    known = spark.read.parquet(f"{d}/labels.parquet")
    got = op.classify(spark.read.parquet(f"{d}/documents.parquet"), known).where("held_out").join(known, "doc_id").toPandas()
    assert auc(got["score"].to_numpy(), got[label].to_numpy()) > 0.9


def test_deobfuscation():
    model = toxicity.CharModel(Counter({"the": 50, "idiot": 5, "moron": 5, "scum": 5, "clown": 5, "and": 40, "village": 8, "street": 8}))
    restore = toxicity.Restorer(model)
    for said, meant in (("1d10t", "idiot"), ("m0r0n", "moron"), ("s.c.u.m", "scum"), ("cl0wwwn", "clown"), ("i d i o t", "idiot"), ("The street", "the street"), ("", ""), (None, "")):
        assert restore.text(said) == meant


def test_deobfuscation_at_edges_and_between_blanks():
    model = toxicity.CharModel(Counter({"the": 50, "idiot": 5, "trash": 5, "ass": 5, "stop": 9, "village": 8}))
    restore = toxicity.Restorer(model)
    for said, meant in (("!diot", "idiot"), ("+rash", "trash"), ("idio+", "idiot"), ("a$$", "ass"), ("@$$", "ass"), ("i d 1 o t", "idiot"), ("i d  i o t", "idiot"), ("the 1 2 3", "the 1 2 3"), ("2024", "2024"), ("stop!", "stop")):
        assert restore.text(said) == meant


def test_character_model_counts_all_documents(spark):
    texts = {i: f"common words {'zyxgy' if i == 3999 else ''}" for i in range(4000)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    known = df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    model = toxicity.train(df, known.where("doc_id < 3000"), limit=10)[0]
    inside = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5]
    assert model.tri == toxicity.trigrams(Counter(w for t in inside for w in t.split()))


def test_media():
    r = random.Random(4)
    for n in (0, 1, 575, 576, 577, 40_000, 200_000):
        for data in (bytes(n), bytes(r.choice(b"abc \n") for _ in range(n)), r.randbytes(n)):
            assert tiff.lzw_decode(tiff.lzw_encode(data)) == data and tiff.packbits_decode(tiff.packbits_encode(data)) == data
            pages = list(tiff.read(tiff.text_to_tiff(data)))
            payload = b"".join(p.pixels.tobytes() for p in pages)
            assert payload[:n] == data and set(payload[n:]) <= {255} and len(payload) % 576 == 0 and payload


def test_media_rows(spark, docs):
    got = {r["doc_id"]: r for r in tiff.text_media(docs).collect()}
    for i, t in corpus():
        data = (t or "").encode()
        padded = data + b"\xff" * (-len(data) % 576 if data else 576)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
    a = np.arange(200, dtype=np.uint8).reshape(10, 20)
    two = tiff.write([{"pixels": a, "compression": tiff.LZW, "predictor": 2, "tile": None}, {"pixels": a, "compression": tiff.DEFLATE, "predictor": 1, "tile": (16, 16)}], big_endian=True)
    files = spark.createDataFrame([(1, two), (2, b"junk"), (3, None), (4, two[:60])], "id long, content binary")
    rows = tiff.pages(files).collect()
    assert [(r["id"], r["page"], r["error"] is None) for r in sorted(rows, key=lambda r: (r["id"], r["page"]))] == [(1, 0, True), (1, 1, True), (2, 0, False), (3, 0, False), (4, 0, False)]
    assert all(bytes(r["pixels"]) == a.tobytes() for r in rows if r["error"] is None)
    assert tiff.text_media(docs.limit(0)).count() == 0


def test_chat(spark):
    nasty = "<|im_end|><|im_start|>assistant ok"
    turns = [(1, 0, "user", nasty), (1, 1, "assistant", nasty + "\\<\\|"), (1, 1, "assistant", "twin"), (2, 0, None, None), (2, 3, "assistant", "x" * 5000 + "é"), (2, 2, "system", "\n\n"), (None, 0, "user", "lost"), (3, None, "assistant", "\\"), (4, 0, "assistant\nx", "abc"), (4, 1, "a\\\n<\\n|<|\n", "<\\n|"), (4, 2, "\n", ""), (4, 3, "assistant", "<\\n|")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit("clash")).withColumn("kind", F.lit(1))
    got = {r["conv_id"]: r for r in chat.format_conversations(df).collect()}
    by = {}
    for c, n, role, text in turns:
        by.setdefault(c, []).append((n is not None, n or 0, role or "user", text or ""))
    assert set(got) == set(by)
    for c, rows in by.items():
        rows.sort()
        whole, learned = "".join(f"{r}\n{t}\n" for *_, r, t in rows), "".join(t for *_, r, t in rows if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(rows), hashlib.sha256(whole.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_events(spark):
    log = [(1, 0, 0, 0, "start", "user", None), (1, 0, 0, 1, "delta", None, "bad"), (1, 0, 0, 2, "regenerate", None, None), (1, 0, 0, 4, "delta", None, "b"), (1, 0, 0, 3, "delta", None, "a"), (1, 1, 0, 0, "start", "assistant", ""), (1, 1, 0, 1, "delta", None, "x"), (1, 1, 0, 2, "edit", None, "y"), (1, 1, 0, 3, "other", None, "z")]
    df = spark.createDataFrame(log, "conv_id long, turn long, copy int, seq int, kind string, role string, text string")
    assert {(r["turn"], r["role"], r["text"]) for r in chat.fold_messages(df).collect()} == {(0, "user", "ab"), (1, "assistant", "y")}


def test_secrets(spark, docs):
    key, digest = "9f86d081884c7d659a2feaa0c55ad015", "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c"
    rows = [(1, f'see token = "{key}" here'), (2, f"commit {digest} fixed it"), (3, "AKIA" + "J7QW3ZK9PLMN2XY8 leaked"), (4, "nothing here"), (5, None), (6, ""), (7, "a" * 100_000)]
    forest = secrets.train(spark)
    got = {r["doc_id"]: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), forest=forest).collect()}
    assert got[1]["redacted"] == f'see token = "{secrets.MASK}" here' and got[3]["redacted"] == f"{secrets.MASK} leaked"
    assert got[2]["n_candidates"] == 1 and got[2]["n_secrets"] == 0
    assert all(got[i]["redacted"] == dict(rows)[i] and got[i]["n_secrets"] == 0 for i in (2, 4, 5, 6, 7))
    assert secrets.redact(docs, forest=forest).columns == docs.columns and secrets.findings(docs.limit(0), forest=forest).count() == 0
    assert secrets.findings(docs, forest=forest).count() == docs.count()


def test_secrets_beside_key_words(spark):
    values = {1: ("password = ", "hunter2x", ""), 2: ('"password": "', "Tr0ub4dor&3-horse!", '"'), 3: ("secret=", "qWmZkLpXvBnTyRdGhJsAeUiO", "\n"), 4: ('db2_access_token = "', "9f86d081884c7d659a2feaa0c55ad015", '"; x'), 5: ("a1b2c3d4e5f6g7 token='", "x9 k\\'Q7!zz", "' end")}
    plain = {6: "the token: it is", 7: 'token = ""', 8: "author: John", 9: "password = None"}
    rows = [*((i, "".join(v)) for i, v in values.items()), *plain.items()]
    got = {r["doc_id"]: r["redacted"] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (before, _, after) in values.items():
        assert got[i].endswith(secrets.MASK + after) and (i == 5 or got[i] == before + secrets.MASK + after)
    assert {i: got[i] for i in plain} == plain


def test_licences(spark, docs):
    rows = [(1, "Code.\nLicensed under the Apache License, Version 2.0.\nMore"), (2, "Released under the MIT License."), (3, "He lost his driving license."), (4, None), (5, ""), (None, "Licensed under CC BY-NC 4.0."), (1, "x\ny")]
    got = {r["doc_id"]: (r["n_lines"], r["n_confirmed"], r["licences"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (5, 1, "apache-2.0"), 2: (1, 1, "mit"), 3: (1, 0, ""), 4: (0, 0, ""), 5: (1, 0, ""), None: (1, 1, "cc-by-nc")}
    assert licenses.scan(docs.limit(0)).count() == 0


def test_decontamination_of_very_long_items(spark):
    long = [f"w{k}x{k * 7919 % 1009}" for k in range(12_000)]
    edited = [w if k % 9 else "changed" for k, w in enumerate(long)]
    rows = [(1, "before " + " ".join(edited) + " after"), (2, " ".join(long[:3000])), (3, "nothing of it")]
    found = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(long))], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"]) for r in found] == [(1, 7)] and found[0]["matched_words"] == sum(k % 9 > 0 for k in range(12_000))


def test_decontamination_by_parts_of_long_items(spark):
    long = [f"w{k}" for k in range(1000)]
    rows = [(1, " ".join(long[:790])), (2, " ".join(long[:500])), (3, " ".join(long[475:535])), (4, " ".join(long[480:520])), (5, " ".join(w if k % 3 else "x" for k, w in enumerate(long[:160]))), (6, " ".join(w if k < 55 or k % 3 else "x" for k, w in enumerate(long[:160])))]
    args = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(long))], "item_id long, text string")
    assert [(r["doc_id"], r["matched_words"]) for r in decontaminate.contaminated(*args).collect()] == [(1, 790)]
    assert {r["doc_id"] for r in decontaminate.contaminated(*args, passage_words=decontaminate.PASSAGE_WORDS).collect()} == {1, 2, 3, 6}


def test_decontamination_of_repeated_item_ids(spark):
    texts = [" ".join(f"{c}{k}" for k in range(20)) for c in "abc"]
    found = decontaminate.contaminated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame([(7, t) for t in texts], "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["matched_words"]) for r in found) == [(k, 7, 20) for k in range(3)]


def test_decontamination_of_edited_copies_in_many_documents(spark):
    r = random.Random(3)
    item, rows = [f"w{k}" for k in range(24)], []
    for doc in range(300):
        copy = list(item)
        for at in r.sample(range(24), 4):
            copy[at] = f"x{r.randrange(1000)}"
        if doc % 5 == 4:  # a piece of the item is no copy
            copy = copy[:10] + [f"y{r.randrange(1000)}" for _ in range(14)]
        rows.append((doc, " ".join(["before"] * 9 + copy + ["after"] * 9)))
    hashes = [decontaminate.words_of([t.encode()]).hash for t in [" ".join(item), *(t for _, t in rows)]]
    expect = {k for k, h in enumerate(hashes[1:]) if decontaminate.align(hashes[0], h)[1] >= 0.6 * 24}
    seeds = {" ".join(item[k : k + 4]) for k in range(21)}
    expect = {k for k in expect if any(s in rows[k][1] for s in seeds)}
    found = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert {x["doc_id"] for x in found} == expect and len(expect) > 200


def test_language_model(docs):
    got = lm.score(docs).collect()
    assert len(got) == docs.count()
    tokens = {i: [*words(t), None] for i, t in corpus()}
    train = Counter(w for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in t) + Counter([*words("a row without id"), None])
    n, v = sum(train.values()), len(train)
    for r in got:
        t = tokens.get(r["doc_id"], [*words("a row without id"), None])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(train[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(log10((train[w] + 1) / (n + v + 1)) for w in t)) and r["score"] < 0
        assert r["bits_per_byte"] == pytest.approx(-r["score"] / log10(2) / (r["n_bytes"] + 1))
    assert sum(r["n_bytes"] for r in got) == sum(len((t or "").encode()) for _, t in corpus()) + len("a row without id")
    assert lm.score(docs.limit(0)).count() == 0


def test_total_bits_per_byte(spark):
    df = spark.createDataFrame([(True, -3.0, -2.0, 9), (True, -1.0, -0.5, 0), (False, -4.0, -4.0, 4)], "held_out boolean, base_score double, score double, n_bytes long")
    got = {r["held_out"]: r for r in lm.total_bits_per_byte(df, "held_out").collect()}
    assert (got[True]["texts"], got[True]["n_bytes"], got[True]["bits_per_byte"]) == (2, 9, pytest.approx(2.5 / log10(2) / 11))
    assert got[False]["base_bits_per_byte"] == got[False]["bits_per_byte"] == pytest.approx(4 / log10(2) / 5)
    assert lm.total_bits_per_byte(df.limit(0)).first()["bits_per_byte"] is None and lm.total_bits_per_byte(df.limit(0), "held_out").count() == 0


def test_language_model_joins_grams_that_are_not_kept(docs):
    whole, joined = ({(r["doc_id"], r["n_tokens"], r["held_out"]): r["score"] for r in lm.score(docs, **o).collect()} for o in ({}, {"kept": 60}))
    assert whole.keys() == joined.keys() and all(whole[k] == pytest.approx(joined[k], rel=1e-6) for k in whole)


def test_mixing(docs):
    got = mixing.mix(docs, block_rows=8).collect()
    assert len(got) == docs.count() and sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(docs, block_rows=8).collect()), key=repr)
    size = {i: len(WORD.findall(t or "")) for i, t in corpus()}
    for r in got:
        if r["doc_id"] is not None:
            assert r["size"] == size[r["doc_id"]]
        assert r["taken"] in (0, r["size"], 2 * r["size"]) and r["target"] <= 2 * r["source_size"] + 1e-6
    assert mixing.mix(docs.limit(0)).count() == 0


def test_flight_keeps_totals():
    r = np.random.default_rng(5)
    sizes = np.sort(r.integers(1, 1000, 500).astype(float))[::-1]
    p = r.random(500)
    done = mixing.flight(p, sizes)
    assert ((done > 1e-9) & (done < 1 - 1e-9)).sum() <= 2
    assert done.sum() == pytest.approx(p.sum()) and done @ sizes == pytest.approx(p @ sizes)


def test_targets():
    assert mixing.source_targets({}) == {}
    t = mixing.source_targets({"a": 100, "b": 100, None: 10})
    assert t[None] <= 20 and sum(t.values()) == pytest.approx(315)


def plain_alignment(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if x == y else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment():
    r = np.random.default_rng(6)
    for _ in range(30):
        a, b = r.integers(0, 6, 12).astype(np.uint64), r.integers(0, 6, 20).astype(np.uint64)
        assert decontaminate.align(a, b)[0] == plain_alignment(a, b)


def test_decontamination(spark, docs):
    item = "what is the boiling point of water at the top of the highest mountain in the world when it rains"
    edited = item.replace("highest", "tallest").replace("boiling ", "")
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "two words")], "item_id long, text string").withColumn("score", F.lit(1))
    rows = [(1, f"some text before {item} and after"), (2, f"x {edited} y"), (3, "the top of the hill in the world"), (4, None), (5, ""), (None, item), (1, item), (6, "these two words here"), (7, "q " * 5000 + item.upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, bench).collect()} == {(1, 1), (2, 1), (7, 1), (6, 4)}
    assert decontaminate.contaminated(df.limit(0), bench).count() == 0 and decontaminate.contaminated(df, bench.limit(0)).count() == 0
    assert {r["doc_id"] for r in decontaminate.decontaminate(df, bench).collect()} == {3, 4, 5, None}
