"""Each stage of the pipeline, on what the stage before kept, against a plain version."""

import math
import random

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import decontaminate as dc
from palimpsest.llm import mixing, quality, secrets
from tests.llm.test_classifiers import plain_quality

D = "/root/testdata/sf0.001"
SECRET = 'the db_password = "tR9x!kQ2zz" is set'


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """[(docs before, docs after)] of all stages; rows of null and of repeated ids, copies, leaks and secrets are put in."""
    d = tmp_path_factory.mktemp("pipeline")
    rows = [tuple(r) for r in spark.read.parquet(f"{D}/documents.parquet").collect()]
    items = [r["text"] for r in spark.read.parquet(f"{D}/benchmark.parquet").orderBy("item_id").collect()]
    r = random.Random(3)
    long = [x for x in rows if len(x[1].split()) > 150]
    more = []
    for k, (_, text, lang, source, _) in enumerate(long[:12]):
        words = text.split(" ")
        words[r.randrange(len(words))] = "changed"
        more.append((5000 + k, " ".join(words), lang, source, 0))
        more.append((6000 + k, text + " " + items[k], lang, source, 0))
        more.append((None if k % 2 else 7000, f"{text[: len(text) // 2]} {SECRET} {k}", lang, None, 0))
    schema = spark.read.parquet(f"{D}/documents.parquet").schema
    spark.createDataFrame(rows + more, schema).write.parquet(str(d / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{D}/{t}.parquet").write.parquet(str(d / f"{t}.parquet"))
    now, out = spark.read.parquet(str(d / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(d)).write.parquet(str(d / f"stage{k}"))
        after = spark.read.parquet(str(d / f"stage{k}"))
        out.append((now, after))
        now = after
    return out, d


def bag(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_columns_stay(stages):
    for before, after in stages[0][:-1]:
        assert after.columns == before.columns and 0 < after.count() <= before.count()


def test_quality(spark, stages):
    (before, after), d = stages[0][0], stages[1]
    weights, bias = quality.train(before, spark.read.parquet(str(d / "labels.parquet")))

    def kept(text):
        found, n = plain_quality((text or "").encode())
        return 1 / (1 + math.exp(-(bias + sum(quality.SCALE * c / max(1, n) * float(weights[i]) for i, c in found.items())))) >= quality.THRESHOLD

    assert bag(after) == sorted(repr(tuple(r)) for r in before.collect() if kept(r["text"]))


def test_near_duplicates(stages):
    before, after = stages[0][1]
    rows = before.collect()
    sets = []
    for r in rows:
        w = [x.lower() for x in (r["text"] or "").split()]
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    least = {r["doc_id"]: r["doc_id"] for r in rows}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for i, a in enumerate(rows):
        for j in range(i):
            if a["doc_id"] is None or rows[j]["doc_id"] is None or not sets[i] or not sets[j]:
                continue
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                p, q = root(a["doc_id"]), root(rows[j]["doc_id"])
                least[max(p, q)] = min(p, q)
    want = sorted(repr(tuple(r)) for r in rows if r["doc_id"] is None or root(r["doc_id"]) == r["doc_id"])
    assert bag(after) == want and len(want) < len(rows)


def test_decontamination(spark, stages):
    (before, after), d = stages[0][2], stages[1]
    items = [dc.words_of([r["text"].encode()]).hash for r in spark.read.parquet(str(d / "benchmark.parquet")).collect()]
    gone = set()
    for r in before.where("doc_id is not null").collect():
        h = dc.words_of([(r["text"] or "").encode()]).hash
        for a in items:
            _, matched, passage = dc.align_item(a, h)
            if dc.enough(matched, len(a), dc.COVERAGE, dc.LEAST_WORDS, passage, dc.PASSAGE_WORDS):
                gone.add(r["doc_id"])
    assert bag(after) == sorted(repr(tuple(r)) for r in before.collect() if r["doc_id"] not in gone) and gone


def test_secrets(spark, stages):
    before, after = stages[0][3]
    rows, looked = before.collect(), []
    for k, r in enumerate(rows):
        text = r["text"] or ""
        pattern = secrets.CANDIDATE if regex.search(secrets.KEYED, text) else secrets.LONG
        at = [m.span() for m in regex.finditer(pattern, text)]
        for n, (a, b) in enumerate(at):
            end = at[n + 1][0] if n + 1 < len(at) else len(text)
            looked.append((k, a, b, text[max(0, a - secrets.BESIDE) : a], text[a:b], text[b:end]))
    found = spark.createDataFrame(looked, "k int, a int, b int, before string, c string, after string")
    model = secrets.fit(spark)
    scored = found.withColumn("f", F.struct(*(x.cast("double").alias(n) for n, x in zip(secrets.FEATURES, secrets.features(F.col("c"), F.col("before"), F.col("after")), strict=True))))
    said = [(x["k"], x["a"], x["b"]) for x in scored.where(F.expr(secrets.as_sql(model)) >= secrets.THRESHOLD).collect()]
    texts = [r["text"] for r in rows]
    for k, a, b in sorted(said, reverse=True):
        texts[k] = texts[k][:a] + secrets.MASK + texts[k][b:]
    want = sorted(repr((r["doc_id"], t, r["lang"], r["source"], len(t) if t != r["text"] else r["n_chars"])) for r, t in zip(rows, texts, strict=True))
    assert bag(after) == want
    assert sum(secrets.MASK in (t or "") and "db_password" in t for t in texts) >= 3 and not any("tR9x!kQ2zz" in (t or "") for t in texts)


def test_mixing(stages):
    before, after = stages[0][4]
    rows, got = before.collect(), after.collect()
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(mixing_words(r["text"]))
    targets, taken = mixing.source_targets(sizes), dict.fromkeys(sizes, 0)
    pool = [tuple(r) for r in rows]
    for r in got:
        pool.remove(tuple(r)[:5])  # each row is one of those before, and comes once
        assert r["size"] == len(mixing_words(r["text"])) and r["copies"] in (1, 2) and r["taken"] == r["size"] * r["copies"]
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]])
        taken[r["source"]] += r["taken"]
    for s, n in sizes.items():
        smallest = min((len(mixing_words(r["text"])) for r in rows if r["source"] == s and mixing_words(r["text"])), default=0)
        assert abs(taken[s] - targets[s]) <= max(0.5 * smallest + 1, 0.02 * targets[s], 2)


def mixing_words(text):
    return regex.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_run_applies_the_stages(spark, stages):
    out, d = stages
    assert sorted((r["doc_id"] or -1, r["taken"]) for r in corpus_pipeline.run(spark, str(d)).collect()) == sorted((r["doc_id"] or -1, r["taken"]) for r in out[-1][1].collect())
    assert np.all([r["copies"] > 0 for r in out[-1][1].collect()])


#: Names that stages use for columns of their own, and names of columns that operators add.
NAMES = ("_quality", "quality_score", "toxic_score", "_gone", "item_id", "redacted", "n_secrets", "size", "taken", "copies", "kept", "component_id", "_rc")


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_on_odd_rows(spark, stages, k):
    """Null and empty texts, a very long one, repeated rows, null ids and columns of clashing names; then an empty table."""
    long = " ".join(f"word{n % 5003} of{n % 89}" for n in range(60_000))
    texts = [None, "", " \n", long, long, "one two", "one two", "a short line of plain words that says little"]
    schema = stages[0][0][0].schema
    df = spark.createDataFrame([(n % 6 if n else None, t, "en", None if n == 2 else "s", len(t or "")) for n, t in enumerate(texts)], schema)
    for name in NAMES:
        df = df.withColumn(name, F.lit("clash"))
    name, stage = corpus_pipeline.STAGES[k]
    got = stage(spark, df, str(stages[1])).collect()
    before = {(r["doc_id"], r["text"]) for r in df.collect()}
    assert {(r["doc_id"], r["text"]) for r in got} <= before and len(got) <= len(texts)
    if k < len(corpus_pipeline.STAGES) - 1:
        assert stage(spark, df, str(stages[1])).columns == df.columns
        assert all(r[c] == "clash" for r in got for c in NAMES)
    if name == "near-duplicates":
        assert sorted(r["doc_id"] for r in got if r["text"] == long) == [3]
    if name in ("secret scan", "decontamination"):
        assert len(got) == len(texts)
    assert stage(spark, df.limit(0), str(stages[1])).count() == 0
