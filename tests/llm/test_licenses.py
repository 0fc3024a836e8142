"""Licence scans against a plain version over the same weights."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import licenses as li


def plain_scan(text, model):
    """(paragraphs with words, accepted passages) of a text: every passage is scored, none is left out before."""
    weights, bias, heat = model
    pairs, out, paragraphs = li.template_pairs(), [], 0
    for block in re.split(r"(?:\r?\n[ \t]*){2,}", text):
        lines = [w for w in (li.words_of(x) for x in re.split(r"\r?\n", block)) if w]
        paragraphs += bool(lines)
        found = []
        for i in range(len(lines)):
            for n in range(1, min(li.WINDOW, len(lines) - i) + 1):
                words = [w for x in lines[i : i + n] for w in x]
                own, of = li.features_of(words), li.pairs_of(words)
                z = (sum((np.asarray(weights.get(f, 0.0 * bias), np.float64) for f in own), 0.0 * bias) / np.sqrt(len(own)) + bias) / heat
                p = np.exp(z - z.max())
                p /= p.sum()
                k = int(p[:-1].argmax())
                like = sum(pairs.get(x, [0] * len(p))[k] for x in of) / max(1, len(of))
                if p[k] >= li.THRESHOLD and p[k] > p[-1] and like >= li.SIMILARITY:
                    found.append((i, -int(like * 10 + 1e-9), -n, li.FAMILIES[k], round(float(p[k]), 5), round(like, 5)))
        until = -1
        for x in sorted(found):
            if x[0] >= until:
                out.append(x)
                until = x[0] - x[2]
    return paragraphs, out


@pytest.fixture(scope="module")
def model():
    weights, bias, heat = li.train()
    return weights, np.asarray(bias, np.float64), heat


NOTICE = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
"""
MIT = """Permission is hereby granted, free of charge,
to any person obtaining a copy
of this software and associated
documentation files"""


def test_against_plain_version(spark, model):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(10_000, NOTICE + "\n\nx = 1\n"), (10_001, f"tool\n{MIT}\nmore text here"), (10_002, "Released under the MIT License.\nLicensed under the Apache License, Version 2.0."), (10_003, "of the\nthe\nlicense"), (10_004, "a\r\n \r\nLicensed under CC BY 4.0.\r\n\r\n***\r\n")]
    got = {r["doc_id"]: r for r in li.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    some = 0
    for i, text in rows:
        paragraphs, found = plain_scan(text or "", model)
        r = got[i]
        assert (r["n_paragraphs"], r["n_confirmed"], r["licences"]) == (paragraphs, len(found), ",".join(sorted({x[3] for x in found})))
        if found:
            some += 1
            assert r["probability"] == pytest.approx(max(x[4] for x in found), abs=1e-4) and r["similarity"] == pytest.approx(max(x[5] for x in found), abs=1e-4)
    assert some >= 6
    assert got[10_000]["licences"] == "gpl-3.0" and got[10_001]["licences"] == "mit" and got[10_002]["n_confirmed"] == 2 and got[10_002]["licences"] == "apache-2.0,mit" and got[10_003]["n_confirmed"] == 0 and got[10_004]["licences"] == "cc-by"


def test_notices_without_the_usual_words(spark):
    rows = [(1, "with or without modification, are permitted provided that the following conditions are met"), (2, "you may not use this file except in compliance with"), (3, "this source code form is subject to the terms of")]
    got = {r["doc_id"]: r["licences"] for r in li.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "bsd", 2: "apache-2.0", 3: "mpl-2.0"}


def test_other_licences_are_unknown(spark):
    rows = list(enumerate(["Licensed under the Eclipse Public License 2.0", "GNU Affero General Public License version 3", "licensed under the sleepycat license", "Released under the Ruby License", "Licensed under CC BY-SA 4.0.", "He lost his driving license.", "Distributed under the terms of the QPL"]))
    assert all(r["licences"] == "" for r in li.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_templates_that_training_did_not_see(model):
    """Few variants of templates that were left out of training are taken for another family."""
    data, heat = li.examples(), model[2]
    held = [d for d in data if d[2] % li.TURNS == 1]
    place, w, b = li._fit([d for d in data if d[2] % li.TURNS != 1], 200)
    x, y = li._matrix(held, place)
    p = li._softmax((x @ w + b) / heat)
    best = p[:, :-1].argmax(axis=1)
    taken = (p[np.arange(len(y)), best] >= li.THRESHOLD) & (p[np.arange(len(y)), best] > p[:, -1])
    assert (taken & (best != y)).mean() < 0.15


def test_one_common_line_in_many_documents(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string"), F.lit("\nReleased under the MIT License.")).alias("text"))
    got = li.scan(df).groupBy("licences", "n_confirmed").count().collect()
    assert [tuple(r) for r in got] == [("mit", 1, 3000)]


def test_long_paragraphs_walked_in_chunks(spark, model, monkeypatch):
    """Passages that reach from chunk to chunk are chosen as by one walk through the whole paragraph."""
    monkeypatch.setattr(li, "CHUNK", 8)
    r = random.Random(9)
    parts = [NOTICE.strip(), MIT, "Released under the MIT License.", "nothing to see", "Licensed under the Apache License,\nVersion 2.0.", "Released under the\nMIT License."]
    rows = [(k if k else None, "\n".join(r.choice(parts) for _ in range(r.randrange(1, 40)))) for k in range(12)]
    got = {}
    for x in li.confirmed(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(x["doc_id"], []).append((x["line"], x["lines"], x["family"]))
    for k, text in rows:
        assert sorted(got.get(k, [])) == [(x[0], -x[2], x[3]) for x in plain_scan(text, model)[1]], k


def test_a_paragraph_of_many_notices(spark):
    text = "Released under the MIT License.\n" * 20_000
    r = li.scan(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(x["n_confirmed"] > 0, x["licences"]) for x in r] == [(True, "mit"), (False, ""), (False, "")] and r[0]["n_confirmed"] <= 20_000
