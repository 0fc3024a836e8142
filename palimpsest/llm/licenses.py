"""Licence scans: a trained classifier of paragraphs, in DataFrame operations only.

Paragraphs are parted by blank lines. As a notice may be wrapped over lines, or
stand among other lines of its paragraph, passages are classified: each line of a
paragraph with up to WINDOW - 1 lines that follow it. Words and pairs of words are
features of a softmax regression over licence families and a class for anything
else; a passage is unknown if that class is likelier than each family, or if the best
family has a calibrated probability of less than THRESHOLD. A prediction counts if enough of the passage's pairs of words
stand in the family's templates. Of confirmed passages that overlap, the first
stays, and of those that begin at a line the one most like the templates.

Every word of every text is looked at. A passage goes to the classifier if enough
of its pairs stand in templates of any family; all others have too little
similarity with each family, so that no prediction for them could be confirmed.

Training examples are made from the templates: whole ones, parts, ones with
words left out or put in; the class for anything else has prose about other
matters and notices of licences outside the families. The temperature that
calibrates probabilities is fitted on examples of templates that were left out of
training, by turns. Weights are a table of a few thousand rows at most, whatever
the input; it is broadcast.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.plans.skew import join_counted

from .shared import stored

# Notices that name a licence, by family.
TEMPLATES = {
    "apache-2.0": ("licensed under the apache license, version 2.0.", "you may not use this file except in compliance with the license. you may obtain a copy of the license at http://www.apache.org/licenses/license-2.0", "released under the apache license 2.0", "spdx-license-identifier: apache-2.0"),
    "mit": ("released under the mit license.", "licensed under the mit license.", "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "spdx-license-identifier: mit", "this project is available under the terms of the mit license"),
    "gpl-3.0": ("this work is licensed under the gnu general public license, version 3.", "this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, either version 3 of the license", "spdx-license-identifier: gpl-3.0-only", "licensed under the gpl v3"),
    "gpl-2.0": ("licensed under the gnu general public license, version 2.", "this program is free software; you can redistribute it and/or modify it under the terms of the gnu general public license version 2", "spdx-license-identifier: gpl-2.0-only"),
    "lgpl": ("licensed under the gnu lesser general public license", "this library is free software; you can redistribute it and/or modify it under the terms of the gnu lesser general public license", "spdx-license-identifier: lgpl-2.1-only"),
    "bsd": ("redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "released under the bsd 3-clause license", "licensed under the bsd license", "spdx-license-identifier: bsd-3-clause"),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license, v. 2.0.", "licensed under the mozilla public license 2.0", "spdx-license-identifier: mpl-2.0"),
    "cc-by": ("licensed under cc by 4.0.", "this work is licensed under a creative commons attribution 4.0 international license", "spdx-license-identifier: cc-by-4.0"),
    "cc-by-nc": ("licensed under cc by-nc 4.0.", "this work is licensed under a creative commons attribution-noncommercial 4.0 international license", "spdx-license-identifier: cc-by-nc-4.0"),
    "unlicense": ("this is free and unencumbered software released into the public domain", "spdx-license-identifier: unlicense"),
}
OTHER = ("all rights reserved", "he lost his driving license in the accident", "a license fee applies to every copy sold", "the software requires a valid license key", "copyright by the author", "permission was refused by the council", "the warranty covers parts and labour for a year", "license plates are issued by the state", "released under a pseudonym last year", "licensed under a private agreement with the publisher", "the public domain of knowledge is open to everyone", "under the terms of the contract version 2", "fishing license number four", "see the license terms of the vendor", "commercial license available on request", "they are a licensed trader under the law of the city")
# Notices of licences that are none of the families.
OTHER_LICENCES = ("licensed under the eclipse public license 2.0", "spdx-license-identifier: epl-2.0", "gnu affero general public license version 3", "licensed under the gnu affero general public license, version 3.", "spdx-license-identifier: agpl-3.0-only", "licensed under the european union public licence 1.2", "spdx-license-identifier: eupl-1.2", "released under the artistic license 2.0", "released under the isc license", "distributed under the boost software license, version 1.0", "licensed under the zlib license", "licensed under the microsoft public license", "released under the common development and distribution license 1.0", "this work is licensed under a creative commons attribution-sharealike 4.0 international license", "licensed under cc by-sa 4.0", "licensed under cc by-nd 4.0", "licensed under the open database license 1.0", "released under the postgresql license", "licensed under the python software foundation license version 2", "licensed under the gnu free documentation license, version 1.3", "dedicated to the public domain under cc0 1.0 universal", "all rights reserved by the copyright holders of this software", "licensed under a proprietary license of the company")
FAMILIES = tuple(TEMPLATES)
THRESHOLD, SIMILARITY = 0.3, 0.7
#: Lines that a passage has at most, and groups of templates that are left out by turns to calibrate.
WINDOW, TURNS = 8, 4
SEED, EXAMPLES = 5, 40
BLANK = r"(?:\r?\n[ \t]*+){2,}"
TOKEN = r"[a-z0-9]+(?:[.\-+][a-z0-9]+)*"


def words_of(line: str) -> list[str]:
    return re.findall(TOKEN, line.lower())


def features_of(words: list[str]) -> list[str]:
    """Distinct words and pairs of words."""
    return sorted({*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))})


def pairs_of(words: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def examples(seed: int = SEED, each: int = EXAMPLES) -> list[tuple[list[str], int, int]]:
    """(words, class, template); the class after the families is for anything else."""
    r, out, template = random.Random(seed), [], 0
    classes = (*TEMPLATES.values(), (*OTHER, *OTHER_LICENCES))
    pool = sorted({w for texts in classes for t in texts for w in words_of(t)})
    for k, texts in enumerate(classes):
        for t in texts:
            words = words_of(t)
            out.append((words, k, template))
            for _ in range(each // len(texts) + 2):
                a = r.randrange(0, max(1, len(words) // 4 + 1))
                part = [w for w in words[a : len(words) - r.randrange(0, max(1, len(words) // 5 + 1))] if r.random() > 0.05]
                for _ in range(r.randrange(3)):
                    part.insert(r.randrange(len(part) + 1), r.choice(pool))
                out.append((part if k < len(TEMPLATES) else words + [r.choice(pool)] * r.randrange(2), k, template))
            template += 1
    for _ in range(3 * each):
        out.append(([r.choice(pool) for _ in range(r.randrange(3, 15))], len(TEMPLATES), template))
        template += 1
    return out


def _fit(data: list[tuple[list[str], int, int]], rounds: int) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    names = sorted({f for w, *_ in data for f in features_of(w)})
    place = {f: i for i, f in enumerate(names)}
    x, y = _matrix(data, place)
    w, b = np.zeros((len(names), len(FAMILIES) + 1), np.float32), np.zeros(len(FAMILIES) + 1, np.float32)
    for _ in range(rounds):
        p = _softmax(x @ w + b)
        p[np.arange(len(y)), y] -= 1
        w -= np.float32(8) * (x.T @ p / np.float32(len(y)) + np.float32(2e-5) * w)
        b -= p.mean(axis=0)
    return place, w, b


def _matrix(data: list[tuple[list[str], int, int]], place: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((len(data), len(place)), np.float32)
    for i, (w, *_) in enumerate(data):
        own = features_of(w)
        for f in own:
            if f in place:
                x[i, place[f]] = 1 / np.sqrt(len(own))
    return x, np.array([k for _, k, _ in data])


@lru_cache(maxsize=4)
def train(seed: int = SEED, rounds: int = 200) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
    """(weights of features by class, biases, temperature)."""
    data = examples(seed)
    z, y = [], []
    for turn in range(TURNS):
        held = [d for d in data if d[2] % TURNS == turn]
        place, w, b = _fit([d for d in data if d[2] % TURNS != turn], rounds)
        x, k = _matrix(held, place)
        z.append(x @ w + b)
        y.append(k)
    z, y = np.concatenate(z), np.concatenate(y)
    heat = min((0.5 + 0.1 * k for k in range(40)), key=lambda t: -np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean())
    place, w, b = _fit(data, rounds)
    return {f: w[i] for f, i in place.items()}, b, float(heat)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def template_pairs() -> dict[str, list[bool]]:
    """Pairs of words (or a template's only word) and which families' templates have them."""
    out: dict[str, list[bool]] = {}
    for k, texts in enumerate(TEMPLATES.values()):
        for t in texts:
            w = words_of(t)
            for a, b in zip(w, w[1:], strict=False):
                out.setdefault(f"{a} {b}", [False] * len(FAMILIES))[k] = True
    return out


def model_table(spark: SparkSession) -> tuple[DataFrame, np.ndarray, float]:
    """(feature, w0.., t0..): weights by class and whether a family's template has the pair."""
    weights, bias, heat = train()
    pairs = template_pairs()
    none_w, none_t = np.zeros(len(FAMILIES) + 1), [False] * len(FAMILIES)
    rows = [(f, *map(float, weights.get(f, none_w)), *map(int, pairs.get(f, none_t))) for f in sorted({*weights, *pairs})]
    schema = ", ".join(["feature string", *(f"w{k} double" for k in range(len(FAMILIES) + 1)), *(f"t{k} int" for k in range(len(FAMILIES)))])
    return spark.createDataFrame(rows, schema), bias, heat


def _pairs(words: Column) -> Column:
    return F.when(F.size(words) > 1, F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))


def _held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row, however often functions over arrays ask for it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def passages(docs: DataFrame) -> DataFrame:
    """(doc_id, row, block, line, lines, said) of each passage of (doc_id, text) that may be like a template: lines of a
    paragraph from its first line with words, as words joined by blanks."""
    known = sorted(template_pairs())
    blocks = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.posexplode(F.split("text", BLANK)).alias("block", "said"))
    by_line = F.filter(F.transform(F.split(F.lower("said"), r"\r?\n"), lambda line: F.regexp_extract_all(line, F.lit(TOKEN), F.lit(0))), lambda w: F.size(w) > 0)
    worded = _held(blocks, "words", by_line).drop("said").where(F.size("words") > 0)

    def mark(i: Column) -> Column:
        own, after = F.get("words", i), F.get("words", i + 1)
        pairs = _pairs(own)
        over = F.concat(F.get(own, F.size(own) - 1), F.lit(" "), F.get(after, F.lit(0)))
        return F.struct(F.size(pairs).alias("pairs"), F.size(F.filter(pairs, lambda p: p.isin(known))).alias("hits"), over.isin(known).alias("over"))

    marked = _held(worded, "marks", F.transform(F.sequence(F.lit(0), F.size("words") - 1), mark)).where(F.exists("marks", lambda m: (m["hits"] > 0) | F.coalesce(m["over"], F.lit(False))))
    added = lambda part, value: F.aggregate(part, F.lit(0), lambda s, m: s + value(m))

    def window(i: Column, n: Column) -> Column:
        own, inner = F.slice("marks", i + 1, n), F.slice("marks", i + 1, n - 1)
        return F.struct(i.alias("line"), n.alias("lines"), (added(own, lambda m: m["pairs"]) + n - 1).alias("pairs"), (added(own, lambda m: m["hits"]) + added(inner, lambda m: m["over"].cast("int"))).alias("hits"))

    every = F.flatten(F.transform(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(WINDOW), F.size("words") - i)), lambda n: window(i, n))))
    like = F.filter(every, lambda w: (w["pairs"] > 0) & (w["hits"] >= w["pairs"] * SIMILARITY))
    found = marked.select("doc_id", "row", "block", "words", F.explode(like).alias("w"))
    return found.select("doc_id", "row", "block", "w.line", "w.lines", F.array_join(F.flatten(F.slice("words", F.col("w.line") + 1, F.col("w.lines"))), " ").alias("said"))


def judged(said: DataFrame) -> DataFrame:
    """(said, family, probability, similarity, confirmed) of passages (said: words joined by blanks), each once."""
    table, bias, heat = model_table(said.sparkSession)
    words = _held(said.select("said"), "words", F.split("said", " "))
    pairs = _pairs(F.col("words"))
    each = F.array_distinct(F.concat("words", pairs))
    # features count once each, pairs are compared as often as they occur
    both = F.concat(F.transform(each, lambda f: F.struct(f.alias("feature"), F.lit(1).alias("is"), F.lit(0).alias("of"))), F.transform(pairs, lambda f: F.struct(f.alias("feature"), F.lit(0).alias("is"), F.lit(1).alias("of"))))
    hits = words.select("said", F.size(pairs).alias("pairs"), F.size(each).alias("n"), F.explode(both).alias("x")).select("said", "pairs", "n", "x.*").join(F.broadcast(table), "feature", "left")
    k = len(FAMILIES)
    sums = hits.groupBy("said", "pairs", "n").agg(*(F.coalesce(F.sum(F.col("is") * F.col(f"w{i}")), F.lit(0.0)).alias(f"w{i}") for i in range(k + 1)), *(F.coalesce(F.sum(F.col("of") * F.col(f"t{i}")), F.lit(0)).alias(f"t{i}") for i in range(k)))
    z = F.array(*((F.col(f"w{i}") / F.sqrt("n") + float(bias[i])) / heat for i in range(k + 1)))
    share = F.array(*(F.col(f"t{i}") / F.greatest(F.col("pairs"), F.lit(1)) for i in range(k)))
    out = sums.select("said", z.alias("z"), share.alias("share"))
    out = out.select("said", "share", F.transform("z", lambda x: F.exp(x - F.array_max("z"))).alias("e"))
    out = out.select("said", "share", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda s, y: s + y)).alias("p"))
    out = out.select("said", "share", F.element_at("p", k + 1).alias("other"), F.slice("p", 1, k).alias("p")).withColumn("at", F.array_position("p", F.array_max("p")).cast("int"))
    families = F.array(*map(F.lit, FAMILIES))
    out = out.select("said", "other", F.element_at("p", F.col("at")).alias("probability"), F.element_at(families, F.col("at")).alias("family"), F.element_at("share", F.col("at")).alias("similarity"))
    sure = (F.col("probability") >= THRESHOLD) & (F.col("probability") > F.col("other"))
    return out.select("said", F.when(sure, F.col("family")).alias("family"), "probability", "similarity", (sure & (F.col("similarity") >= SIMILARITY)).alias("confirmed"))


#: Lines of a paragraph that one task walks.
CHUNK = 256


def _first_of(found: DataFrame) -> DataFrame:
    """Rows of found (doc_id, row, block, line, lines, ...), stored ones, that no earlier one kept of their paragraph overlaps;
    of those that begin at a line, the one most like the templates. A chunk of lines is walked once for each number of
    lines by which a passage may reach into it, then the chunks of a paragraph are joined end to end, then each is walked from where
    it truly begins: no step holds more than a chunk's passages."""
    keys, entry = ["row", "block", "chunk"], F.struct("line", (-F.floor(F.col("similarity") * 10)).alias("unlike"), (-F.col("lines")).alias("short"), "lines", "doc_id", "family", "probability", "similarity")
    chunks = found.groupBy("row", "block", F.floor(F.col("line") / CHUNK).alias("chunk")).agg(F.sort_array(F.collect_list(entry)).alias("w"))
    end = lambda s, x: F.when(x["line"] >= s, x["line"] + x["lines"]).otherwise(s)
    reach = lambda c: F.greatest(F.lit(0), F.aggregate("w", (F.col("chunk") * CHUNK + c).cast("int"), end) - (F.col("chunk").cast("int") + 1) * CHUNK)
    held = stored(chunks.withColumn("ends", F.array(*(reach(F.lit(c)) for c in range(WINDOW)))), "licence-chunks")
    steps = held.groupBy("row", "block").agg(F.sort_array(F.collect_list(F.struct("chunk", "ends"))).alias("c"))
    joined = "aggregate(c, struct(-1L as chunk, 0 as over, cast(array() as array<struct<chunk:bigint,over:int>>) as out), (s, x) -> struct(x.chunk as chunk, get(x.ends, if(x.chunk = s.chunk + 1, s.over, 0)) as over, array_append(s.out, struct(x.chunk as chunk, if(x.chunk = s.chunk + 1, s.over, 0) as over)) as out), s -> s.out)"
    begins = steps.select("row", "block", F.explode(F.expr(joined)).alias("x")).select("row", "block", "x.chunk", "x.over")
    walk = "aggregate(w, struct(cast(chunk * {0} + over as int) as until, cast(array() as {1}) as out), (s, x) -> if(x.line >= s.until, struct(x.line + x.lines as until, array_append(s.out, x) as out), s), s -> s.out)"
    kept = held.join(begins, keys).select(F.explode(F.expr(walk.format(CHUNK, held.schema["w"].dataType.simpleString()))).alias("x"))
    return kept.select("x.doc_id", "x.line", "x.lines", "x.family", "x.probability", "x.similarity")


def confirmed(docs: DataFrame) -> DataFrame:
    """(doc_id, line, lines, family, probability, similarity) of each confirmed passage of (doc_id, text) that no earlier
    one of its paragraph overlaps; line counts the paragraph's lines with words from 0. A passage that many documents have is
    judged once, and goes back to them by a join that leaves its rows where they are."""
    found = stored(passages(docs), "licence-passages")
    times = found.groupBy("said").agg(F.count("*").alias("times"))
    known = stored(judged(times).where("confirmed").join(times, "said"), "licence-judged")
    return _first_of(join_counted(found, known, ["said"], "times", found.count()))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_paragraphs, n_confirmed, licences, probability, similarity), one row per distinct doc_id, null
    among them: paragraphs with words, confirmed passages, their families in order joined by commas, and their highest
    figures. Null texts have no lines; rows of a repeated id count together. An empty table gives none."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    paragraphs = F.size(F.filter(F.split("text", BLANK), lambda b: b.rlike("(?i)[a-z0-9]")))
    counted = plain.groupBy("doc_id").agg(F.sum(F.coalesce(F.regexp_count("text", F.lit("\n")) + 1, F.lit(0))).cast("long").alias("n_lines"), F.sum(F.when(F.col("text").isNull(), 0).otherwise(paragraphs)).cast("long").alias("n_paragraphs"))
    found = confirmed(plain).groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("n_confirmed"), F.array_join(F.sort_array(F.collect_set("family")), ",").alias("licences"), F.max(F.round("probability", 6)).alias("probability"), F.max(F.round("similarity", 6)).alias("similarity"))
    joined = counted.join(found, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return joined.select("doc_id", "n_lines", "n_paragraphs", F.coalesce("n_confirmed", F.lit(0)).cast("long").alias("n_confirmed"), F.coalesce("licences", F.lit("")).alias("licences"), "probability", "similarity")


def oracle_sql() -> str:
    """DuckDB SQL for the rows of scan(documents), whose ids are distinct, over the same weights: every passage is compared
    and none is left out before."""
    weights, bias, heat = train()
    pairs, k = template_pairs(), len(FAMILIES)
    none_w, none_t = np.zeros(k + 1), [False] * k
    rows = ", ".join("(" + ", ".join([f"'{f}'", *(repr(float(x)) for x in weights.get(f, none_w)), *(str(int(x)) for x in pairs.get(f, none_t))]) + ")" for f in sorted({*weights, *pairs}))
    names = ", ".join(["feature", *(f"w{i}" for i in range(k + 1)), *(f"t{i}" for i in range(k))])
    logits = ", ".join(f"(coalesce(sum(w{i}) FILTER (WHERE NOT pair_only), 0) / sqrt(any_value(n_features)) + {float(bias[i])!r}) / {heat!r}" for i in range(k + 1))
    shares = ", ".join(f"coalesce(sum(t{i} * times), 0) / greatest(any_value(n_pairs), 1)" for i in range(k))
    families = ", ".join(f"'{f}'" for f in FAMILIES)
    parts = "string_split_regex(text, '(?:\\r?\\n[ \\t]*){2,}')".replace("\\\\", "\\")
    return f"""WITH RECURSIVE model({names}) AS (VALUES {rows}),
        b AS (SELECT doc_id, unnest({parts}) AS said, generate_subscripts({parts}, 1) AS block FROM documents),
        l AS (SELECT doc_id, block, list_filter(list_transform(string_split_regex(lower(said), '\\r?\\n'), lambda x: regexp_extract_all(x, '{TOKEN}')), lambda x: len(x) > 0) AS lines FROM b),
        i AS (SELECT *, unnest(range(1, len(lines) + 1)) AS line FROM l WHERE len(lines) > 0),
        w AS (SELECT doc_id, block, line, n, flatten(lines[line : line + n - 1]) AS words FROM (SELECT *, unnest(range(1, least({WINDOW}, len(lines) - line + 1) + 1)) AS n FROM i)),
        p AS (SELECT *, list_transform(range(1, len(words)), lambda j: words[j] || ' ' || words[j + 1]) AS pairs FROM w),
        known AS (SELECT feature AS pair FROM model WHERE {" + ".join(f"t{i}" for i in range(k))} > 0),
        c AS (SELECT doc_id, block, line, n, array_to_string(any_value(words), ' ') AS said FROM (SELECT doc_id, block, line, n, words, unnest(pairs) AS pair FROM p) LEFT JOIN known k USING (pair)
            GROUP BY doc_id, block, line, n HAVING count(k.pair) >= {SIMILARITY} * count(*)),
        s AS (SELECT said, string_split(said, ' ') AS words FROM (SELECT DISTINCT said FROM c)),
        f AS (SELECT said, len(pairs) AS n_pairs, len(list_distinct(list_concat(words, pairs))) AS n_features, list_distinct(list_concat(words, pairs)) AS features, pairs FROM (SELECT *, list_transform(range(1, len(words)), lambda j: words[j] || ' ' || words[j + 1]) AS pairs FROM s)),
        x AS (SELECT said, n_pairs, n_features, unnest(features) AS feature, false AS pair_only, 0 AS times FROM f UNION ALL SELECT said, n_pairs, n_features, unnest(pairs), true, 1 FROM f),
        z AS (SELECT said, [{logits}] AS z, [{shares}] AS share FROM x LEFT JOIN model USING (feature) GROUP BY said),
        e AS (SELECT said, share, list_transform(z, lambda v: exp(v - list_max(z))) AS e FROM z),
        q AS (SELECT said, share, list_transform(e, lambda v: v / list_sum(e)) AS q FROM e),
        j AS (SELECT said, share, q[{k + 1}] AS other, list_position(q[1:{k}], list_max(q[1:{k}])) AS top, list_max(q[1:{k}]) AS probability FROM q),
        y AS (SELECT c.doc_id, c.block, c.line, c.n, list_extract([{families}], top) AS family, probability, share[top] AS similarity FROM j JOIN c USING (said) WHERE probability >= {THRESHOLD} AND probability > other AND share[top] >= {SIMILARITY}),
        best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, block, line ORDER BY -floor(similarity * 10), -n) AS place FROM y) WHERE place = 1),
        after AS (SELECT a.doc_id, a.block, a.line, min(b.line) AS next FROM best a LEFT JOIN best b ON a.doc_id = b.doc_id AND a.block = b.block AND b.line >= a.line + a.n GROUP BY a.doc_id, a.block, a.line),
        kept AS (SELECT doc_id, block, min(line) AS line FROM best GROUP BY doc_id, block UNION ALL SELECT k.doc_id, k.block, a.next FROM kept k JOIN after a ON a.doc_id = k.doc_id AND a.block = k.block AND a.line = k.line WHERE a.next IS NOT NULL),
        found AS (SELECT doc_id, count(*) AS n_confirmed, array_to_string(list_sort(list_distinct(list(family))), ',') AS licences, max(round(probability, 6)) AS probability, max(round(similarity, 6)) AS similarity FROM best JOIN kept USING (doc_id, block, line) GROUP BY doc_id),
        counted AS (SELECT doc_id, count(*) FILTER (WHERE len(lines) > 0) AS n_paragraphs FROM l GROUP BY doc_id)
        SELECT d.doc_id, CAST(coalesce(length(text) - length(replace(text, chr(10), '')) + 1, 0) AS BIGINT) AS n_lines, coalesce(n_paragraphs, 0) AS n_paragraphs, coalesce(n_confirmed, 0) AS n_confirmed, coalesce(licences, '') AS licences, probability, similarity
        FROM documents d LEFT JOIN counted USING (doc_id) LEFT JOIN found USING (doc_id)"""
