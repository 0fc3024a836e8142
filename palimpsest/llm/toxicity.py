"""Toxicity: noisy-channel deobfuscation, then a classifier on the restored text.

Words that writers may have disguised (marks or digits among letters, letters
repeated three times or more, letters with spaces between them) become lattices
of characters: a mark stands for itself, for the letters it resembles or for
nothing, a run of a letter for one or two of it. Viterbi decoding picks the path
that is likeliest under a character trigram model of the training texts and the
channel's costs. Other words stand as they are.

Features of the restored text are whole words and the first four and five bytes
of words, each present or not; the model is a hashed logistic regression trained
with follow-the-regularised-leader updates.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import fitted, sigmoid
from .quality import sample_of_labels
from .shared import prepare
from .textkernel import blocks, mix, words_of

# Letters that a mark or digit may stand for.
LOOKS_LIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c"}
#: Marks that may stand between letters and mean nothing.
FILLERS = ".-_*~'`^,:;/\\#%&"
SIZE_BITS = 18
TRAIN_ROWS = 20_000
#: Chosen by a split of the training fold alone.
RATE, SPARSITY = 0.6, 3.0
#: Distinct words that a task counts before it passes their trigrams on.
WORDS_HELD = 200_000
THRESHOLD = 0.5
#: Channel costs in nats: a mark for a letter, a mark left out, a run of letters for one or two, a mark for itself.
SUBSTITUTED, LEFT_OUT, SHORTENED, KEPT = 1.0, 1.5, 0.7, 4.0
_LETTER = re.compile(r"[^\W\d_]")


#: Classes of letters beyond a to z, by code point: trigrams are no more than (27 + CLASSES) ** 3, whatever the alphabet.
#: Those of one block of the Latin letters stay apart.
CLASSES = 64


class _Folded(dict):
    """Letters beyond ASCII to their classes, which are characters of private use."""

    def __missing__(self, code: int) -> int:
        return code if code < 128 else 0xE000 + code % CLASSES


_FOLDED = _Folded()


def trigrams(words: Counter[str]) -> Counter[str]:
    out: Counter[str] = Counter()
    for word, n in words.items():
        s = f"  {word.translate(_FOLDED)} "
        for i in range(2, len(s)):
            out[s[i - 2 : i + 1]] += n
    return out


class CharModel:
    """Trigram counts of characters in words, smoothed with those of bigrams and single characters."""

    def __init__(self, words: Counter[str], tri: Counter[str] | None = None) -> None:
        tri = trigrams(words) if tri is None else tri
        bi: Counter[str] = Counter()
        one: Counter[str] = Counter()
        for gram, n in tri.items():
            bi[gram[1:]] += n
            one[gram[2]] += n
        # contexts are counted as often as they are followed, so the shares of what follows them add up to one
        self.tri, self.bi, self.one = tri, bi, one
        self.after2, self.after1 = Counter(), Counter()
        for k, v in tri.items():
            self.after2[k[:2]] += v
        for k, v in bi.items():
            self.after1[k[0]] += v
        self.total = sum(one.values())
        self.cost: dict[str, float] = {}

    def nats(self, gram: str) -> float:
        found = self.cost.get(gram)
        if found is None:
            raw, gram = gram, gram.translate(_FOLDED)
            p1 = (self.one[gram[2]] + 0.5) / (self.total + 500)
            p2 = (self.bi[gram[1:]] + 5 * p1) / (self.after1[gram[1]] + 5)
            found = -float(np.log((self.tri[gram] + 5 * p2) / (self.after2[gram[:2]] + 5)))
            if len(self.cost) < 500_000:
                self.cost[raw] = found
        return found


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """For each run of a character, what it may stand for and at what cost. Marks at an edge may be left out."""
    out = []
    runs = [(c, len(list(run))) for c, run in groupby(word)]
    for k, (c, n) in enumerate(runs):
        if _LETTER.match(c):
            out.append([(c * n, 0.0)] if n == 1 else [(c, SHORTENED), (c * 2, 0.0 if n == 2 else SHORTENED)])
        elif c in LOOKS_LIKE:
            out.append([(x * k, SUBSTITUTED * n) for x in LOOKS_LIKE[c] for k in ([1] if n == 1 else [1, 2])] + [("", LEFT_OUT)] * (c in "!|+(<" or c in "@$" and k in (0, len(runs) - 1)) + [(c * n, KEPT * n)])
        elif c in FILLERS:
            out.append([("", LEFT_OUT), (c * n, KEPT * n)])
        else:
            out.append([(c * n, 0.0)])
    return out


def decode(word: str, model: CharModel) -> str:
    """The likeliest reading of a word (Viterbi over the lattice; a state is the last two characters)."""
    best: dict[str, tuple[float, tuple]] = {"  ": (0.0, ())}
    for options in lattice(word):
        step: dict[str, tuple[float, tuple]] = {}
        for last, (cost, path) in best.items():
            for said, extra in options:
                c, ctx = cost + extra, last
                for ch in said:
                    c += model.nats(ctx + ch)
                    ctx = ctx[1] + ch
                if ctx not in step or c < step[ctx][0]:
                    step[ctx] = (c, (path, said))
        best = step
    _, path = min(((c + model.nats(ctx + " "), p) for ctx, (c, p) in best.items()), key=lambda x: x[0])
    parts = []
    while path:
        path, said = path
        parts.append(said)
    return "".join(reversed(parts))


_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(97, 123), *range(128, 256)]] = True
_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in [*LOOKS_LIKE, *FILLERS]]] = True
#: Bytes that a word's core may begin with and end with.
_FIRST, _LAST = _LETTERS.copy(), _LETTERS.copy()
_LIKE = np.zeros(256, bool)
_LIKE[[ord(c) for c in LOOKS_LIKE]] = True
_FIRST |= _LIKE
_LAST |= _LIKE
_DIGITS = np.zeros(256, bool)
_DIGITS[48:58] = True
#: Bytes that a feature's word begins and ends with, once restored.
_INNER = _LETTERS | _DIGITS
#: Blanks between letters that are one spaced word, at most, and look-alike marks of a core without any letter, at least.
BLANKS, MARKS_ALONE = 3, 3


class Restorer:
    """Restores texts; keeps readings of words that return."""

    def __init__(self, model: CharModel) -> None:
        self.model, self.known = model, {}

    def read(self, core: bytes) -> bytes:
        found = self.known.get(core)
        if found is None:
            found = decode(core.decode("utf-8", "surrogatepass"), self.model).encode("utf-8", "surrogatepass")
            if len(self.known) < 200_000 and len(core) < 200:
                self.known[core] = found
        return found

    def block(self, texts: list[bytes]) -> list[bytes]:
        """Lower-cased texts, restored: only disguised words change."""
        w = words_of(texts, lower=False)
        raw, n = w.raw, len(w.at)
        if not n:
            return texts
        first, last = np.flatnonzero(_FIRST[raw]), np.flatnonzero(_LAST[raw])
        at = np.append(first, len(raw))[np.searchsorted(first, w.at)]
        end = np.concatenate([[-1], last])[np.searchsorted(last, w.end)] + 1
        ok = at < end
        at, end = np.where(ok, at, w.at), np.where(ok, end, w.at)
        letter = _LETTERS[raw]
        triple = np.zeros(len(raw), np.int32)
        triple[2:] = letter[2:] & (raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2]) & (raw[2:] < 128)
        letters, marks, triples, digits, like = (np.concatenate([[0], np.cumsum(x, dtype=np.int32)]) for x in (letter, _MARKS[raw], triple, _DIGITS[raw], _LIKE[raw]))
        alone = (end - at >= MARKS_ALONE) & (like[end] - like[at] == end - at) & (digits[end] == digits[at])
        flagged = alone | (letters[end] > letters[at]) & ((marks[end] > marks[at]) | (triples[end] > triples[np.minimum(at + 2, end)]))
        single = (w.end - w.at == 1) & (letter | _LIKE[raw])[w.at]
        apart = np.ones(n, bool)
        apart[1:] = ~(single[1:] & single[:-1] & (w.at[1:] <= w.end[:-1] + BLANKS) & (w.doc[1:] == w.doc[:-1]))
        group = np.cumsum(apart) - 1
        of_letters = np.bincount(group, letter[w.at] & single)  # two of them at least, so that rows of numbers stand
        spaced = ((np.bincount(group) >= 3) & (of_letters >= 2))[group] & single
        todo = np.flatnonzero(flagged | (spaced & apart))
        if not len(todo):
            return texts
        data, out = raw.tobytes(), list(texts)
        starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        ends_of_group = np.flatnonzero(np.append(apart[1:], True))
        for d, items in groupby(todo.tolist(), key=lambda i: int(w.doc[i])):
            parts, here = [], int(starts[d])
            for i in items:
                if flagged[i]:
                    a, b = int(at[i]), int(end[i])
                    core = data[a:b]
                else:
                    a, b = int(w.at[i]), int(w.end[ends_of_group[group[i]]])
                    core = b"".join(data[a:b].split())
                parts += [data[here:a], self.read(core)]
                here = b
            out[d] = b"".join([*parts, data[here : int(starts[d + 1]) - 1]])
        return out

    def texts(self, values) -> Iterator[tuple[int, list[bytes]]]:
        """(index of the first, restored texts) in blocks. Null: empty."""
        for first, block in blocks([v.lower() if isinstance(v, str) else None for v in values]):
            yield first, self.block(block)

    def text(self, value: str | None) -> str:
        return next(self.texts([value]))[1][0].decode("utf-8", "surrogatepass")


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(doc, index) of words and of their first four and five bytes, marks at the ends aside."""
    w = words_of(texts)
    inner = np.flatnonzero(_INNER[w.raw])
    at = np.append(inner, len(w.raw))[np.searchsorted(inner, w.at)]
    end = np.concatenate([[-1], inner])[np.searchsorted(inner, w.end)] + 1
    docs, index = [], []
    size = end - at
    for k in (4, 5, 0):
        ok = size > max(k, 0) if k else size > 0
        h = mix(w.span_hash(at[ok], at[ok] + k if k else end[ok]) + np.uint64(k * 1000003 + 17))
        docs.append(w.doc[ok])
        index.append((h >> np.uint64(64 - SIZE_BITS)).astype(np.int32))
    return np.concatenate(docs), np.concatenate(index)


def _present(doc: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(doc.astype(np.int64) << SIZE_BITS | index)
    return key >> SIZE_BITS, (key & ((1 << SIZE_BITS) - 1)).astype(np.int32)


def _rows(handle):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restore = Restorer(handle.value)
        for frame in frames:
            for first, texts in restore.texts(frame["text"]):
                doc, index = _present(*features(texts))
                cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
                part = frame.iloc[first : first + len(texts)]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "label": part["label"].to_numpy(), "index": [index[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]})

    return run


def _counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words: Counter[str] = Counter()

    def passed() -> pd.DataFrame:
        found = trigrams(words)
        words.clear()
        return pd.DataFrame({"gram": list(found), "n": list(found.values())}).astype({"gram": "str", "n": "int64"})

    for frame in frames:
        for t in frame["text"]:
            if isinstance(t, str):
                words.update(re.findall(r"[^\W\d_]+", t.lower()))
                if len(words) > WORDS_HELD:
                    yield passed()
    yield passed()


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", folds: int = 5, out: int = 0, limit: int = TRAIN_ROWS) -> tuple[CharModel, np.ndarray, float]:
    """(character model, weights, bias), none from the held-out fold: trigrams of all other documents, and a
    classifier of ``limit`` labelled rows at most. Without usable labels: zero weights."""
    spark = docs.sparkSession
    prepare(spark)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chosen = sample_of_labels(labels, label, folds, out, limit)
    rest = plain.where(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds != out, F.lit(True)))
    counted = rest.select("text").mapInPandas(_counts, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow().to_pydict()  # bounded by the classes of letters
    model = CharModel(Counter(), Counter(dict(sorted(zip(counted["gram"], counted["n"], strict=True)))))
    handle = spark.sparkContext.broadcast(model)
    rows = plain.join(F.broadcast(chosen), "doc_id").mapInPandas(_rows(handle), "doc_id long, label int, index array<int>")
    weights, bias = fitted(rows, 1 << SIZE_BITS, alpha=RATE, l1=SPARSITY, passes=4)
    return model, weights, bias


def score(docs: DataFrame, model: tuple[CharModel, np.ndarray, float], name: str = "toxic_score") -> DataFrame:
    """docs with a column of this name (0 to 1, never null; an empty or null text gets what the bias says), in the place of
    one that docs may have of that name. Whole texts are scored, long ones in blocks; equal texts have equal scores; an
    empty table gives an empty table."""
    prepare(docs.sparkSession)
    handle = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxic(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lm, weights, bias = handle.value
        restore, used = Restorer(lm), weights != 0
        for texts in parts:
            out = []
            for _, block in restore.texts(texts):
                doc, index = features(block)
                hit = used[index]
                doc, index = _present(doc[hit], index[hit])
                out.append(sigmoid(bias + np.bincount(doc, weights[index], minlength=len(block))))
            yield pd.Series(np.concatenate(out) if out else np.empty(0))

    return docs.withColumn(name, toxic("text"))


def classify(docs: DataFrame, labels: DataFrame, *, folds: int = 5, out: int = 0, threshold: float = THRESHOLD, limit: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    A null id counts as not held out and has no label; a null text is an empty one. Rows of a repeated id are scored
    each for itself and share their label; of several labels the largest counts. Whole texts are scored, however long.
    An empty table gives an empty table, and without usable labels every score is the same. Other columns of docs, of
    any name, aren't looked at.
    """
    scored = score(docs.select("doc_id", "text"), train(docs, labels, folds=folds, out=out, limit=limit))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == out, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= threshold).cast("int").alias("predicted"))
