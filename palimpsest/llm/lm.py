"""Language-model scoring: online logistic context mixing.

A byte is eight binary decisions. For each of several contexts (the last one
to six bytes) counts of zeros and ones predict the next bit. Predictions are
mixed in the logistic domain by one of several sets of weights, which the gate
picks from the bit's position and from how much the longer contexts have been
seen. Weights are trained online, by gradient steps; an adaptive map then
refines the mixed probability from what bits turned out to be. While scoring,
several refinements (plain, sharpened, flattened) compete: a Bayesian mixture
over them, whose weights follow the text as it goes, gives a proper probability
of the whole text.

All counts are exact counts of the whole corpus, in a table keyed by gram (a
byte with the six before it), which grows with the corpus. It is dealt into parts
by the last three bytes of context, so that a part holds all counts of its contexts
of three to six bytes; shorter ones are few, by the alphabet, and are broadcast. A
part is one row, its grams in order and compressed; the number of parts follows
from the size of the corpus alone, not from the cluster.

Training goes over this table: a step takes some distinct grams, each weighed by
how often it occurs, and predicts every occurrence from the counts of all other
occurrences. So what a step predicts hasn't been counted, as it hasn't in
training along the text, yet counts are those of the whole corpus, as they are in
scoring. Steps go in a fixed shuffled order within a part, not in the order of the
texts; parts' weights are averaged by what they saw. The adaptive map is counted
in a second pass, under the averaged weights that it refines.

Then each distinct gram is valued once. The most frequent grams go to the tasks
that score texts, and texts' other grams are joined to theirs.

The base score is the unigram model of the whole corpus: counts of lower-cased
words and of one end a text, smoothed by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import prepare, stored
from .textkernel import blocks, mix, words_of

#: Bytes of context of each predictor.
ORDERS = (1, 2, 3, 4, 5, 6)
CONTEXT = max(ORDERS)
#: How many of the contexts of two bytes and more have been seen often enough: none to all of them.
SURE, OFTEN = len(ORDERS), 2
SETS = 8 * SURE
#: Contexts of so many bytes and fewer are broadcast; of more, dealt by the last BROADCAST + 1 bytes.
BROADCAST = 2
#: Learning rate, distinct grams in a step, weights at the start, and what is added to each count.
RATE, STEP_GRAMS, START, ADDED = 0.3, 1000, 0.25, 0.4
#: Bins of the adaptive map, and classes of how often grams occur.
BINS, SIZES = 33, 256
#: Bytes of the corpus that a part's grams come from, on average, and grams that are valued at a time.
PART_BYTES, VALUED_GRAMS = 8 << 20, 20_000
#: Parts that a task goes through, one after the other.
PARTS_A_TASK = 4
#: A word with a share of the tokens of at least 1 in so many is frequent: no more than so many words are.
FREQUENT = 1 << 20
#: Grams whose predictions go to all tasks: the most frequent ones, 20 bytes each.
KEPT = 3 << 20
#: Grams, and words, that a task gathers before it adds up equal ones; it passes them on if two thirds are distinct.
GATHERED = 4 << 20
END = np.uint64(0xA5A5F00D12345678)
POWERS = (1.0, 0.9, 1.1)


def grams_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(doc, gram) for each byte and the end mark of each text: the byte in the low 8 bits, those before it above.
    A text starts after, and ends with, a byte 0xFF, which UTF-8 doesn't have."""
    data = np.frombuffer(b"".join(b"\xff" * CONTEXT + t + b"\xff" for t in texts), np.uint8).astype(np.uint64)
    gram, held = data, 1
    while held <= CONTEXT:  # twice as many bytes by each step; the last one may meet a byte again
        k = min(held, CONTEXT + 1 - held)
        longer = gram.copy()
        longer[k:] |= gram[:-k] << np.uint64(8 * k)
        gram, held = longer, held + k
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(doc)) + CONTEXT * (doc + 1)
    return doc, gram[at]


def cuts_of(key: np.ndarray) -> np.ndarray:
    """Where runs of equal entries begin."""
    return np.flatnonzero(np.concatenate([np.ones(min(len(key), 1), bool), key[1:] != key[:-1]]))


def summed(key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their times."""
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    cut = cuts_of(key)
    return key[cut], np.add.reduceat(times, cut) if len(cut) else times


def keys_of(gram: np.ndarray, order: int) -> np.ndarray:
    """The gram's byte with so many bytes before it."""
    return gram & np.uint64((1 << (8 * order + 8)) - 1)


class Counted:
    """Counts of one order. seen[b] of a (context, byte): how often the context occurs before a byte that begins with
    the byte's first b bits."""

    def __init__(self, key: np.ndarray, times: np.ndarray) -> None:
        """key: distinct, in order; every key that is asked for must be among them, if with no times."""
        self.key, self.seen = key, np.empty((9, len(key)), np.float32)
        sums = np.concatenate([[0], np.cumsum(times)])
        for b in range(9):
            cut = cuts_of(key >> np.uint64(8 - b))
            end = np.append(cut[1:], len(key))
            self.seen[b] = np.repeat((sums[end] - sums[cut]).astype(np.float32), end - cut)

    def of(self, key: np.ndarray) -> np.ndarray:
        return self.seen[:, np.searchsorted(self.key, key)]


def signs_of(gram: np.ndarray) -> np.ndarray:
    """8 x n: 1 where a bit of the byte is one, else -1."""
    byte = (gram & np.uint64(255)).astype(np.int64)
    return np.stack([((byte >> (7 - k)) & 1) * 2 - 1 for k in range(8)]).astype(np.float32)


def stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


def inputs(gram: np.ndarray, counted: list[Counted], left_out: int = 0) -> tuple[list[np.ndarray], np.ndarray]:
    """(an array 8 x n for each order and one for the bias, 8 x n gates). An input says how likely the order's counts hold
    the bits that the gram's byte does have. left_out: occurrences of the gram itself that don't count."""
    x, sure, less = [], np.zeros((8, len(gram)), np.int64), np.float32(left_out)
    for order, table in zip(ORDERS, counted, strict=True):
        seen = table.of(keys_of(gram, order)) - less
        own, all_ = seen[1:], seen[:-1]
        x.append(np.log((own + np.float32(ADDED)) / (all_ - own + np.float32(ADDED))))
        if order >= 2:
            sure += all_ > OFTEN
    return [*x, np.float32(0.3) * signs_of(gram)], np.arange(8)[:, None] * SURE + sure


class Model:
    """Weights, a set for each gate, and the adaptive map: zeros and ones met at each gate and bin of the mixed prediction."""

    def __init__(self) -> None:
        self.weights = np.full((SETS, len(ORDERS) + 1), START, np.float64)
        self.weights[:, -1] = 0
        self.map = np.zeros((SETS, BINS, 2), np.float64)

    def mixed(self, x: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        weights = self.weights.astype(np.float32)
        return np.clip(sum(values * np.take(np.ascontiguousarray(weights[:, k]), gate) for k, values in enumerate(x)), -12, 12)

    def learn(self, x: list[np.ndarray], gate: np.ndarray, times: np.ndarray) -> np.ndarray:
        """One online step on grams that occur so many times; returns how much each set saw."""
        error = times / (1 + np.exp(self.mixed(x, gate)))
        at = gate.ravel()
        total = np.bincount(at, np.broadcast_to(times, gate.shape).ravel(), minlength=SETS)
        step = np.stack([np.bincount(at, (error * values).ravel(), minlength=SETS) for values in x], axis=1)
        self.weights += RATE * step / (total[:, None] + 1)
        return total

    def cells(self, z: np.ndarray, gate: np.ndarray, sign: np.ndarray) -> np.ndarray:
        """Bins are of the prediction that the bit is one."""
        return gate * BINS + np.clip(np.round((z * sign + 8) * 2), 0, BINS - 1).astype(np.int64)

    def met(self, x: list[np.ndarray], gate: np.ndarray, sign: np.ndarray, times: np.ndarray) -> np.ndarray:
        """What grams that occur so many times add to the map."""
        cell = self.cells(self.mixed(x, gate), gate, sign) * 2 + (sign > 0)
        return np.bincount(cell.ravel(), np.broadcast_to(times, cell.shape).ravel(), minlength=self.map.size)

    def nats(self, x: list[np.ndarray], gate: np.ndarray, sign: np.ndarray) -> np.ndarray:
        """n x experts: log probabilities of each gram's byte after its context."""
        z = self.mixed(x, gate)
        one = squash(z * sign)
        all_ = self.map.sum(axis=2)
        refined, trust = (self.map[:, :, 1] / (all_ + 8)).astype(np.float32), (8 / (all_ + 8)).astype(np.float32)
        cell = self.cells(z, gate, sign)
        both = stretch(np.clip((one + np.take(refined, cell) + np.take(trust, cell) * one) / 2, np.float32(1e-6), np.float32(1 - 1e-6))) * sign
        return np.stack([-np.log1p(np.exp(-both * np.float32(power))).sum(axis=0, dtype=np.float64) for power in POWERS], axis=1)


class Known:
    """Log probabilities of frequent grams or words, found by a hashed slot or, where another has it, the one after it; if
    that is taken too, by search. What would have found an empty slot isn't known."""

    def __init__(self, gram: np.ndarray, nats: np.ndarray, bits: int = 23) -> None:
        """gram: in order, the last one no gram's number."""
        self.gram, self.nats, self.shift = gram, nats, np.uint64(64 - bits)
        self.none = len(gram) - 1
        self.slot = np.full((1 << bits) + 1, self.none, np.int32)
        own, every = self._slots(gram[:-1]), np.arange(self.none, dtype=np.int32)
        self.slot[own] = every
        second = every[self.slot[own] != every]
        after = own[second] + 1
        free = self.slot[after] == self.none
        self.slot[after[free]] = second[free]

    def _slots(self, gram: np.ndarray) -> np.ndarray:
        return ((gram * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def look_up(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log probabilities, zeros for grams that aren't known; indices of those)."""
        slot = self._slots(gram)
        at = np.take(self.slot, slot)
        miss = np.flatnonzero((np.take(self.gram, at) != gram) & (at != self.none))
        found = self.slot[slot[miss] + 1]
        at[miss] = found
        taken = (self.gram[found] != gram[miss]) & (found != self.none)
        miss, wanted = miss[taken], gram[miss[taken]]
        found = np.searchsorted(self.gram, wanted)
        found[self.gram[found] != wanted] = self.none
        at[miss] = found
        return np.take(self.nats, at, axis=0), np.flatnonzero(at == self.none)


def packed(key: np.ndarray, times: np.ndarray) -> bytes:
    """Keys in order and their times, compressed: bytes of differences by their place."""
    planes = [np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T) for x in (np.diff(key, prepend=np.uint64(0)), times)]
    return zstandard.compress(b"".join(x.tobytes() for x in planes), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(2, 8, -1)
    key, times = (np.ascontiguousarray(x.T).view("<u8").ravel() for x in planes)
    return np.cumsum(key, dtype=np.uint64), times.astype(np.int64)


class Tally:
    """Keys and how often they occur; equal ones are added up when many have gathered."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, key: np.ndarray, times: np.ndarray) -> None:
        self.parts.append((key, times))

    def size(self) -> int:
        return sum(len(k) for k, _ in self.parts)

    def add_up(self, least: int = GATHERED) -> bool:
        """Whether more than so many had gathered."""
        if self.size() <= least:
            return False
        self.parts = [summed(np.concatenate([k for k, _ in self.parts]), np.concatenate([n for _, n in self.parts]))]
        return True

    def taken(self, last: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What is to be passed on, in order; if it is the last time, all."""
        if self.add_up(0 if last else GATHERED) and (last or self.size() > GATHERED * 2 // 3):
            yield self.parts.pop()


COUNTED = "kind int, key long, n long, grams binary"
_COUNTED = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64()), ("grams", pa.binary())])


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """Columns that aren't given are null."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _words(key: np.ndarray, times: np.ndarray) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(key), 100_000):
        part = key[a : a + 100_000].view(np.int64)
        yield batch_of(_COUNTED, kind=np.zeros(len(part), np.int32), key=part, n=times[a : a + 100_000])


def _grams(gram: np.ndarray, times: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Grams, in order, by part."""
    part = (mix((gram >> np.uint64(8)) & np.uint64((1 << (8 * BROADCAST + 8)) - 1)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    gram, times, part = gram[order], times[order], part[order]
    cut = cuts_of(part)
    for a in range(0, len(cut), 1000):
        pieces = [(int(part[x]), packed(gram[x:y], times[x:y])) for x, y in zip(cut[a : a + 1000], np.append(cut, len(gram))[a + 1 : a + 1001], strict=True)]
        yield batch_of(_COUNTED, kind=np.ones(len(pieces), np.int32), key=[k for k, _ in pieces], n=np.zeros(len(pieces), np.int64), grams=[g for _, g in pieces])


def _counter(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of kind 0: words (key: the hash) and how often; of kind 1: a part's grams and how often, those of held-out
        texts no times."""
        words, grams = Tally(), Tally()
        for batch in batches:
            held = batch["held_out"].to_numpy(zero_copy_only=False).astype(bool)
            for first, texts in blocks(batch["text"].to_pylist()):
                out = held[first : first + len(texts)]
                if out.any():
                    gram = np.unique(grams_of([t for t, o in zip(texts, out, strict=True) if o])[1])
                    grams.add(gram, np.zeros(len(gram), np.int64))
                    texts = [t for t, o in zip(texts, out, strict=True) if not o]
                if texts:
                    w = words_of(texts)
                    words.add(*np.unique(np.concatenate([w.hash, np.full(len(texts), END)]), return_counts=True))
                    grams.add(*np.unique(grams_of(texts)[1], return_counts=True))
                for key, times in words.taken():
                    yield from _words(key, times)
                for key, times in grams.taken():
                    yield from _grams(key, times, parts)
        for key, times in words.taken(last=True):
            yield from _words(key, times)
        for key, times in grams.taken(last=True):
            yield from _grams(key, times, parts)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the rows of each key, all of which are here."""
    words, grams = Tally(), {}
    for batch in batches:
        of_words = batch["kind"].to_numpy() == 0
        key = batch["key"].to_numpy()
        if of_words.any():
            words.add(key[of_words].view(np.uint64), batch["n"].to_numpy()[of_words])
            words.add_up()
        for i in np.flatnonzero(~of_words).tolist():
            grams.setdefault(int(key[i]), []).append(batch["grams"][i].as_py())
    for key, times in words.taken(last=True):
        yield from _words(key, times)
    for part, pieces in sorted(grams.items()):
        held = [unpacked(data) for data in pieces]
        key, times = summed(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))
        yield batch_of(_COUNTED, kind=np.ones(1, np.int32), key=[part], n=[len(key)], grams=[packed(key, times)])


def _held(batches: Iterator[pa.RecordBatch], low: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, list[Counted]]]:
    """(grams in order, times, counts of all orders) of each part."""
    short = [Counted(*t) for t in low]
    for batch in batches:
        for data in batch["grams"]:
            gram, times = unpacked(data.as_py())
            yield gram, times, [*short, *(Counted(*summed(keys_of(gram, k), times)) for k in ORDERS if k > BROADCAST)]


def _shortener(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of the longest contexts that are broadcast, and how often, in each part."""
    for batch in batches:
        for data in batch["grams"]:
            gram, times = unpacked(data.as_py())
            key, times = summed(keys_of(gram, BROADCAST), times)
            yield pa.RecordBatch.from_pydict({"key": key.view(np.int64), "c": times})


def _trainer(handle):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each part's weights: for each set what it saw (place 0) and that times each weight."""
        for gram, times, counted in _held(batches, handle.value):
            gram, times = gram[times > 0], times[times > 0].astype(np.float32)
            order = np.random.default_rng(len(gram)).permutation(len(gram))
            model, saw = Model(), np.zeros(SETS)
            for a in range(0, len(gram), VALUED_GRAMS):
                at = order[a : a + VALUED_GRAMS]
                x, gate = inputs(gram[at], counted, left_out=1)
                for b in range(0, len(at), STEP_GRAMS):
                    s = slice(b, b + STEP_GRAMS)
                    saw += model.learn([values[:, s] for values in x], gate[:, s], times[at[s]])
            value = np.concatenate([saw[:, None], model.weights * saw[:, None]], axis=1).ravel()
            yield pa.RecordBatch.from_pydict({"place": np.arange(len(value)), "value": value})

    return run


def sizes_of(times: np.ndarray) -> np.ndarray:
    """Classes of how often grams occur, each a quarter of a factor of two."""
    return np.floor(np.log2(times + 1.0) * 4).astype(np.int64)


def _mapper(handle):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What each part adds to each place of the map; after it, how many grams there are of each class of sizes."""
        model, low = handle.value
        for gram, times, counted in _held(batches, low):
            value = np.concatenate([np.zeros(model.map.size), np.bincount(sizes_of(times), minlength=SIZES)])
            gram, times = gram[times > 0], times[times > 0].astype(np.float64)
            for a in range(0, len(gram), VALUED_GRAMS):
                part = gram[a : a + VALUED_GRAMS]
                value[: model.map.size] += model.met(*inputs(part, counted, left_out=1), signs_of(part), times[a : a + VALUED_GRAMS])
            place = np.flatnonzero(value)
            yield pa.RecordBatch.from_pydict({"place": place, "value": value[place]})

    return run


def _valuer(handle):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each gram with its log probabilities and whether it is kept."""
        model, low, least = handle.value
        for gram, times, counted in _held(batches, low):
            kept = sizes_of(times) >= least
            for a in range(0, len(gram), VALUED_GRAMS):
                part = gram[a : a + VALUED_GRAMS]
                nats = model.nats(*inputs(part, counted), signs_of(part)).astype(np.float32)
                yield pa.RecordBatch.from_pydict({"gram": part.view(np.int64), "kept": kept[a : a + VALUED_GRAMS]} | {f"e{k}": np.ascontiguousarray(nats[:, k]) for k in range(len(POWERS))})

    return run


def _of_texts(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, key) and how often they occur; equal ones that a hash parts may come again."""
    order = np.argsort(key * np.uint64(0x9E3779B97F4A7C15) ^ mix(doc.astype(np.uint64)))
    doc, key = doc[order], key[order]
    cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])]))
    return doc[cut], key[cut], np.diff(np.append(cut, len(key)))


SCORED = "row long, doc_id long, held_out boolean, word long, gram long, times long, n_tokens long, n_known long, n_bytes long, base double, e0 double, e1 double, e2 double"
_SCORED = pa.schema([(name, {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[kind]) for name, kind in (c.split() for c in SCORED.split(", "))])
#: Bits of one decimal place.
BITS = float(np.log2(10))


def _scorer(handle):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per text (word and gram null), a row per distinct word of a text that isn't frequent, and one per
        distinct gram of a text that isn't kept."""
        kept, nats, hashes, logs = handle.value
        known, frequent = Known(kept, nats), Known(hashes, logs)
        for batch in batches:
            rows = batch["row"].to_numpy()
            for first, texts in blocks(batch["text"].to_pylist()):
                k = len(texts)
                of, gram = grams_of(texts)
                starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])[:-1]
                found, strange = known.look_up(gram)
                each = np.add.reduceat(found, starts, axis=0, dtype=np.float64)
                w = words_of(texts)
                doc, h = np.concatenate([w.doc, np.arange(k)]), np.concatenate([w.hash, np.full(k, END)])
                log, rare = frequent.look_up(h)
                found = np.ones(len(h), bool)
                found[rare] = False
                row = rows[first : first + k]
                yield batch_of(_SCORED, row=row, doc_id=batch["doc_id"][first : first + k], held_out=batch["held_out"][first : first + k], times=np.zeros(k, np.int64), n_tokens=w.per_doc() + 1, n_known=np.bincount(doc[found], minlength=k), n_bytes=np.array([len(t) for t in texts], np.int64), base=np.bincount(doc, log, minlength=k), e0=each[:, 0], e1=each[:, 1], e2=each[:, 2])
                if not found.all():
                    doc, h, times = _of_texts(doc[~found], h[~found])
                    yield batch_of(_SCORED, row=row[doc], word=h.view(np.int64), times=times)
                if len(strange):
                    doc, h, times = _of_texts(of[strange], gram[strange])
                    yield batch_of(_SCORED, row=row[doc], gram=h.view(np.int64), times=times)

    return run


def _places(parts: DataFrame, run, size: int) -> np.ndarray:
    """Sums of what parts give for each of so many places."""
    out = np.zeros(size)
    for row in parts.mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect():  # size rows at most
        out[row["place"]] = row["value"]
    return out


def _least(classes: np.ndarray, kept: int) -> int:
    """The least class of sizes whose grams, and all of greater classes, are no more than so many."""
    fits = np.flatnonzero(np.cumsum(classes[::-1]) <= kept)
    return len(classes) - 1 - int(fits[-1]) if len(fits) else len(classes)


def _valued(spark: SparkSession, parts: DataFrame, kept: int) -> DataFrame:
    """(gram, kept, e0, e1, e2) of each gram of the corpus: log probabilities, and whether it is among the most frequent."""
    short = parts.mapInArrow(_shortener, "key long, c long").groupBy("key").agg(F.sum("c").alias("c")).toArrow()  # bounded by the alphabet
    key, times = short["key"].to_numpy().view(np.uint64), short["c"].to_numpy()
    low = [summed(keys_of(key, k), times) for k in ORDERS if k <= BROADCAST]
    model = Model()
    sums = _places(parts, _trainer(spark.sparkContext.broadcast(low)), SETS * (len(ORDERS) + 2)).reshape(SETS, -1)
    saw = sums[:, :1]
    model.weights = np.where(saw > 0, sums[:, 1:] / np.maximum(saw, 1), model.weights)
    met = _places(parts, _mapper(spark.sparkContext.broadcast((model, low))), model.map.size + SIZES)
    model.map = met[: model.map.size].reshape(model.map.shape)
    handle = spark.sparkContext.broadcast((model, low, _least(met[model.map.size :], kept)))
    return stored(parts.mapInArrow(_valuer(handle), "gram long, kept boolean, e0 float, e1 float, e2 float"), "lm-valued")


def score(docs: DataFrame, *, folds: int = 7, out: int = 2, kept: int = KEPT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte), a row per row of docs;
    logarithms of scores to base 10.

    bits_per_byte is what the model spends on the whole text and its end, in bits, over the text's UTF-8 bytes and the
    end: total_bits_per_byte() says it of many texts. Null texts count as empty: one token, the end. A null id counts as not held
    out. Rows of a repeated id each have their own result. With no training rows
    all counts are zero, N and V too, and the mix predicts from its start.
    ``kept`` says how many grams' predictions go to all tasks; results don't
    depend on it.
    """
    spark = docs.sparkSession
    prepare(spark)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == out, F.lit(False))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out"))
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    counted = plain.select("text", "held_out").mapInArrow(_counter(parts), COUNTED)
    tasks = max(-(-parts // PARTS_A_TASK), spark.sparkContext.defaultParallelism)
    dealt = counted.repartition(tasks, "kind", "key")
    counted = stored(dealt.mapInArrow(_added, COUNTED), "lm-counted")
    words = counted.where("kind = 0").select("key", F.col("n").alias("c"))
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    grams = counted.where("kind = 1").select("grams").repartition(tasks)
    valued = _valued(spark, grams, kept)
    most = valued.where("kept").orderBy("gram").toArrow()  # no more than kept rows
    end = np.iinfo(np.uint64).max  # a last entry, so that searches end within the arrays
    gram = np.append(most["gram"].to_numpy().view(np.uint64), end)
    nats = np.stack([np.append(most[f"e{k}"].to_numpy(), np.float32(0)) for k in range(len(POWERS))], axis=1)
    frequent = words.where(F.col("c") * FREQUENT >= n).toArrow()  # no more than FREQUENT rows
    hashes = frequent["key"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    logs = np.append(np.log10(frequent["c"].to_numpy()[order] + 1.0), 0)
    handle = spark.sparkContext.broadcast((gram, nats, np.append(hashes[order], end), logs))
    passed = plain.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_scorer(handle), SCORED)
    scored = stored(passed, "lm-scored")
    rest = scored.where("word is not null").select("row", "word", "times").join(words, F.col("word") == F.col("key"))
    rest = rest.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum("times").alias("also"))
    experts = [f"e{k}" for k in range(len(POWERS))]
    rest_valued = valued.where("not kept").select("gram", *(F.col(e).alias(f"of_{e}") for e in experts))
    others = scored.where("gram is not null").select("row", "gram", "times").join(rest_valued, "gram")
    others = others.groupBy("row").agg(*(F.sum(F.col("times") * F.col(f"of_{e}").cast("double")).alias(f"of_{e}") for e in experts))
    joined = scored.where("word is null and gram is null").drop("word", "gram", "times").join(rest, "row", "left").join(others, "row", "left")
    base = F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))
    joined = joined.withColumns({e: F.col(e) + F.coalesce(f"of_{e}", F.lit(0.0)) for e in experts})
    best = F.greatest(*experts)
    mixed = (best + F.log(sum((F.exp(F.col(e) - best) for e in experts), F.lit(0.0)) / len(POWERS))) / float(np.log(10))
    return joined.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), mixed.alias("score"), "n_bytes", (-mixed * BITS / (F.col("n_bytes") + 1)).alias("bits_per_byte"))


def total_bits_per_byte(scored: DataFrame, *by: str) -> DataFrame:
    """(by..., texts, n_bytes, base_bits_per_byte, bits_per_byte) of score()'s rows together, or of each group of them: all bits
    over all bytes, ends counted as bytes. No rows give null figures, or no groups."""
    symbols = F.sum(F.col("n_bytes") + 1)
    return scored.groupBy(*by).agg(F.count("*").alias("texts"), F.sum("n_bytes").alias("n_bytes"), (-F.sum("base_score") * BITS / symbols).alias("base_bits_per_byte"), (-F.sum("score") * BITS / symbols).alias("bits_per_byte"))
