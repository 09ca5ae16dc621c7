"""Toxicity of texts: a bidirectional gated recurrent network with attention pooling, in numpy."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import text_batches

#: Words in a window, and from one window's start to the next.
WINDOW = 32
STRIDE = 16
HIDDEN = 8
INPUT = 12
#: Rows of the table of character trigrams, and words with a row of their own.
GRAMS = 4096
VOCABULARY = 4096
#: Training sample: labelled rows of either class, the most words of a text and the run in which they are taken, and steps.
TOXIC_ROWS = 600
CLEAN_ROWS = 2400
MOST_WORDS = 3200
RUN = 64
STEPS = 260
BATCH = 512
RATE = 0.02
DECAY = 0.02
#: Rate of the tables of words and trigrams, over that of the network.
TABLES = 0.1
#: Share of a batch's words that are seen by their characters alone.
UNSEEN = 0.3
FOLDS = 5
#: Windows or words that are spread out into rows of floats at once.
CHUNK = 4096

#: ASCII letters in lower case; ASCII marks become spaces.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, text) of every window over the concatenated words of texts of these sizes.

    Windows begin every STRIDE words until one reaches the text's end; a text without words has one empty window.
    """
    count = np.maximum(1, -(-(sizes - WINDOW) // STRIDE) + 1)
    own = np.repeat(np.arange(len(sizes)), count)
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return (np.cumsum(sizes) - sizes)[own] + within * STRIDE, own


@dataclass
class Model:
    """Arrays by name; a word's input is its own row plus the mean row of its character trigrams."""

    vocabulary: dict[bytes, int]
    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, vocabulary: dict[bytes, int], seed: int = 7) -> Model:
        draw = np.random.default_rng(seed)
        p = {"word": draw.normal(0, 0.02, (len(vocabulary) + 1, INPUT)), "gram": draw.normal(0, 0.02, (GRAMS, INPUT))}
        for d in "fb":
            p |= {f"w{d}": draw.normal(0, INPUT**-0.5, (INPUT, 3 * HIDDEN)), f"u{d}": draw.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN)), f"c{d}": np.zeros(3 * HIDDEN)}
        p |= {"attend": draw.normal(0, 0.3, 2 * HIDDEN), "out": draw.normal(0, 0.3, 2 * HIDDEN), "bias": np.full(1, -1.0)}
        return cls(vocabulary, {k: v.astype(np.float32) for k, v in p.items()})

    def inputs(self, distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(inputs, word rows, gram rows, first gram of each word) of distinct words."""
        flat = np.frombuffer(b"".join(b"^" + w + b"$" for w in distinct), np.uint8).astype(np.int32)
        ends = np.cumsum(np.fromiter(map(len, distinct), np.int64, len(distinct)) + 2)
        grams = (flat[:-2] * 7919 + flat[1:-1] * 104729 + flat[2:] * 1299709) & 0x7FFFFFFF
        grams = (grams ^ (grams >> 13)) % GRAMS
        inside = np.ones(len(grams), bool)  # a trigram that runs into the next word is none
        inside[ends[:-1] - 1] = inside[ends[:-1] - 2] = False
        sizes = np.diff(ends, prepend=0) - 2
        grams, firsts = grams[inside], np.cumsum(sizes) - sizes
        rows = np.fromiter((self.vocabulary.get(w, 0) for w in distinct), np.int64, len(distinct))
        x = np.empty((len(distinct), INPUT), np.float32)
        for k in range(0, len(distinct), CHUNK):
            own = np.append(firsts, len(grams))[k : k + CHUNK + 1]
            x[k : k + CHUNK] = np.add.reduceat(self.p["gram"][grams[own[0] : own[-1]]], own[:-1] - own[0], axis=0)
        x /= sizes[:, None].astype(np.float32)
        x += self.p["word"][rows]
        return x, rows, grams, firsts

    def forward(self, x: np.ndarray, at: np.ndarray, keep: bool = False):
        """Logits of windows: at is (windows, WINDOW) into x, -1 where a window has no word."""
        p, n = self.p, len(at)
        there = at >= 0
        gates = {d: np.vstack([x @ p[f"w{d}"] + p[f"c{d}"], np.zeros((1, 3 * HIDDEN), np.float32)]) for d in "fb"}
        states = np.zeros((WINDOW, n, 2 * HIDDEN), np.float32)
        kept = {}
        for d, order in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1))):
            h = np.zeros((n, HIDDEN), np.float32)
            own = slice(0, HIDDEN) if d == "f" else slice(HIDDEN, None)
            for t in order:
                g, u = gates[d][at[:, t]], h @ p[f"u{d}"]
                zr = np.tanh((g[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN]) * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                m = np.tanh(g[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
                live = there[:, t, None]
                new = np.where(live, m + z * (h - m), h)
                if keep:
                    kept[d, t] = (h, z, r, m, u[:, 2 * HIDDEN :])
                h = new
                states[t, :, own] = h
        score = states @ p["attend"] + np.where(there.T, 0, -1e9).astype(np.float32)
        score -= score.max(0)
        weight = np.exp(score)
        weight *= there.any(1) / weight.sum(0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        logit = pooled @ p["out"] + p["bias"]
        return (logit, states, weight, pooled, kept) if keep else logit

    def backward(self, x: np.ndarray, at: np.ndarray, found, slope: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """(gradients of the arrays, gradient of x) for a gradient of the logits."""
        p = self.p
        _, states, weight, pooled, kept = found
        grad = {"out": pooled.T @ slope, "bias": np.array([slope.sum()], np.float32)}
        down = slope[:, None] * p["out"]
        near = np.einsum("tnh,nh->tn", states, down)
        score = weight * (near - (weight * near).sum(0))
        grad["attend"] = np.einsum("tn,tnh->h", score, states)
        dstates = weight[:, :, None] * down + score[:, :, None] * p["attend"]
        there = at >= 0
        dx = np.zeros((len(x) + 1, INPUT), np.float32)
        for d, order in (("f", range(WINDOW - 1, -1, -1)), ("b", range(WINDOW))):
            own = slice(0, HIDDEN) if d == "f" else slice(HIDDEN, None)
            dh = np.zeros((len(at), HIDDEN), np.float32)
            dgate = np.zeros((len(x) + 1, 3 * HIDDEN), np.float32)
            du = np.zeros_like(p[f"u{d}"])
            for t in order:
                h, z, r, m, un = kept[d, t]
                dh = dh + dstates[t, :, own]
                live = there[:, t, None]
                dm = np.where(live, dh * (1 - z), 0) * (1 - m * m)
                dz = np.where(live, dh * (h - m), 0) * z * (1 - z)
                dr = dm * un * r * (1 - r)
                g = np.hstack([dz, dr, dm])
                gu = np.hstack([dz, dr, dm * r])
                du += h.T @ gu
                dh = np.where(live, dh * z, dh) + gu @ p[f"u{d}"].T
                np.add.at(dgate, at[:, t], g)
            dgate = dgate[:-1]
            grad |= {f"u{d}": du, f"w{d}": x.T @ dgate, f"c{d}": dgate.sum(0)}
            dx[:-1] += dgate @ p[f"w{d}"].T
        return grad, dx[:-1]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """The largest window's score of every text."""
        if not self.p:
            return np.zeros(len(texts))
        flat, sizes = split(texts)
        out = np.full(len(texts), -np.inf, np.float32)
        codes, distinct = pd.factorize(flat)
        x = self.inputs(list(distinct))[0] if len(distinct) else np.zeros((0, INPUT), np.float32)
        starts, own = windows(sizes)
        ends = np.cumsum(sizes)[own]
        codes = np.append(codes, -1)
        for i in range(0, len(starts), 2048):
            place = starts[i : i + 2048, None] + np.arange(WINDOW)
            at = codes[np.where(place < ends[i : i + 2048, None], place, len(flat))]
            np.maximum.at(out, own[i : i + 2048], self.forward(x, at))
        return 1 / (1 + np.exp(-out.astype(np.float64)))


def split(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    lists = [words(t) for t in texts]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.empty(sizes.sum(), object)
    flat[:] = [w for own in lists for w in own]
    return flat, sizes


def coded(texts: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(codes, distinct words, words of each text): a code is a word's place among the distinct ones, in the order of coming.

    The texts of a training sample hold millions of words, which are never objects all at once.
    """
    places: dict[bytes, int] = {}
    codes = [np.fromiter((places.setdefault(w, len(places)) for w in words(t)), np.int32) for t in texts]
    return np.concatenate(codes), list(places), np.fromiter(map(len, codes), np.int64, len(codes))


def train(texts: list[bytes], toxic: list[int], steps: int = STEPS, seed: int = 7) -> Model:
    """A model from texts and their labels 0 and 1. Without both labels it has no arrays, and its scores are 0.

    A label belongs to a text, not to its windows. Of a toxic text only the window that scores highest counts as toxic, by log
    odds of words and trigrams at first, by the network later, which looks it up again four times; windows of clean texts are
    clean throughout.
    """
    label = np.array(toxic, np.float32)
    if not len(label) or label.min() == label.max():
        return Model({}, {})
    codes, distinct, sizes = coded(texts)
    seen = np.bincount(codes, minlength=len(distinct)).tolist()
    common = sorted((-n, w) for w, n in zip(distinct, seen) if n >= 3)[:VOCABULARY]
    model = Model.fresh({w: i + 1 for i, (_, w) in enumerate(common)}, seed)
    # a third of the texts sets the scale of the scores only
    fits = np.ones(len(label), bool)
    for k in (0, 1):
        if (label == k).sum() >= 6:
            fits[np.flatnonzero(label == k)[::3]] = False
    lean(model, distinct, codes, np.repeat(np.arange(len(label), dtype=np.int32), sizes), label, fits)
    codes = np.append(codes, np.int32(-1))
    starts, own = windows(sizes)
    ends = np.cumsum(sizes)[own]
    at = np.empty((len(starts), WINDOW), np.int32)
    for k in range(0, len(starts), CHUNK):
        place = starts[k : k + CHUNK, None] + np.arange(WINDOW)
        at[k : k + CHUNK] = codes[np.where(place < ends[k : k + CHUNK, None], place, len(codes) - 1)]
    draw = np.random.default_rng(seed)
    clean, toxic_at = np.flatnonzero(fits[own] & (label[own] == 0)), np.flatnonzero(fits[own] & (label[own] == 1))
    lead = np.append(model.inputs(distinct)[0][:, 0] if len(distinct) else [], -9).astype(np.float32)
    first = np.concatenate([np.sort(lead[at[k : k + CHUNK]], axis=1)[:, -3:].sum(1) for k in range(0, len(at), CHUNK)])
    good, bad = clean, peaks(first, own, toxic_at)
    mean = {k: np.zeros_like(v) for k, v in model.p.items()}
    square = {k: np.zeros_like(v) for k, v in model.p.items()}
    for step in range(steps):
        if step >= steps // 3 and (step - steps // 3) % max(1, steps // 6) == 0:
            x = model.inputs(distinct)[0]
            logit = np.concatenate([model.forward(x, at[k : k + CHUNK]) for k in range(0, len(at), CHUNK)])
            bad = np.concatenate([peaks(logit, own, toxic_at), toxic_at[logit[toxic_at] > 1]])
            hard = clean[logit[clean] > -3]
            good = np.concatenate([clean, np.repeat(hard, 1 + len(clean) // (2 * len(hard) + 1))])  # a third or more of the draws
        pick = np.concatenate([draw.choice(good, BATCH // 2), draw.choice(bad, BATCH // 2)])
        here, flat_at = np.unique(at[pick], return_inverse=True)
        flat_at = flat_at.reshape(len(pick), WINDOW)
        if here[0] < 0:
            here, flat_at = here[1:], flat_at - 1
        if not len(here):
            continue
        x, rows, grams, firsts = model.inputs([distinct[k] for k in here])
        hidden = (draw.random(len(rows)) < UNSEEN) & (rows > 0)
        x[hidden] += model.p["word"][0] - model.p["word"][rows[hidden]]
        rows = np.where(hidden, 0, rows)
        found = model.forward(x, flat_at, keep=True)
        slope = (1 / (1 + np.exp(-found[0])) - np.repeat([0, 1], BATCH // 2)).astype(np.float32) / BATCH
        grad, dx = model.backward(x, flat_at, found, slope)
        grad |= {"word": np.zeros_like(model.p["word"]), "gram": np.zeros_like(model.p["gram"])}
        np.add.at(grad["word"], rows, dx)
        each = np.diff(np.append(firsts, len(grams)))
        np.add.at(grad["gram"], grams, np.repeat(dx / each[:, None].astype(np.float32), each, axis=0))
        whole = RATE * min(1, 2 * (1 - step / steps))
        for k, g in grad.items():
            rate = whole * (TABLES if k in ("word", "gram") else 1)
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            model.p[k] -= (rate * mean[k] / (1 - 0.9 ** (step + 1)) / (np.sqrt(square[k] / (1 - 0.99 ** (step + 1))) + 1e-7)).astype(np.float32)
            if k in ("word", "gram"):
                model.p[k][:, 1:] *= np.float32(1 - rate * DECAY)
    x = model.inputs(distinct)[0]
    logit = np.concatenate([model.forward(x, at[k : k + CHUNK]) for k in range(0, len(at), CHUNK)])
    worst = np.full(len(label), -np.inf)
    np.maximum.at(worst, own, logit)
    apart = ~fits if (label[~fits] == 1).any() and (label[~fits] == 0).any() else fits
    scale, shift = calibrate(worst[apart], label[apart])
    model.p["out"] *= np.float32(scale)
    model.p["bias"] = (model.p["bias"] * scale + shift).astype(np.float32)
    return model


def peaks(value: np.ndarray, own: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Of the windows `among`, the one with the largest value in each text."""
    order = among[np.lexsort((-value[among], own[among]))]
    return order[np.flatnonzero(np.diff(own[order], prepend=-1))]


def lean(model: Model, distinct: list[bytes], codes: np.ndarray, text: np.ndarray, label: np.ndarray, fits: np.ndarray) -> None:
    """Start the first input of words and trigrams at the log odds of toxic texts that hold them, drawn to 0 by rareness."""
    ratio = (label[fits] == 0).sum() / (label[fits] == 1).sum()

    at = np.flatnonzero(fits)
    place = np.full(len(label), -1)
    place[at] = np.arange(len(at))
    own = label[at] == 1

    def odds(row: np.ndarray, where: np.ndarray, n: int, each: np.ndarray | None = None, flat: np.ndarray | None = None, firsts: np.ndarray | None = None) -> np.ndarray:
        """Log odds of n features: each row is a feature in a text, or the start of a list of them in flat."""
        held = np.zeros((n, len(at)), bool)
        for k in range(0, len(row), 100_000):
            r, w = row[k : k + 100_000], place[where[k : k + 100_000]]
            r, w = r[w >= 0], w[w >= 0]
            if each is None:
                held[r, w] = True
            else:
                many = each[r]
                step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                held[flat[np.repeat(firsts[r], many) + step], np.repeat(w, many)] = True
        bad, good = held[:, own].sum(1), held[:, ~own].sum(1)
        return np.log((bad + 2) / (good / ratio + 2)).astype(np.float32)

    if not len(distinct):
        return
    _, rows, grams, firsts = model.inputs(distinct)
    model.p["word"][:, 0] = odds(rows.astype(np.int32)[codes], text, len(model.vocabulary) + 1)
    model.p["word"][0, 0] = 0
    model.p["gram"][:, 0] = odds(codes, text, GRAMS, np.diff(np.append(firsts, len(grams))), grams, firsts)


def calibrate(worst: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Scale, above 0, and shift of texts' largest logits, by logistic regression with equal weight to both labels."""
    middle, spread = np.median(worst), worst.std() + 1e-6
    x, w, a, b = (worst - middle) / spread, np.where(label == 1, 0.5 / label.sum(), 0.5 / (1 - label).sum()), 1.0, 0.0
    for _ in range(3000):
        e = w * (1 / (1 + np.exp(-np.clip(a * x + b, -30, 30))) - label)
        a, b = max(1e-3, a - 2 * ((e * x).sum() + 1e-4 * a)), b - 2 * e.sum()
    return a / spread, b - a * middle / spread


def held_out(doc_id):
    """Whether a row is kept from training: crc32 of its id as text, modulo FOLDS, is 0."""
    return F.crc32(doc_id.cast("string")) % FOLDS == 0


def sampled(text: bytes, most: int = MOST_WORDS, run: int = RUN) -> bytes:
    """The words of a text for training: all, or of a longer one runs of them, spread evenly from its start to its end."""
    own = words(text)
    if len(own) <= most:
        return b" ".join(own)
    starts = np.linspace(0, len(own) - run, most // run).astype(int)
    return b" ".join(w for s in starts for w in own[s : s + run])


def _taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = 0
        for ids, texts in text_batches(iter([batch])):
            labels = batch.column(2).slice(done, len(texts))
            done += len(texts)
            yield pa.RecordBatch.from_arrays([ids, pa.array([sampled(t) for t in texts], pa.binary()), labels], names=["doc_id", "text", "toxic"])


def learn(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> Model:
    """A model from the labelled rows that aren't held out: a sample of at most toxic_rows and clean_rows, in hash order.

    Ids are sampled first; of their texts MOST_WORDS words each come to the driver, see sampled(). Ids with both labels count as
    toxic; null ids and labels are left out.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    taken = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((1, toxic_rows), (0, clean_rows))]
    ids = taken[0].union(taken[1])  # at most toxic_rows + clean_rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = texts.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "toxic").mapInArrow(_taken, "doc_id long, text binary, toxic int")
    rows = sorted((r["doc_id"], bytes(r["text"]), r["toxic"]) for r in known.collect())
    return train([t for _, t, _ in rows], [k for _, _, k in rows])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of docs; null and empty texts get the score of an empty window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_batches(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(model.scores(texts))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs (doc_id, text), learned from labels (doc_id, toxic).

    A text's score is that of its worst window, over all overlapping windows of it. Rows that repeat come back repeated; a null
    doc_id has held_out null. Without labels of both classes every score is 0. Other columns are left out.
    """
    found = score(docs, learn(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs that score below `least`, with all of its columns; they don't leave their partitions."""
    schema = docs.schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.RecordBatch.from_arrays([pa.array(range(len(batch))), batch.column(at)], names=["row", "text"])
            done = [model.scores(texts) for _, texts in text_batches(iter([rows]), "row")]
            yield batch.filter(pa.array(np.concatenate(done) < least)) if done else batch

    return docs.mapInArrow(run, schema)


def fold(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % FOLDS
