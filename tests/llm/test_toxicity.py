import math
import random
import tracemalloc
import zlib

import numpy as np
import pytest

from keyloom.llm import toxicity as T


def corpus(n, seed):
    draw = random.Random(seed)
    plain = ["".join(draw.choice("aeinrst") for _ in range(draw.randrange(2, 7))) for _ in range(300)]
    out = []
    for k in range(n):
        own = [draw.choice(plain) for _ in range(draw.randrange(3, 200))]
        bad = k % 3 == 0
        if bad:
            for _ in range(3):
                own.insert(draw.randrange(len(own)), draw.choice(["vile", "grolmax", "grolty", "grolun"]))
        out.append((k, " ".join(own), int(bad)))
    return out


@pytest.fixture(scope="module")
def model():
    rows = corpus(400, 1)
    return T.train([t.encode() for _, t, _ in rows], [y for _, _, y in rows], steps=120)


def test_held_out_accuracy(model):
    rows = corpus(300, 1)[:0] + corpus(300, 1)
    fresh = [(k, t.replace("grolty", "grolpiq"), y) for k, t, y in corpus(300, 1)]
    for own in (rows, fresh):
        score = model.scores([t.encode() for _, t, _ in own])
        assert ((score >= 0.5) == np.array([y for _, _, y in own])).mean() > 0.95


def test_a_late_window_counts(model):
    clean = ("seat rest nine " * 2000).encode()
    assert model.scores([clean])[0] < 0.5 < model.scores([clean + b" vile grolmax vile grolty"])[0]


def scalar_score(model, text):
    """The largest score of all windows, one number after the other."""
    p = {k: v.astype(float).tolist() for k, v in model.p.items()}
    plain = "".join(chr(c).lower() if chr(c).isalnum() or c >= 128 else " " for c in text).encode("latin-1")
    tokens = plain.split()

    def vector(w):
        grams = []
        marked = b"^" + w + b"$"
        for a, b, c in zip(marked, marked[1:], marked[2:]):
            h = (a * 7919 + b * 104729 + c * 1299709) & 0x7FFFFFFF
            grams.append((h ^ (h >> 13)) % T.GRAMS)
        own = p["word"][model.vocabulary.get(w, 0)]
        return [own[k] + sum(p["gram"][g][k] for g in grams) / len(grams) for k in range(T.INPUT)]

    def sigmoid(x):
        return 1 / (1 + math.exp(-x))

    def states(xs, d):
        h, out = [0.0] * T.HIDDEN, []
        for x in xs:
            g = [sum(x[i] * p[f"w{d}"][i][j] for i in range(T.INPUT)) + p[f"c{d}"][j] for j in range(3 * T.HIDDEN)]
            u = [sum(h[i] * p[f"u{d}"][i][j] for i in range(T.HIDDEN)) for j in range(3 * T.HIDDEN)]
            new = []
            for j in range(T.HIDDEN):
                z, r = sigmoid(g[j] + u[j]), sigmoid(g[T.HIDDEN + j] + u[T.HIDDEN + j])
                m = math.tanh(g[2 * T.HIDDEN + j] + r * u[2 * T.HIDDEN + j])
                new.append((1 - z) * m + z * h[j])
            h = new
            out.append(h)
        return out

    best, start = -math.inf, 0
    while True:
        xs = [vector(w) for w in tokens[start : start + T.WINDOW]]
        ahead, back = states(xs, "f"), states(xs[::-1], "b")[::-1]
        both = [a + b for a, b in zip(ahead, back)]
        weight = [math.exp(sum(x * y for x, y in zip(h, p["attend"]))) for h in both]
        pooled = [sum(w * h[k] for w, h in zip(weight, both)) / sum(weight) for k in range(2 * T.HIDDEN)] if both else [0.0] * 2 * T.HIDDEN
        best = max(best, sum(x * y for x, y in zip(pooled, p["out"])) + p["bias"][0])
        start += T.STRIDE
        if start + T.WINDOW - T.STRIDE >= len(tokens):
            return sigmoid(best)


def test_scores_match_a_scalar_forward_pass(model):
    own = [t.encode() for _, t, _ in corpus(12, 5)] + [b"", b" \t!?", b"one", b"Vile, GROLMAX; vile-grolty", b"word " * 32, b"word " * 33, b"a b c " * 40 + b"grolun vile", "é漢字 vile".encode()]
    assert np.allclose(model.scores(own), [scalar_score(model, t) for t in own], atol=2e-5)


def test_long_texts_train_by_runs_of_their_words():
    text = " ".join(f"w{k}" for k in range(50_000)).encode()
    own = T.sampled(text).split()
    assert len(own) == T.MOST_WORDS and own[0] == b"w0" and own[-1] == b"w49999" and len(set(own)) == len(own)
    assert T.sampled(b"One, two!") == b"one two" and T.sampled(b"") == b""


def test_long_labelled_texts_count(spark):
    """All toxic rows are long ones; what marks them is all over them."""
    draw = random.Random(8)
    plain = ["".join(draw.choice("aeinrst") for _ in range(5)) for _ in range(200)]
    rows = [(k, " ".join("grolmax" if k % 2 and draw.random() < 0.3 else draw.choice(plain) for _ in range(6000 if k % 2 else 60)), k % 2) for k in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r["doc_id"]: r["predicted"] for r in T.toxicity(docs, spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")).collect()}
    assert sum(got[k] == y for k, _, y in rows) >= 58


def test_windows_cover_all_words():
    sizes = np.array([0, 1, 31, 32, 33, 48, 49, 200])
    starts, own = T.windows(sizes)
    begin = np.cumsum(sizes) - sizes
    for i, n in enumerate(sizes):
        at = starts[own == i] - begin[i]
        assert len(at) >= 1 and set(range(n)) <= {s + k for s in at for k in range(T.WINDOW)}
        assert (np.diff(at) == T.STRIDE).all()


def test_gradients_match_differences():
    model = T.Model.fresh({b"one": 1, b"two": 2})
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x = model.inputs([b"one", b"two", b"three"])[0].astype(np.float64)
    at = np.full((2, T.WINDOW), -1)
    at[0, :5], at[1, :3] = [0, 1, 2, 1, 0], [2, 2, 1]
    slope = np.array([0.7, -0.3])
    grad, dx = model.backward(x, at, model.forward(x, at, keep=True), slope)
    loss = lambda: float(model.forward(x, at) @ slope)
    for name, g in grad.items():
        flat = model.p[name].reshape(-1)
        k = int(np.abs(g).argmax())
        keep, base = flat[k], 1e-4
        flat[k] = keep + base
        up = loss()
        flat[k] = keep - base
        down = loss()
        flat[k] = keep
        assert abs((up - down) / (2 * base) - np.asarray(g).reshape(-1)[k]) < 2e-3 * max(1, abs(np.asarray(g).reshape(-1)[k])), name
    assert dx.shape == x.shape


def test_query(spark, documents, no_documents, texts):
    labels = spark.createDataFrame([(i, k % 2) for k, (i, _) in enumerate(texts) if i is not None] + [(None, 1), (5, None)], "doc_id long, toxic int")
    rows = T.toxicity(documents, labels).collect()
    assert len(rows) == len(texts) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows if r["doc_id"] is not None)
    assert T.toxicity(no_documents, labels).collect() == []
    none = T.toxicity(documents, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.0}


def test_labels_held_out_are_never_read(spark, documents, texts):
    """Turning the labels of the held-out rows changes no score."""
    rows = [(i, int(k % 3 == 0)) for k, (i, _) in enumerate(texts) if i is not None]
    turned = [(i, 1 - y if T.fold(i) == 0 else y) for i, y in rows]
    one, two = (sorted((str(r["doc_id"]), r["score"]) for r in T.toxicity(documents, spark.createDataFrame(own, "doc_id long, toxic int")).collect()) for own in (rows, turned))
    assert one == two


def test_pipeline_stage(spark, documents, texts, model):
    got = T.clean(documents, model)
    assert got.schema == documents.schema
    score = model.scores([(t or "").encode() for _, t in texts])
    assert sorted(str((r["doc_id"], r["text"])) for r in got.collect()) == sorted(str(t) for t, s in zip(texts, score) if s < 0.5)


def test_training_on_long_texts_holds_little_memory():
    """The words of a sample are never objects all at once: of 640,000 here, 131 bytes each before."""
    draw = random.Random(3)
    pool = ["".join(draw.choice("aeinrst") for _ in range(draw.randrange(2, 9))) for _ in range(20_000)]
    texts = [" ".join(draw.choices(pool, k=T.MOST_WORDS)).encode() for _ in range(200)]
    tracemalloc.start()
    T.train(texts, [k % 5 == 0 for k in range(200)], steps=2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 70 * 200 * T.MOST_WORDS
