import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from keyloom.llm import repeats


def brute(texts):
    raw = [(t or "").encode() for _, t in texts]
    seen = Counter(b[k : k + 200] for b in raw for k in range(len(b) - 199))
    out = []
    for (i, _), b in zip(texts, raw):
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((str(i), len(b), sum(gone), len(bytes(gone).split(b"\0")) - bytes(gone).split(b"\0").count(b""), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found(df):
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.without_repeats(df).collect())


def small(texts):
    return [(i, t[:40_000] if t else t) for i, t in texts]


@pytest.mark.parametrize("group", [8192, 2])
def test_matches_brute_force(spark, texts, group, monkeypatch, tmp_path):
    """With groups of two at most, all comparisons go string by string through the aggregation."""
    monkeypatch.setattr(repeats, "GROUP", group)
    rows = small(texts)
    draw = random.Random(2)
    passage = "".join(draw.choice("abcdefgh ") for _ in range(260))
    rows += [(400 + k, "".join(draw.choice("abcdefgh ") for _ in range(draw.randrange(0, 300))) + passage[: 180 + 10 * k] + "".join(draw.choice("xyz") for _ in range(30))) for k in range(9)]
    rows += [(500, "ab" * 400), (501, "x" * 199), (502, "x" * 200), (503, "y" * 200), (504, "y" * 200), (505, "é" * 150)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "t"))
    assert found(spark.read.parquet(str(tmp_path / "t"))) == brute(rows)


def test_columns_of_the_same_names_and_empty_tables(documents, no_documents):
    assert repeats.without_repeats(documents).columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert found(no_documents) == []


def test_long_texts_are_cut_without_loss(monkeypatch):
    draw = random.Random(5)
    text = "".join(draw.choice("abc ") for _ in range(5000)).encode()
    whole = {int(s) + k for s, n in zip(*repeats.parse([text])[1:3]) for k in range(n)}
    monkeypatch.setattr(repeats, "SEGMENT", 700)
    parts = [int(s) + k for s, n in zip(*repeats.parse([text])[1:3]) for k in range(n)]
    assert sorted(parts) == sorted(whole) == list(range(4801))


def test_hash_rolls():
    """Byte by byte, what leaves the window is taken out and what enters added; the window at the end runs into zeros."""
    draw = random.Random(6)
    data = bytes(draw.randrange(256) for _ in range(300))
    h, want, top = 0, [], pow(repeats.BASE, repeats.GRAM, 1 << 64)
    for k, b in enumerate(data + bytes(repeats.GRAM - 1)):
        h = (h * repeats.BASE + b - (data[k - repeats.GRAM] * top if k >= repeats.GRAM else 0)) % (1 << 64)
        if k >= repeats.GRAM - 1:
            want.append(h)
    assert repeats.rolling(np.frombuffer(data, np.uint8)).tolist() == want
