import random
import zlib
from collections import Counter

import numpy as np
import pytest

from keyloom.llm import packing as P


def want(texts, limit=2048):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for i, text in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % limit or limit
        for k, start in enumerate([0, *range(first, len(ids), limit)]):
            part = ids[start : first if k == 0 else start + limit]
            out.append((str(i), k, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return sorted(out)


def check_layout(rows, limit=2048):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        own.sort()
        at = 0
        for offset, length in own:
            assert offset == at
            at += length
        assert at <= limit
    return len(by)


@pytest.mark.parametrize("ranked", [20_000, 3])
def test_pieces_and_places(documents, texts, no_documents, monkeypatch, ranked):
    monkeypatch.setattr(P, "RANKED", ranked)
    rows = P.packed(documents).collect()
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want(texts)
    bins, least = check_layout(rows), -(-sum(r["length"] for r in rows) // 2048)
    assert bins <= least + 2
    assert P.packed(no_documents).collect() == []


def test_special_tokens_and_odd_texts(spark):
    texts = [(1, "a<|endoftext|>b"), (6, "<|endoftext|><|endoftext|> <|endoftext|"), (7, " <|endoftext|>\n" * 3), (2, "\u0000� \r\n\t  　x"), (3, "naïve 漢字 😀" * 50), (4, "don't we'll I'M 12345 ..."), (5, " " * 5000)]
    got = P.pieces(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want(texts)


@pytest.mark.parametrize("draw", [lambda r: r.randint(1, 100), lambda r: r.randint(30, 60), lambda r: min(100, int(r.lognormvariate(3, 1)) + 1), lambda r: r.choice([34, 33, 50, 51, 7])])
def test_local_search_loses_nothing_and_never_gets_worse(draw):
    rnd = random.Random(1)
    for n in (0, 1, 7, 60, 900):
        counts = Counter(draw(rnd) for _ in range(n))
        first = P.best_fit(counts, 100)
        bins = P.local_search(first, 100)
        held = Counter()
        for own, m in bins.items():
            assert P.total(own) <= 100
            for x, k in own:
                held[x] += k * m
        assert held == counts and sum(bins.values()) <= sum(first.values())


def test_exchanges_empty_bins():
    """Best fit would leave three bins; a swap of one for one, two for one, or a move, makes them two."""
    for start in ([(6, 3), (4, 4), (3,)], [(5, 4), (3, 3, 3), (1, 1)], [(7, 2), (5, 4), (1, 1)]):
        bins = Counter(tuple(sorted(Counter(own).items())) for own in start)
        after = P.local_search(bins, 10)
        assert sum(after.values()) == 2 and all(P.total(b) <= 10 for b in after)


def test_givers_beyond_the_emptiest():
    """Eight kinds of emptier bins gain nothing from each other or from the rest; six bins of small items do."""
    singles = [((x, 1),) for x in range(51, 59)]
    bins = P.local_search(Counter(singles) + Counter({((9, 7),): 6}), 100)
    assert sum(bins.values()) < len(singles) + 6 and all(P.total(b) <= 100 for b in bins)
    assert sum(x * k * n for b, n in bins.items() for x, k in b) == sum(range(51, 59)) + 6 * 63


def gains(bins, limit):
    """Whether any move, or swap of one or two for one, from a bin to one at least as full gains."""
    kinds = [(k, n) for k, n in bins.items() if P.total(k) < limit]
    for b, n in kinds:
        single, double = P.takings(b)
        for a, _ in kinds:
            if P.total(a) < P.total(b) or (a == b and n < 2):
                continue
            room = limit - P.total(a)
            if any(0 < s - y <= room for s in single | double for y in (0, *(x for x, _ in a))):
                return True
    return False


@pytest.mark.parametrize(("low", "high", "n"), [(30, 55, 300), (20, 45, 300), (1, 99, 200), (26, 40, 60)])
def test_the_search_ends_where_nothing_gains(low, high, n):
    rnd = random.Random(low)
    first = P.best_fit(Counter(rnd.randint(low, high) for _ in range(n)), 100)
    bins = P.local_search(first, 100)
    least = -(-sum(P.total(k) * m for k, m in bins.items()) // 100)
    assert sum(bins.values()) == least or not gains(bins, 100)


def test_large_histograms_are_packed_in_parts():
    rnd = random.Random(7)
    counts = Counter({k: rnd.randint(0, 10**9) for k in range(20, 90)})
    bins = P.plan(counts, 100, most=5000)
    held = Counter()
    for own, m in bins.items():
        assert P.total(own) <= 100
        for x, k in own:
            held[x] += k * m
    assert held == Counter({k: n for k, n in counts.items() if n})
    small = P.plan(Counter({k: n // 10**5 for k, n in counts.items()}), 100)
    assert sum(bins.values()) < 1.005 * 10**5 * (sum(small.values()) + 1)


def test_one_search_goes_over_all_lengths_whatever_their_number():
    counts = {k: 20_000 + k % 7 for k in range(600, 1101)}
    bins = P.plan(counts)
    assert sum(counts.values()) > 10**7 and bins == P.local_search(P.best_fit(counts))
    held = Counter()
    for own, m in bins.items():
        for x, k in own:
            held[x] += k * m
    assert held == counts
