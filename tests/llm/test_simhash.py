import re
from collections import Counter

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from keyloom.llm import common, simhash


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles(text, n):
    w = words(text)
    return [" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))] if w else []


def fingerprint(text):
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text, 3)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closed(n, linked):
    parent = list(range(n))
    for _ in range(n):
        for a, b in linked:
            parent[a] = parent[b] = min(parent[a], parent[b])
    return parent


def test_components_match_brute_force(documents, texts):
    prints = [fingerprint(t) for _, t in texts]
    linked = [(a, b) for a in range(len(texts)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]
    parent = closed(len(texts), linked)
    least = {}
    for k, p in enumerate(parent):
        if texts[k][0] is not None:
            least[p] = min(least.get(p, 1 << 60), texts[k][0])
    want = sorted((str(texts[k][0]), f"{prints[k]:016x}", str(least.get(parent[k]))) for k in range(len(texts)))
    got = sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in simhash.near_duplicates(documents).collect())
    assert got == want


def test_empty_table(no_documents):
    assert simhash.near_duplicates(no_documents).collect() == []
    assert simhash.representatives(no_documents).columns == no_documents.columns


def test_every_distance_up_to_three_is_found(spark):
    draw = np.random.default_rng(1)
    base = int(draw.integers(0, 1 << 62))
    flips = [(), (0,), (31,), (32,), (63,), (1, 33), (2, 3), (40, 41), (5, 6, 50), (7, 60, 61), (8, 9, 10), (50, 51, 52), (1, 2, 3, 4)]
    values = [np.array([sum({1 << b for b in f}) ^ base], np.uint64).view(np.int64)[0].item() for f in flips]
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    got = {(r["a"], r["b"]) for r in simhash.links(df).collect()}
    unsigned = lambda v: v & (1 << 64) - 1
    assert got == {(min(a, b), max(a, b)) for a in values for b in values if a != b and (unsigned(a) ^ unsigned(b)).bit_count() <= 3}


def test_values_of_many_fingerprints_are_split(spark, monkeypatch):
    """All share the upper segment, or lie one bit from it; the pairs are those of all against all."""
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    draw = np.random.default_rng(4)
    base = draw.integers(0, 1 << 20, 150).astype(np.uint64)
    values = np.unique(np.concatenate([base | np.uint64(7 << 32), base ^ np.uint64(1 << 3) | np.uint64(7 << 32), base | np.uint64(5 << 32), draw.integers(0, 1 << 63, 50).astype(np.uint64)]))
    far = np.bitwise_count(values[:, None] ^ values[None, :])
    want = {tuple(sorted((int(values.view(np.int64)[i]), int(values.view(np.int64)[j])))) for i, j in zip(*np.nonzero(far <= 3)) if i < j}
    got = [(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")).collect()]
    assert set(got) == want and len(want) > 200 and max(Counter(got).values()) <= 2  # once a segment


def test_pipeline_stage_keeps_one_of_each_group(documents, texts):
    sets = [set(shingles(t, 5)) for _, t in texts]
    linked = [(a, b) for a in range(len(texts)) for b in range(a) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    parent = closed(len(texts), linked)
    groups = {}
    for k, p in enumerate(parent):
        groups.setdefault(p, []).append(texts[k])
    want = sorted(str(min(g, key=lambda r: (r[0] is None, r[0]))) for g in groups.values())
    got = simhash.representatives(documents)
    assert got.columns == documents.columns
    assert sorted(str((r["doc_id"], r["text"])) for r in got.collect()) == want


def kept(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "docs"))
    return {r["doc_id"] for r in simhash.representatives(spark.read.parquet(str(tmp_path / "docs"))).collect()}


def test_views_are_independent():
    """Ten independent samples miss (1 - 0.8 ** 4) ** 10 = 0.5 % of the pairs at 0.8."""
    draw = np.random.default_rng(3)
    missed = 0
    for _ in range(4000):
        both, a, b = (draw.integers(0, 1 << 64, n, dtype=np.uint64) for n in (400, 50, 50))
        missed += not (simhash.views(np.append(both, a)) == simhash.views(np.append(both, b))).any()
    assert missed < 0.012 * 4000


def test_parities_never_say_more_than_the_difference():
    draw = np.random.default_rng(6)
    for n in (0, 1, 40, 500):
        both, a, b = (np.unique(draw.integers(0, 1 << 32, k, dtype=np.uint64)).astype("<u4") for k in (n, n // 5, n // 7))
        one, two = np.union1d(both, a), np.union1d(both, b)
        bits = [np.unpackbits(np.frombuffer(simhash.parities(x), np.uint8)) for x in (one, two)]
        assert len(bits[0]) == simhash.PARITY and (bits[0] != bits[1]).sum() <= len(np.setxor1d(one, two))


def test_sketches_never_say_more_than_the_difference_and_tell_large_sets_apart():
    draw = np.random.default_rng(8)
    for n, more, less in [(0, 0, 0), (3, 1, 0), (200, 80, 10), (1000, 100, 3), (2040, 20, 2), (900, 4000, 1)]:
        both, a, b = (np.unique(draw.integers(0, 1 << 32, k, dtype=np.uint64)).astype("<u4") for k in (n, more, less))
        one, two = np.union1d(both, a), np.union1d(both, b)
        assert simhash.apart(simhash.sketch(one), simhash.sketch(two)) == simhash.apart(simhash.sketch(two), simhash.sketch(one)) <= len(np.setxor1d(one, two))
    assert simhash.apart(simhash.parities(one, 4096), simhash.parities(one, 256)) == 0
    both, a, b = (draw.integers(0, 1 << 32, k).astype("<u4") for k in (2000, 1000, 1000))  # half of the union is shared
    allowed = (1 - 0.8) / 1.8 * 6000
    assert simhash.apart(simhash.sketch(np.append(both, a)), simhash.sketch(np.append(both, b))) > allowed > simhash.PARITY


def test_marked_rows_are_those_of_the_numbers(spark):
    draw = np.random.default_rng(9)
    numbers = [int(x) for x in draw.integers(0, 9000, 3000)] + [(5 << 33) + int(x) for x in draw.integers(0, 9000, 100)]
    wanted = [int(x) for x in draw.choice(numbers, 700)] + [63, 64, 4095, 4096, (5 << 33) + 8999, 7 << 33]
    rows = spark.createDataFrame([(x, "b", "w") for x in numbers], "n long, Block string, words string")
    got = common.marked(rows, "n", spark.createDataFrame([(x,) for x in wanted], "n long"))
    assert got.columns == rows.columns and sorted(r["n"] for r in got.collect()) == sorted(x for x in numbers if x in set(wanted))
    assert common.marked(rows, "n", spark.createDataFrame([], "n long")).count() == 0


def test_kept_rows_are_not_shuffled(spark, documents):
    """Whole documents in a join by key were more bytes than the input holds compressed."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = simhash.representatives(documents)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_texts_that_are_not_compared_do_not_move(spark, tmp_path, monkeypatch):
    """Of 120 texts, four pairs are alike; no other text is compressed for a shuffle."""
    seen, squeeze = str(tmp_path / "seen"), simhash.squeeze

    def counted(batches):
        for batch in squeeze(batches):
            with open(seen, "a") as out:
                out.write("x" * len(batch))
            yield batch

    monkeypatch.setattr(simhash, "squeeze", counted)
    own = [" ".join(f"t{k}w{j}" for j in range(60)) for k in range(116)]
    assert kept(spark, tmp_path, list(enumerate(own + [t + " end" for t in own[:4]]))) == set(range(116))
    with open(seen) as found:
        assert len(found.read()) == 8


def test_pairs_of_short_texts(spark, tmp_path):
    """Four shingles against five: 0.8, at which a tenth of the pairs share no view."""
    texts = [" ".join(f"s{k}w{j}" for j in range(8 + more)) for k in range(150) for more in (0, 1)]
    assert kept(spark, tmp_path, list(enumerate(texts))) == set(range(0, 300, 2))


def test_pairs_beside_a_shared_passage(spark, tmp_path, monkeypatch):
    """All texts share 280 words; two of each pair share 80 more and differ in 40: a pair's similarity is 0.81, others' 0.5."""
    monkeypatch.setattr(simhash, "SAMPLED", 4)
    monkeypatch.setattr(simhash, "SHARE", 20)
    block = [f"b{k}" for k in range(280)]
    texts = [" ".join([*block, *[f"p{k}x{j}" for j in range(80)], *[f"o{k}x{side}x{j}" for j in range(40)]]) for k in range(100) for side in (0, 1)]
    a, b = (set(shingles(t, 5)) for t in texts[:2])
    assert 0.8 <= len(a & b) / len(a | b) < 0.83
    assert kept(spark, tmp_path, list(enumerate(texts))) == set(range(0, 200, 2))


def test_screens_never_say_more_than_the_difference():
    draw = np.random.default_rng(11)
    sets = [np.unique(draw.integers(0, 1 << 32, n, dtype=np.uint64)).astype("<u4") for n in (0, 1, 40, 256, 257, 513, 1024, 1025, 3000)]
    sets += [np.union1d(x, sets[2]) for x in sets]
    held = np.array([len(x) for x in sets])
    bits = np.frombuffer(b"".join(simhash.screen(simhash.sketch(x)) for x in sets), np.uint8).reshape(len(sets), -1)
    i, j = (x.ravel() for x in np.indices((len(sets),) * 2))
    for a, b, far in zip(i, j, simhash.screened(simhash.folds(bits, held), held, i, j).tolist()):
        assert far <= len(np.setxor1d(sets[a], sets[b]))
        if max(held[a], held[b]) <= simhash.SCREEN:
            assert far == simhash.apart(simhash.sketch(sets[a]), simhash.sketch(sets[b]))


def test_texts_beside_a_large_group_meet_few_of_its_pairs(spark, tmp_path, monkeypatch):
    """300 texts of one edited word and 60 of 14 edited ones, which link with some one in twenty of the others: all are one group or few."""
    draw, asked, likely = np.random.default_rng(12), [], simhash._likely

    def counted(pairs, *rest):
        asked.append(pairs.count())
        return likely(pairs, *rest)

    monkeypatch.setattr(simhash, "_likely", counted)
    base = [f"w{k}" for k in range(170)]
    rows = []
    for k, n in enumerate([1] * 300 + [14] * 60):
        at = int(draw.integers(0, 170 - n))
        rows.append((k, " ".join([*base[:at], *[f"e{k}x{j}" for j in range(n)], *base[at + n :]])))
    sets = [set(shingles(t, 5)) for _, t in rows]
    parent = closed(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    assert kept(spark, tmp_path, rows) == set(parent)
    assert sum(asked[1:]) < 60 * 300 / 4, asked


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 15), st.integers(0, 15)), max_size=25))
def test_forests_keep_components(pairs):
    u, v = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
    parent = closed(16, [p for p in pairs for _ in range(1)])
    node, root = common.forest(u, v)
    found = dict(zip(node.tolist(), root.tolist()))
    assert all(found.get(k, k) == parent[k] for k in range(16))


def test_components_of_long_chains(spark):
    links = spark.range(200).selectExpr("id AS a", "id + 1 AS b").union(spark.createDataFrame([(500, 400), (400, 300), (7, 7), (None, 1)], "a long, b long")).repartition(7)
    got = {r["node"]: r["root"] for r in common.components(links).collect()}
    assert got == {k: 0 for k in range(201)} | {300: 300, 400: 300, 500: 300}
    assert common.components(links.limit(0)).collect() == []


def test_what_an_explode_makes_is_never_broadcast(spark):
    """Probes are 33 times their fingerprints, which Spark doesn't reckon with; only hot values, which are asked for, may be broadcast."""
    prints = spark.createDataFrame([(k * k * 7919,) for k in range(50)], "fp long")
    found = simhash.links(prints)
    found.collect()
    joins = re.findall(r"(BroadcastHashJoin|SortMergeJoin) (\[.*?\])", found._jdf.queryExecution().executedPlan().toString())
    assert any("byte" in keys for _, keys in joins)
    assert all(kind == "SortMergeJoin" for kind, keys in joins if "byte" in keys)
    edges = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    kept = common.by_key(edges, edges.groupBy("a").agg(F.max("b").alias("most")), "a", edges.select("a").where("a > 1"))
    assert sorted(map(tuple, kept.collect())) == [(1, 2, 2), (2, 3, 3)]
    assert "SortMergeJoin" in kept._jdf.queryExecution().executedPlan().toString()
