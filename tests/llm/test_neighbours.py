import numpy as np

from keyloom.llm import neighbours as N


def fixture(seed=3):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(8, 12))
    rows = [(k, draw.normal(size=12)) for k in range(200)]
    rows += [(300 + k, centres[k % 8] + draw.normal(size=12) * 0.12) for k in range(120)]
    rows += [(500 + k, rows[220][1]) for k in range(15)] + [(520, rows[220][1] * 3.0)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    return rows + [(600, None), (601, [0.0] * 12), (602, [float("nan")] + [1.0] * 11), (603, [None] + [1.0] * 11), (604, []), (605, [float("inf")] * 12), (700, [1.0, 2.0]), (701, [1.0, 2.01]), (300, rows[200][1]), (None, [5.0, -1.0]), (702, [5.0, -1.0])]


def brute(rows):
    good = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    parent, links = list(range(len(rows))), [0] * len(rows)
    pairs = []
    for a in good:
        for b in good:
            u, v = np.array(rows[a][1], float), np.array(rows[b][1], float)
            if a != b and len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.95:
                links[a] += 1
                pairs.append((a, b))
    for _ in range(20):
        for a, b in pairs:
            parent[a] = parent[b] = min(parent[a], parent[b])
    least = {}
    for k, p in enumerate(parent):
        if rows[k][0] is not None:
            least[p] = min(least.get(p, 1 << 60), rows[k][0])
    return sorted((str(rows[k][0]), links[k], str(least.get(parent[k]))) for k in range(len(rows)))


def test_matches_brute_force(spark):
    rows = fixture()
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, node string")
    for options in ({}, {"shards": 3, "shard": 50, "block": 60}):
        got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in N.near_duplicates(df, **options).collect())
        assert got == brute(rows)
    assert N.near_duplicates(df.limit(0)).collect() == []
    kept = N.near_duplicates(df).where("vec_id IS NOT NULL").collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in kept)


def test_recall_of_a_large_graph():
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(300, 32))
    x = N.unit(np.vstack([draw.normal(size=(3000, 32)), np.repeat(centres, 8, axis=0) + draw.normal(size=(2400, 32)) * 0.15]))
    graph = N.Graph(x)
    beam = N.widened(graph, 0.95)
    row, node = graph.within(x, 0.95, beam)
    truth = int((x @ x.T >= 0.95).sum())
    assert len(row) >= 0.98 * truth and len(row) <= truth
    assert ((x[row] * x[node]).sum(1) >= 0.95 - 1e-6).all()


def test_audit_widens_the_beam(monkeypatch):
    draw = np.random.default_rng(6)
    x = N.unit(np.repeat(draw.normal(size=(40, 8)), 30, axis=0) + draw.normal(size=(1200, 8)) * 0.05)
    graph = N.Graph(x, degree=2, beam=4)
    monkeypatch.setattr(N, "BEAM", 1)
    assert N.widened(graph, 0.95) != 1
    assert N.widened(graph, 0.95, recall=1.01, widest=4) == 0
    row, node = graph.within(x[:50], 0.95, 0)
    assert len(row) == (x[:50] @ x.T >= 0.95).sum() and ((x[row] * x[node]).sum(1) >= 0.95 - 1e-6).all()


def test_the_audit_sees_links_where_vectors_have_none(monkeypatch):
    """Queries made beside the vectors have a link each, so a poor graph does not pass at its first beam."""
    x = N.unit(np.random.default_rng(7).normal(size=(1500, 24)))
    assert (x @ x.T >= 0.95).sum() == len(x)
    made = N.beside(x, 0.95, 300)
    assert ((made @ x.T).max(1) >= 0.95 - 1e-5).all() and (made @ x.T < 1 - 1e-7).all()
    monkeypatch.setattr(N, "BEAM", 1)
    assert N.widened(N.Graph(x, degree=2, beam=2), 0.95) != 1


def test_copies_of_a_third_of_the_rows_stay_where_they_are(spark, monkeypatch):
    monkeypatch.setattr("keyloom.llm.common.HOT_ROWS", 5)
    rows = fixture()
    df = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<float>")
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in N.near_duplicates(df).collect()) == brute(rows)


def test_huge_and_tiny_components(spark):
    rows = [(1, [1e300, 1e300]), (2, [1.0, 1.0]), (3, [1e-300, 1e-300]), (4, [1.0, -1.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in N.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4)}
