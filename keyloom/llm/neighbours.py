"""Near-duplicate embeddings by hierarchical navigable small-world graphs, one per shard."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import by_key, components, cut, forest, hot_keys, scratch

THRESHOLD = 0.95
#: Vectors that a shard's graph holds about, and the fewest shards.
SHARD = 65_536
SHARDS = 2
#: Links of a node in a layer, and twice as many at the ground; beam while the graph is built; first beam of queries.
DEGREE = 12
BUILD_BEAM = 48
BEAM = 64
#: Audit: queries with links that are checked against brute force in each shard, of the graph's own vectors and of ones made
#: beside them; the most own vectors looked at for links; the mean share of a query's links to be found, and the widest beam.
AUDITED = 512
LOOKED_AT = 4096
RECALL = 0.995
WIDEST = 2048
#: Queries that walk a graph together, and queries that one task has about.
BLOCK = 1024
QUERIES = 16_384
#: What single precision may miss; double precision decides.
SLACK = 1e-5


def unit(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


class Graph:
    """Layers of links over unit vectors; nodes enter in blocks that double, each block searching the graph before it."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, seed: int = 1):
        self.x, self.degree = x, degree
        n = len(x)
        draw = np.random.default_rng(seed)
        self.level = np.minimum((-np.log(1 - draw.random(n)) / np.log(degree)).astype(int), 8)
        order = np.argsort(-self.level, kind="stable")
        self.entry = int(order[0])
        self.links = [np.full((n, degree * 2 if k == 0 else degree), -1, np.int32) for k in range(self.level[self.entry] + 1)]
        done = 1
        while done < n:
            block = order[done : done + max(1, min(done, BLOCK))]
            self._enter(block, beam)
            done += len(block)

    def _enter(self, block: np.ndarray, beam: int) -> None:
        own = self.x[block]
        at = np.full((len(block), 1), self.entry, np.int32)
        for layer in range(len(self.links) - 1, -1, -1):
            found, near = self._walk(own, at, layer, beam if (self.level[block] >= layer).any() else 1)
            here = self.level[block] >= layer
            # nodes of one block see each other too
            inside = own[here] @ own[here].T
            np.fill_diagonal(inside, -2)
            k = min(self.degree * 2, inside.shape[1])
            best = np.argpartition(-inside, k - 1, axis=1)[:, :k] if k else np.zeros((0, 0), int)
            ids = np.hstack([found[here], block[here][best].astype(np.int32)])
            sims = np.hstack([near[here], np.take_along_axis(inside, best, 1)])
            ids = np.where(sims > -1.5, ids, -1)
            self._choose(block[here], ids, sims, layer)
            at = found[:, :beam]

    def _choose(self, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray, layer: int) -> None:
        """Link nodes to diverse near ones: a candidate nearer to a chosen link than to the node comes last."""
        links = self.links[layer]
        order = np.argsort(-sims, axis=1, kind="stable")[:, : 3 * self.degree]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        picked = self._diverse(ids, sims, self.degree)
        links[nodes[:, None], np.arange(picked.shape[1])] = picked
        source = np.repeat(nodes, picked.shape[1])
        target = picked.ravel()
        live = target >= 0
        back = pd.DataFrame({"to": target[live], "from": source[live].astype(np.int32)}).drop_duplicates()
        if back.empty:
            return
        back = back.sort_values("to", kind="stable")
        to, start, count = np.unique(back["to"].to_numpy(), return_index=True, return_counts=True)
        width = int(count.max())
        new = np.full((len(to), width), -1, np.int32)
        new[np.repeat(np.arange(len(to)), count), np.arange(len(back)) - np.repeat(start, count)] = back["from"]
        for i in range(0, len(to), BLOCK):
            t = to[i : i + BLOCK]
            both = np.hstack([links[t], new[i : i + BLOCK]])
            both = np.sort(both, axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            near = np.where(both >= 0, np.einsum("nkd,nd->nk", self.x[both], self.x[t]), -2)
            order = np.argsort(-near, axis=1, kind="stable")[:, : max(links.shape[1], 3 * self.degree)]
            both, near = np.take_along_axis(both, order, 1), np.take_along_axis(near, order, 1)
            kept = self._diverse(both, near, links.shape[1])
            links[t[:, None], np.arange(links.shape[1])] = -1
            links[t[:, None], np.arange(kept.shape[1])] = kept

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        out = np.full((len(ids), min(most, ids.shape[1])), -1, np.int32)
        for i in range(0, len(ids), BLOCK):
            own, near = ids[i : i + BLOCK], sims[i : i + BLOCK]
            v = self.x[own]
            among = np.einsum("nkd,njd->nkj", v, v)
            chosen = np.zeros(own.shape, bool)
            for k in range(own.shape[1]):
                shadowed = (chosen[:, :k] & (among[:, k, :k] > near[:, k, None])).any(1) if k else np.zeros(len(own), bool)
                chosen[:, k] = (own[:, k] >= 0) & ~shadowed
            # the diverse ones first, then the nearest of the rest
            rank = np.where(own < 0, 3, np.where(chosen, 1, 2)) * own.shape[1] + np.arange(own.shape[1])
            order = np.argsort(rank, axis=1)[:, : out.shape[1]]
            out[i : i + BLOCK] = np.where(np.take_along_axis(own, order, 1) >= 0, np.take_along_axis(own, order, 1), -1)
        return out

    def _walk(self, q: np.ndarray, at: np.ndarray, layer: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities), best first, of up to `beam` nodes near each query, from the nodes `at`."""
        links = self.links[layer]
        ids = at[:, :beam].astype(np.int32)
        sims = np.where(ids >= 0, np.einsum("nkd,nd->nk", self.x[ids], q), -2).astype(np.float32)
        if ids.shape[1] < beam:
            pad = beam - ids.shape[1]
            ids, sims = np.pad(ids, ((0, 0), (0, pad)), constant_values=-1), np.pad(sims, ((0, 0), (0, pad)), constant_values=-2)
        open_ = ids >= 0
        live = np.arange(len(q))
        while len(live):
            s, i, o = sims[live], ids[live], open_[live]
            best = np.where(o, s, -3)
            pick = best.argmax(1)
            go = np.take_along_axis(best, pick[:, None], 1)[:, 0] > -2.5
            live, s, i, o, pick = live[go], s[go], i[go], o[go], pick[go]
            if not len(live):
                break
            rows = np.arange(len(live))
            o[rows, pick] = False
            fresh = links[i[rows, pick]]
            known = (fresh[:, :, None] == i[:, None, :]).any(2) | (fresh < 0)
            near = np.where(known, -2, np.einsum("nkd,nd->nk", self.x[fresh], q[live])).astype(np.float32)
            s, i, o = np.hstack([s, near]), np.hstack([i, np.where(known, -1, fresh)]), np.hstack([o, ~known])
            keep = np.argpartition(-s, beam - 1, axis=1)[:, :beam]
            sims[live], ids[live], open_[live] = (np.take_along_axis(a, keep, 1) for a in (s, i, o))
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def within(self, q: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs with similarity of `least` or more: the beam's, and what links reach from those.

        Beam 0 stands for a graph that no beam was wide enough for: all nodes are compared.
        """
        if not beam:
            step = max(1, (1 << 24) // len(self.x))
            found = [np.nonzero(q[k : k + step] @ self.x.T >= least) for k in range(0, len(q), step)]
            return np.concatenate([np.zeros(0, np.int64), *[a + k * step for k, (a, _) in enumerate(found)]]), np.concatenate([np.zeros(0, np.int64), *[b for _, b in found]])
        at = np.full((len(q), 1), self.entry, np.int32)
        for layer in range(len(self.links) - 1, 0, -1):
            at = self._walk(q, at, layer, 4)[0]
        ids, sims = self._walk(q, at, 0, beam)
        row, col = np.nonzero(sims >= least)
        n = np.int64(len(self.x))
        edge = row * n + ids[row, col]
        seen = np.unique(edge)
        edge = seen
        while len(edge):
            row = np.repeat(edge // n, self.links[0].shape[1])
            node = self.links[0][edge % n].ravel().astype(np.int64)
            keys = np.unique(row[node >= 0] * n + node[node >= 0])
            keys = keys[~np.isin(keys, seen, assume_unique=True)]
            near = np.einsum("kd,kd->k", self.x[keys % n], q[keys // n])
            edge = keys[near >= least]
            seen = np.union1d(seen, edge)
        return seen // n, seen % n


def _true(x: np.ndarray, q: np.ndarray, least: float) -> list[np.ndarray]:
    """For each query the nodes with similarity of `least` or more, by comparing all."""
    step = max(1, (1 << 24) // len(x))
    out: list[np.ndarray] = []
    for k in range(0, len(q), step):
        row, node = np.nonzero(q[k : k + step] @ x.T >= least)
        out += np.split(node, np.cumsum(np.bincount(row, minlength=len(q[k : k + step])))[:-1])
    return out


def beside(x: np.ndarray, least: float, many: int, seed: int = 5) -> np.ndarray:
    """Unit vectors that are none of x, each with a similarity from `least` to 1 to one of them."""
    draw = np.random.default_rng(seed)
    base = x[draw.choice(len(x), min(many, len(x)), replace=False)].astype(np.float64)
    turn = draw.normal(size=base.shape)
    turn -= (turn * base).sum(1, keepdims=True) * base
    turn /= np.linalg.norm(turn, axis=1, keepdims=True) + 1e-30
    near = draw.uniform(min(1.0, least + 1e-4), 1.0, len(base))[:, None]
    return unit(near * base + np.sqrt(1 - near**2) * turn)


def widened(graph: Graph, least: float, audited: int = AUDITED, recall: float = RECALL, widest: int = WIDEST) -> int:
    """The first beam, doubling from BEAM, whose queries find the wanted share of their links, each query counting alike.

    Two samples must pass: up to `audited` of the graph's own vectors that have links besides themselves, sought among LOOKED_AT
    at most, and as many vectors made beside ones of the graph, which stand for queries of other shards and have a link each, so
    the audit is never without links. 0, which compares all, if the widest beam does not pass either.
    """
    n = len(graph.x)
    order = np.random.default_rng(5).permutation(n)[:LOOKED_AT]
    own: list[tuple[int, np.ndarray]] = []
    for k in range(0, len(order), audited):
        some = order[k : k + audited]
        own += [(int(i), t[t != i]) for i, t in zip(some, _true(graph.x, graph.x[some], least)) if len(t) > 1]
        if len(own) >= audited:
            break
    own = own[:audited]
    made = beside(graph.x, least, audited)
    samples = [(graph.x[[i for i, _ in own]], [t for _, t in own], np.array([i for i, _ in own])), (made, _true(graph.x, made, least), np.full(len(made), -1))]

    def passes(q: np.ndarray, truth: list[np.ndarray], self_: np.ndarray, beam: int) -> bool:
        size = np.array([len(t) for t in truth])
        if not size.any():
            return True
        row, node = graph.within(q, least, beam)
        got = np.bincount(row[node != self_[row]], minlength=len(q))
        return float((got[size > 0] / size[size > 0]).mean()) >= recall

    beam = BEAM
    while beam <= widest:
        if all(passes(*s, min(beam, n)) for s in samples):
            return min(beam, n)
        beam *= 2
    return 0


def scaled(raw: np.ndarray) -> np.ndarray:
    """Vectors in double precision, each scaled by a power of two, which leaves cosines as they are and keeps squares in range."""
    raw = raw.astype(np.float64)
    return np.ldexp(raw, -np.frexp(np.abs(raw).max(axis=1))[1][:, None])


def build(shard: pd.DataFrame) -> pd.DataFrame:
    """One row: the shard's vectors, ids and copies, its graph, and the beam that its audit asks for."""
    shard = shard.sort_values("node")
    raw = np.stack(shard["embedding"].to_list())
    graph = Graph(unit(scaled(raw)))
    least = THRESHOLD - SLACK
    held = {"raw": raw, "links": graph.links, "entry": graph.entry, "level": graph.level, "node": shard["node"].to_numpy(), "copies": shard["copies"].to_numpy(), "beam": widened(graph, least)}
    return pd.DataFrame({"shard": shard["shard"].iloc[:1].to_numpy(), "graph": [pickle.dumps(held, protocol=5)]})


def search(paths: dict[str, list[str]]):
    """A function of batches (size, node, embedding), the queries of one task, over the graphs of each number of components.

    It gives rows (a, b, links): a query and how many vectors of one shard it links with, b null; or a link of a spanning forest
    of those. Each task holds its queries and reads one graph after the other from the shared folder.
    """

    def linked(held: dict, own: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
        graph = Graph.__new__(Graph)
        exact = scaled(held["raw"])
        graph.x, graph.links, graph.entry, graph.level = unit(exact), held["links"], held["entry"], held["level"]
        exact /= np.linalg.norm(exact, axis=1, keepdims=True)
        ids, copies = held["node"], held["copies"]
        for i in range(0, len(own), BLOCK):
            row, node = graph.within(q[i : i + BLOCK].astype(np.float32), THRESHOLD - SLACK, held["beam"])
            true = np.concatenate([np.einsum("kd,kd->k", q[i + row[k : k + 65536]], exact[node[k : k + 65536]]) >= THRESHOLD for k in range(0, len(row), 65536)] or [np.zeros(0, bool)])
            row, node = row[true], node[true]
            other = own[i + row] != ids[node]
            row, node = row[other], node[other]
            count = np.bincount(row, weights=copies[node], minlength=len(own[i : i + BLOCK])).astype(np.int64)
            some = np.flatnonzero(count)
            u, v = forest(own[i + row], ids[node])
            a, b = np.concatenate([own[i + some], u]), pa.array([None] * len(some) + v.tolist(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), b, pa.array(count[some].tolist() + [None] * len(u), pa.int64())], names=["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            sizes, nodes, vectors = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                raw = vectors.take(pa.array(at)).flatten().to_numpy().reshape(-1, size)
                queries.setdefault(int(size), []).append((nodes[at], raw))
        for size in sorted(queries):
            parts = queries.pop(size)
            own, q = np.concatenate([a for a, _ in parts]), scaled(np.concatenate([b for _, b in parts]))
            q /= np.linalg.norm(q, axis=1, keepdims=True)
            for path in paths.get(str(size), ()):
                files, at = pa.fs.FileSystem.from_uri(path)
                for graph in pa.parquet.read_table(at, filesystem=files, columns=["graph"], partitioning=None).column(0):
                    yield from linked(pickle.loads(graph.as_py()), own, q)

    return run


def near_duplicates(vectors: DataFrame, shards: int = SHARDS, shard: int = SHARD, block: int = QUERIES) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding); see THRESHOLD.

    Equal vectors are one node of a graph, named by the smallest vec_id and weighted by their number. Nodes are dealt to shards
    by a hash, whose graphs are written to the shared folder once; every node then queries the graph of every shard: a task keeps
    about `block` queries and reads the graphs in turn. So each vector is shuffled once for its graph and once for its block,
    while the walks, and what tasks read, grow as nodes times shards, as querying every shard implies. A graph's audit widens its
    beam until a sample of its links against brute force is found. Links are verified in double precision.

    A null vector, a zero one, and one with null or non-finite components link with nothing: n_links 0, component_id its own
    vec_id. Vectors of another number of components are compared among themselves. Rows that repeat link with each other; rows
    with a null vec_id count as links and get the component_id of their group. Other columns are left out; an empty table gives
    no rows.
    """
    spark = vectors.sparkSession
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"  # floats move as they are
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = F.coalesce(F.col("embedding").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    marked = plain.select("vec_id", F.when(good, F.transform("embedding", lambda x: (x + F.lit(0.0)).cast(kind))).alias("key"))
    distinct = marked.where("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    nodes = cut(distinct.select(F.monotonically_increasing_id().alias("row"), F.col("key").alias("embedding"), "first", "copies").withColumn("node", F.coalesce("first", -F.col("row") - 1)))
    n, whole = nodes.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    many, blocks = max(shards, -(-n // shard)), max(1, -(-n // block))
    size = F.size("embedding").alias("size")
    dealt = F.concat_ws(".", F.size("embedding"), F.pmod(F.xxhash64("node"), F.lit(many))).alias("shard")
    graphs = nodes.select(dealt, "node", "embedding", "copies").groupBy("shard").applyInPandas(build, "shard string, graph binary")
    folder = scratch(spark, "graphs")
    graphs.select(F.substring_index("shard", ".", 1).alias("size"), F.col("shard").alias("of"), "graph").write.mode("overwrite").partitionBy("size", "of").parquet(folder)
    paths: dict[str, list[str]] = {}
    if n:
        # one path a shard
        for r in spark.read.parquet(folder).select(F.col("size").cast("string").alias("size"), F.col("_metadata.file_path").alias("path")).distinct().collect():
            paths.setdefault(r["size"], []).append(r["path"])
    asked = nodes.select(size, "node", "embedding").repartition(blocks, "node")
    found = cut(asked.mapInArrow(search({k: sorted(v) for k, v in paths.items()}), "a long, b long, links long"))
    links = found.where("b IS NULL").groupBy("a").agg(F.sum("links").alias("links"))
    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    named = nodes.join(links, nodes.node == links.a, "left").join(roots.withColumnRenamed("node", "own"), nodes.node == F.col("own"), "left")
    named = cut(named.select("embedding", "first", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")))
    largest = hot_keys(named.groupBy("root").agg(F.count("*").alias("held")), "root", "held", n)
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = by_key(named, least, "root", largest).select(F.col("embedding").alias("key"), "n_links", F.col("component_id").alias("of"))
    copied = hot_keys(nodes.withColumnRenamed("embedding", "key"), "key", "copies", whole)
    linked = by_key(marked.where("key IS NOT NULL"), classes, "key", copied).select("vec_id", F.col("n_links").cast("long").alias("n_links"), F.coalesce("of", "vec_id").alias("component_id"))
    alone = marked.where("key IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
