"""Near-duplicate documents by SimHash and multi-index hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import by_key, components, cut, free_name, hot_keys, marked, shuffled, squeeze, text_batches, unpacked

SEED = 42
BITS = 64
#: Bits of each of the two fingerprint segments. Three differing bits leave one segment with at most one of them.
SEGMENT = 32
RADIUS = 1

#: _SET[b, i] is bit i of byte b.
_SET = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of each run of `width` words of the ASCII-lower-cased text, repeats included; of all words where there are fewer."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    flat = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(flat, SEED)], np.uint64)
    step = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(step) - 1
    begins = (ends - step + 1)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(flat[i:j], SEED) for i, j in zip(begins, ends[width - 1 :].tolist())), np.uint64, len(begins))


def fingerprints(texts: list[bytes], width: int = 3) -> np.ndarray:
    """A signed 64-bit fingerprint per text: a bit is 1 if it is set in over half of the hashes; 0 without words."""
    hashes = [shingle_hashes(x, width) for x in texts]
    sizes = np.array([len(x) for x in hashes], np.int64)
    out = np.zeros(len(texts), np.uint64)
    for first in range(0, len(texts), 64):
        own = hashes[first : first + 64]
        raw = np.concatenate(own).view(np.uint8).reshape(-1, 8)
        base = np.repeat(np.arange(len(own)), sizes[first : first + 64]) * 256
        for k in range(8):
            counts = np.bincount(base + raw[:, k], minlength=256 * len(own)).reshape(-1, 256) @ _SET
            bits = counts * 2 > sizes[first : first + 64, None]
            out[first : first + 64] |= np.packbits(bits, axis=1, bitorder="little")[:, 0].astype(np.uint64) << np.uint64(8 * k)
    return out.view(np.int64)


def fingerprint(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_batches(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(fingerprints(texts, width))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def links(distinct: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs (a, b), a below b, of distinct fingerprints that differ in at most `distance` bits, 3 at most.

    Every fingerprint lies in a table under the value of each segment, and probes that table with its own segment value and
    with the values one bit above it. Of two segments that differ in one bit, one probes the other, so a pair meets in a
    segment once. The join itself verifies the whole distance.

    A segment value of many fingerprints would be one task's work, of the square of their number. Within such values the other
    segment falls into four bytes: at most three bits differ in it, so a pair agrees in one of them, and meets there, in
    the first byte that agrees. Those values are at most HOT a segment, and so broadcast.
    """
    if not 0 <= distance <= 2 * RADIUS + 1:
        raise ValueError("two segments of radius 1 find distances up to 3")
    low = F.col("fp").bitwiseAND(F.lit((1 << SEGMENT) - 1))
    high = F.shiftrightunsigned("fp", SEGMENT)
    one = lambda k, own, rest: F.struct(F.lit(k).alias("segment"), own.alias("value"), rest.alias("rest"))
    segments = distinct.select("fp", F.explode(F.array(one(0, low, high), one(1, high, low))).alias("s")).select("fp", "s.*")
    full = segments.groupBy("segment", "value").agg(F.count("*").alias("held"))
    hot = F.broadcast(hot_keys(full, ["segment", "value"], "held", distinct.count()).withColumn("hot", F.lit(True)))  # 2 * HOT rows at most
    split = lambda rest: F.when(F.col("hot"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: F.struct(j.alias("part"), F.call_function("shiftright", rest, (j * 8).cast("int")).bitwiseAND(F.lit(255)).alias("byte")))).otherwise(F.array(F.struct(F.lit(-1).alias("part"), F.lit(0).cast("long").alias("byte"))))
    held = segments.join(hot, ["segment", "value"], "left").select("segment", "value", F.col("fp").alias("b"), F.col("rest").alias("other"), F.explode(split(F.col("rest"))).alias("at")).select("segment", "value", "b", "other", "at.*")
    ball = F.concat(
        F.array(F.col("value")),
        F.filter(F.transform(F.sequence(F.lit(0), F.lit(SEGMENT - 1)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i).bitwiseOR(F.col("value"))), lambda x: x != F.col("value")),
    )
    probes = segments.select("segment", F.col("value").alias("own"), F.col("fp").alias("a"), "rest", F.explode(ball).alias("value"))
    probes = probes.join(hot, ["segment", "value"], "left").select("segment", "value", "own", "a", "rest", F.explode(split(F.col("rest"))).alias("at")).select("segment", "value", "own", "a", "rest", "at.*")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    # Segments of equal value meet from both sides; the lower fingerprint keeps that pair.
    once = (F.col("own") != F.col("value")) | (F.col("a") < F.col("b"))
    apart = F.col("rest").bitwiseXOR(F.col("other"))
    for j in range(3):
        once &= (F.col("part") <= j) | (F.shiftright(apart, 8 * j).bitwiseAND(F.lit(255)) != 0)
    met = probes.join(shuffled(held), ["segment", "value", "part", "byte"]).where(near & once)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of docs, over its columns doc_id and text.

    Words are runs without ASCII white space, lower-cased in A-Z only. Null and empty texts have the fingerprint 0 and link with
    each other like any equal fingerprints. Equal fingerprints are one node, so a group of copies costs one row. component_id is
    the smallest doc_id that links reach; rows whose doc_id is null count for links, and get it too, or null if no row of their
    component has an id. Repeated rows come back repeated; an empty table gives an empty result.
    """
    prints = cut(fingerprint(docs, width))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")))
    roots = components(links(nodes.select("fp"), distance))
    placed = cut(nodes.join(shuffled(roots), F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("held"))
    n, whole = nodes.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    classes = by_key(placed, least.drop("held"), "root", hot_keys(least, "root", "held", n)).select("fp", "component_id")
    found = by_key(prints, classes, "fp", hot_keys(nodes, "fp", "copies", whole))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Views of a text in the stage for near copies: each the SimHash of its SAMPLE shingles with the least hashes under one mixing.
VIEWS = 10
SAMPLE = 4
SIMILAR = 0.8
#: Members of one hub, or of one shingle of many texts, that a task compares.
SHARE = 2000
#: One text in SAMPLED tells which shingles are common. Their order only sets the work: any order finds all pairs.
SAMPLED = 16
#: Common shingles that are told apart; the rest count as rare.
COMMON = 200_000
#: Partners on either side that a text meets under one shingle, by rounds. The last one leaves out none.
FEW = (2, 32, 1 << 62)
#: Least bits of the parities by which pairs are ruled out before their sets are compared; a power of two, 16 at least.
PARITY = 256
#: Most bits of a sketch that go with each token of a prefix; more would grow with the square of a text.
SCREEN = 1024

_SEEDS = np.array([(0x9E3779B97F4A7C15 * (v + 1)) & (1 << 64) - 1 for v in range(VIEWS)], np.uint64)[:, None]


def views(distinct: np.ndarray) -> np.ndarray:
    """VIEWS fingerprints: of four sampled hashes, the bits that three or more have. Texts that share a sample share its view.

    Each view has a bijection of its own, a whole finaliser after its seed. Of two large sets with a share J of their shingles
    in common, a sample is the same with a chance of about J ** SAMPLE, and samples are the same independently of each other;
    of four and five shingles, four in common, it is one in five.
    """
    mixed = distinct + _SEEDS
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    mixed ^= mixed >> np.uint64(31)
    if mixed.shape[1] > SAMPLE:
        mixed = np.partition(mixed, SAMPLE - 1, axis=1)[:, :SAMPLE]
    a, b, c, d = (mixed[:, k % mixed.shape[1]] for k in range(SAMPLE)) if mixed.shape[1] >= SAMPLE else (np.bitwise_xor.reduce(mixed, axis=1),) * SAMPLE
    pair, both = a & b, c & d
    return (pair & (c | d) | both & (a | b)).view(np.int64)


def shingle_set(text: bytes, width: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, width))


def tokens(distinct: np.ndarray) -> np.ndarray:
    """The distinct shingles by the upper 32 bits of their hashes, ascending; all similarities are of these sets."""
    return np.unique(distinct >> np.uint64(32)).astype("<u4")


def prefix(own: np.ndarray, common: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
    """The first n - ceil(least n) + 1 of n tokens in the order of (count, token), rare ones first.

    Two sets that share `least` of their union have a token of both prefixes in common, whatever the order. common is ascending.
    """
    keys = own.astype(np.uint64)
    if len(common) and len(own):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        keys |= np.where(common[at] == own, counts[at], 0).astype(np.uint64) << np.uint64(32)
    size = len(own) - math.ceil(least * len(own) - 1e-9) + 1
    return np.sort(keys)[:size].astype("<u4") if len(own) else own


def parities(own: np.ndarray, bits: int = PARITY) -> bytes:
    """bits, a power of two: whether an odd number of tokens falls on each. Two sets differ in at least as many tokens as their bits do."""
    return np.packbits((np.bincount(own & np.uint32(bits - 1), minlength=bits) & 1).astype(np.uint8)).tobytes()


def sketch(own: np.ndarray) -> bytes:
    """Parities on at least as many bits as there are tokens: of half as many or less, about half would differ between any two large sets."""
    return parities(own, max(PARITY, 1 << max(len(own) - 1, 0).bit_length()))


def apart(a: bytes, b: bytes) -> int:
    """In how many parities two sketches differ: at most the number of tokens that one of the two sets has alone."""
    if len(a) < len(b):
        a, b = b, a
    x = int.from_bytes(a, "little")
    for half in (len(b) << 3 + k for k in reversed(range((len(a) // len(b)).bit_length() - 1))):
        x = x >> half ^ x & (1 << half) - 1  # the parities of half as many bits
    return (x ^ int.from_bytes(b, "little")).bit_count()


def screen(bits: bytes) -> bytes:
    """A sketch on SCREEN bits at most, with zeros up to as many; screen_bits() tells how many count."""
    while len(bits) > SCREEN // 8:
        half = len(bits) // 2
        bits = (int.from_bytes(bits[:half], "little") ^ int.from_bytes(bits[half:], "little")).to_bytes(half, "little")
    return bits.ljust(SCREEN // 8, b"\0")


def screen_bits(held: np.ndarray) -> np.ndarray:
    """Of screens of sets of so many tokens, how many bits count."""
    return np.clip(1 << np.ceil(np.log2(np.maximum(held, 1))).astype(np.int64), PARITY, SCREEN)


def folds(bits: np.ndarray, held: np.ndarray) -> dict[int, np.ndarray]:
    """The screens, rows of bits, of sets of so many tokens, by the number of bits they are folded to."""
    size, n, found = screen_bits(held), SCREEN, {}
    while n >= PARITY:
        found[n] = np.ascontiguousarray(bits).view(np.uint64)
        n //= 2
        # of as few bits lie at the front already
        bits = np.where((size > n)[:, None], bits[:, : n // 8] ^ bits[:, n // 8 :], bits[:, : n // 8])
    return found


def screened(folded: dict[int, np.ndarray], held: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """apart() of the screens of each pair of i and j, on as many bits as count in both."""
    count, found = screen_bits(np.minimum(held[i], held[j])), np.zeros(len(i), np.int64)
    for n, own in folded.items():
        here = np.flatnonzero(count == n)
        if len(here):
            found[here] = np.bitwise_count(own[i[here]] ^ own[j[here]]).sum(axis=1, dtype=np.int64)
    return found


def _sampled(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_batches(batches, "row"):
            own = np.concatenate([tokens(shingle_set(t, width)) for t in texts])
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int32))], names=["token"])

    return run


def common_tokens(numbered: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, ascending, their counts) of at most COMMON tokens that three or more of the sampled texts hold."""
    some = numbered.where(F.pmod(F.xxhash64("row"), F.lit(SAMPLED)) == 0).mapInArrow(_sampled(width), "token int")
    held = some.groupBy("token").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "token").limit(COMMON).toArrow()
    found = held.column(0).to_numpy().view(np.uint32)
    order = np.argsort(found)
    return found[order], held.column(1).to_numpy()[order]


PRINTS = "row long, doc_id long, size int, set_a long, set_b long, fp long, views array<long>, prefix binary, held int, bits binary"


def _prints(width: int, common: np.ndarray, counts: np.ndarray, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for _, texts in text_batches(iter([batch]), "row"):
                part = batch.slice(done, len(texts))
                done += len(texts)
                sets = [shingle_set(t, width) for t in texts]
                names = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
                halves = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
                own = [views(x).tolist() if len(x) else None for x in sets]
                held = [tokens(x) for x in sets]
                firsts = [prefix(x, common, counts, least).tobytes() for x in held]
                columns = [part.column(0), part.column(1), pa.array([len(x) for x in sets], pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(fingerprints(texts, width)), pa.array(own, pa.list_(pa.int64())), pa.array(firsts, pa.binary()), pa.array([len(x) for x in held], pa.int32()), pa.array([sketch(x) for x in held], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in PRINTS.split(", ")])

    return run


def _possible(least: float):
    """Of pairs with sizes and sketches of both ends, those that these do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [c.to_pylist() for c in batch.columns[2:]]
            good = [min(m, n) >= least * max(m, n) - 1e-9 and apart(x, y) <= (1 - least) / (1 + least) * (m + n) + 1e-9 for m, x, n, y in zip(*own)]
            yield batch.select(["hub", "node"]).filter(pa.array(good, pa.bool_()))

    return run


def _likely(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Of the pairs (hub, node), which should be cheap to read twice, those whose sets may reach `least`; none that does is lost."""
    own = marked(nodes.select("node", "held", "bits"), "node", pairs.select(F.explode(F.array("hub", "node"))))
    leads = own.select(F.col("node").alias("hub"), F.col("held").alias("hub_held"), F.col("bits").alias("hub_bits"))
    both = pairs.join(shuffled(leads), "hub").join(shuffled(own), "node").select("hub", "node", "hub_held", "hub_bits", "held", "bits")
    return cut(both.mapInArrow(_possible(least), "hub long, node long"))


def _verified(width: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hub = None, None
        for batch in batches:
            a, b = [], []
            rows = (row for k in range(0, len(batch), 500) for row in zip(*(c.to_pylist() for c in batch.slice(k, 500).columns)))
            for h, part, leads, node, raw in rows:
                own = tokens(shingle_set(unpacked(raw), width))
                if (h, part) != at:
                    at, hub = (h, part), own if leads else None
                    if leads:
                        continue
                if hub is not None:
                    shared = len(np.intersect1d(hub, own, assume_unique=True))
                    if shared >= least * (len(hub) + len(own) - shared):
                        a.append(h), b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


#: key: token and cell; size: tokens held, place in the prefix and side in the cell, from the top; root: as a step from the node;
#: bits: the screen, or nothing.
PLACES = "key long, size long, node long, root long, bits binary"


def _places(common: np.ndarray, counts: np.ndarray):
    """A row for each token of each prefix. A common token's nodes fall into parts, each pair of which meets in a cell of its own."""
    parts = np.maximum(-(-counts * SAMPLED // SHARE), 1)
    split, parts = common[parts > 1], parts[parts > 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, len(whole), 200):
                batch = whole.slice(first, 200)
                raw = batch.column(2).to_pylist()
                sizes = np.array([len(x) // 4 for x in raw], np.int64)
                token = np.frombuffer(b"".join(raw), "<u4")
                row = np.repeat(np.arange(len(raw)), sizes)
                place = np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                node, root, held = (batch.column(k).to_numpy() for k in (0, 1, 3))
                side, cell = np.zeros(len(token), np.int64), np.zeros(len(token), np.int64)
                if len(split):
                    at = np.minimum(np.searchsorted(split, token), len(split) - 1)
                    number = np.where(split[at] == token, parts[at], 1)
                    salt = (node.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
                    part = salt[row] % number
                    again = np.repeat(np.arange(len(token)), number)
                    other = np.arange(len(again)) - np.repeat(np.cumsum(number) - number, number)
                    token, row, place, part, number = token[again], row[again], place[again], part[again], number[again]
                    cell, side = np.minimum(part, other) * number + np.maximum(part, other), (part > other).astype(np.int64)
                own = token.astype(np.int64) << 31 | cell, held[row].astype(np.int64) << 32 | place << 1 | side, node[row], (root - node)[row]
                bits = pa.array([screen(x) if x else b"" for x in batch.column(4).to_pylist()], pa.binary()).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in own), bits], names=[x.split()[0] for x in PLACES.split(", ")])

    return run


def _meetings(least: float, few: int):
    """Pairs of different roots from rows sorted by key and size; those whose sizes, places or screens rule out `least` are left out.

    Under a key the first `few` partners above a node and below it are told, of those whose component has as many members there or more:
    so many members of one do not each ask for the same few others. A pair that neither of its ends asks for waits: both of its nodes
    are told as pairs with themselves.
    """

    def pairs(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, size, node, root, bits = columns
        root = node + root
        held, place, side = size >> 32, (size & 0xFFFFFFFF) >> 1, size & 1
        ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
        starts = np.append(0, ends[:-1])
        mixed = np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts)
        end = np.repeat(ends, ends - starts)
        live = np.flatnonzero(np.repeat(mixed, ends - starts))
        parted = (np.minimum.reduceat(side, starts) != np.maximum.reduceat(side, starts)).repeat(ends - starts)
        # members of the row's component under its key
        held_by = np.ones(len(key), np.int64)
        if len(live):
            _, flat = np.unique(root[live], return_inverse=True)
            _, flat, count = np.unique(end[live] * (flat.max() + 1) + flat, return_inverse=True, return_counts=True)
            held_by[live] = count[flat]
        folded = folds(bits, held) if bits.shape[1] and len(live) else {}
        above, below, left = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        a, b, waiting, step = [], [], 0, 1
        while len(live):
            live = live[live + step < end[live]]
            live = live[held[live] >= least * held[live + step] - 1e-9]
            i, j = live, live + step
            good = (root[i] != root[j]) & (~parted[i] | (side[i] != side[j]))
            good &= np.minimum(held[i] - place[i], held[j] - place[j]) >= least / (1 + least) * (held[i] + held[j]) - 1e-9
            i, j = i[good], j[good]
            if folded:
                good = screened(folded, held, i, j) <= (1 - least) / (1 + least) * (held[i] + held[j]) + 1e-9
                i, j = i[good], j[good]
            told = (held_by[i] <= held_by[j]) & (above[i] < few) | (held_by[j] <= held_by[i]) & (below[j] < few)
            above[i] += 1
            below[j] += 1
            left[i[~told]] = left[j[~told]] = True
            i, j = i[told], j[told]
            a.append(np.minimum(node[i], node[j])), b.append(np.maximum(node[i], node[j]))
            waiting, step = waiting + len(a[-1]), step + 1
            if waiting > 1 << 20 or not len(live):
                met = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(met[0]), pa.array(met[1])], names=["hub", "node"])
                a, b, waiting = [], [], 0
        if left.any():
            own = pa.array(np.unique(node[left]))
            yield pa.RecordBatch.from_arrays([own, own], names=["hub", "node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = []
        for batch in batches:
            if not len(batch):
                continue
            own = [c.to_numpy() for c in batch.columns[:4]]
            bits = b"".join(batch.column(4).to_pylist()) if batch.column(4)[0].as_py() else b""
            own.append(np.frombuffer(bits, np.uint8).reshape(len(batch), len(bits) // len(batch)))
            # the last group may go on in the next batch
            first = int(np.searchsorted(own[0], own[0][-1]))
            if first or (kept and kept[-1][0][-1] != own[0][0]):
                yield from pairs([np.concatenate(x) for x in zip(*kept, [c[:first] for c in own])])
                kept = []
            kept.append([c[first:] for c in own])
        if kept:
            yield from pairs([np.concatenate(x) for x in zip(*kept)])

    return run


def _linked(numbered: DataFrame, pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """(a, b) of the pairs (hub, node) of rows whose sets reach the similarity."""
    # each node's text once, with the hubs it is compared with; a hub leads each share of its members
    shares = pairs.groupBy("hub").agg(F.count("*").alias("members")).select("hub", F.ceil(F.col("members") / SHARE).cast("int").alias("shares"))
    asked = pairs.join(shuffled(shares), "hub").select("node", F.struct("hub", F.pmod(F.xxhash64("node"), F.col("shares")).cast("int").alias("part"), F.lit(False).alias("leads")).alias("h"))
    leads = shares.select(F.col("hub").alias("node"), F.explode(F.transform(F.sequence(F.lit(0), F.col("shares") - 1), lambda k: F.struct(F.col("hub"), k.alias("part"), F.lit(True).alias("leads")))).alias("h"))
    wanted = asked.union(leads).groupBy("node").agg(F.collect_list("h").alias("hubs"))
    # only texts that are compared move, and as compressed text: a set of their shingles is three times as long
    compared = marked(numbered.select("row", "text"), "row", pairs.select(F.explode(F.array("hub", "node"))))
    squeezed = compared.mapInArrow(squeeze, "row long, text binary")
    texts = squeezed.join(shuffled(wanted), F.col("row") == F.col("node")).select("node", "text", "hubs")
    each = texts.select("node", "text", F.explode("hubs").alias("h")).select("h.hub", "h.part", "h.leads", "node", "text")
    # written before the links are joined, so that a task has one Python worker at a time
    return cut(each.repartition("hub", "part").sortWithinPartitions("hub", "part", F.desc("leads")).mapInArrow(_verified(width, similarity), "a long, b long"))


def representatives(docs: DataFrame, width: int = 5, similarity: float = SIMILAR, distance: int = 3) -> DataFrame:
    """One row of each group of near copies in docs, with all of its columns: the first row that has the smallest doc_id.

    Near copies share `similarity` or more of their distinct shingles of `width` words (intersection over union); links are
    transitive. First candidates are texts whose fingerprints differ in at most `distance` bits, by multi-index hashing, and texts that
    share a view, a SimHash of a small min-wise sample of their shingles: at a similarity of 0.8, fingerprints of whole texts
    differ in some ten bits of 64, for which no segments are both few and selective, while one of ten samples is the same for
    99 in 100 pairs of long texts, and for fewer of short ones. Texts of equal shingles are one node. In each bucket all nodes are compared with its least and its last node,
    so a bucket of any size costs two comparisons a member; SHARE members of a hub at most meet in one task. What that leaves apart
    is then found without chance: any two texts that reach the similarity share a token of their prefixes (see prefix()), and all
    pairs of different components that do, and whose sizes, places and sketches allow it, are compared. They are so in rounds: a text
    first meets a few partners under each token, and what these links join meets no more; texts with partners left meet more of
    them, now with sketches at hand, until none are left. So texts of a large group meet in few of its pairs, while the last round leaves out none. Tokens that are common in a sample come
    last in the order, so passages of many texts are in few prefixes; where they are, their texts are split over tasks, not cut.
    Every link is verified on the sets of shingles themselves, by 32 bits of each hash. Rows of docs that are kept, and texts that are
    compared, are found by bits of their numbers where they lie.

    Texts without words, null or empty, are not copies of each other, and all stay. In a group whose rows all have a null doc_id
    the first row stays. docs must keep its partitions between reads, as tables do.
    """
    name = free_name(docs, "row_number_")
    rows = docs.withColumn(name, F.monotonically_increasing_id())
    numbered = rows.select(F.col(name).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    common, counts = common_tokens(numbered, width)
    prints = cut(numbered.mapInArrow(_prints(width, common, counts, similarity), PRINTS))
    worded = prints.where("size > 0")
    nodes = worded.groupBy("set_a", "set_b", "size").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"), F.first("fp").alias("fp"), F.first("views").alias("views"), F.first("prefix").alias("prefix"), F.first("held").alias("held"), F.first("bits").alias("bits"))
    nodes = cut(nodes.select(F.col("first.row").alias("node"), "first", "fp", "views", "prefix", "held", "bits"))

    # the fingerprint is one more view; fingerprints near each other join the buckets of both
    owns = nodes.select("node", F.posexplode(F.concat("views", F.array("fp"))).alias("view", "value"))
    least = owns.groupBy("view", "value").agg(F.min("node").alias("hub"), F.max("node").alias("other"), F.count("*").alias("held"))
    inside = owns.join(shuffled(least.where("held > 1")), ["view", "value"]).select(F.explode(F.array("hub", "other")).alias("hub"), "node")
    heads = least.where(F.col("view") == VIEWS).select(F.col("value").alias("fp"), "hub")
    near = links(heads.select("fp"), distance)
    across = near.join(shuffled(heads.select(F.col("fp").alias("a"), F.col("hub").alias("p"))), "a").join(shuffled(heads.select(F.col("fp").alias("b"), F.col("hub").alias("q"))), "b")
    across = across.select(F.least("p", "q").alias("hub"), F.greatest("p", "q").alias("node"))
    pairs = cut(inside.union(across).where("hub <> node").distinct())

    roots = components(_linked(numbered, _likely(pairs, nodes, similarity), width, similarity))

    # pairs that no bucket linked: all that share a token of their prefixes and are not in one component yet
    own = nodes.select("node", "prefix", "held", F.lit(b"").alias("bits"))
    for few in FEW:
        stars = roots.select("node", "root")
        rooted = own.join(shuffled(stars.withColumnRenamed("node", "own")), F.col("node") == F.col("own"), "left").select("node", F.coalesce("root", "node").alias("root"), "prefix", "held", "bits")
        places = rooted.mapInArrow(_places(common, counts), PLACES)
        met = cut(places.repartition("key").sortWithinPartitions("key", "size").mapInArrow(_meetings(similarity, few), "hub long, node long").distinct())
        rest = _likely(met.where("hub <> node"), nodes, similarity)
        roots = components(stars.toDF("a", "b").union(_linked(numbered, rest, width, similarity)))
        left = met.where("hub = node").select("node")
        if left.isEmpty():
            break
        # these are fewer texts, so their screens go along with each token
        own = marked(nodes.select("node", "prefix", "held", "bits"), "node", left)
    placed = nodes.select("node", "first").join(shuffled(roots.withColumnRenamed("node", "own")), F.col("node") == F.col("own"), "left").select("first", F.coalesce("root", "node").alias("root"))
    kept = placed.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    kept = cut(kept.union(prints.where("size = 0").select("row")))
    return marked(rows, name, kept).select(*[F.col(f"`{c}`") for c in docs.columns])
