"""Removal of repeated byte strings: prefix-free parsing into phrases, whose suffixes are matched by class."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import cut, squeeze, text_batches, unpacked

#: Length of a string that may not repeat; bytes of the rolling hash, a power of two; strings of SPAN bytes hold REACH such windows.
SPAN = 200
GRAM = 16
BASE = 0x9E3779B97F4A7C15
REACH = SPAN - GRAM + 1
#: Strings that start up to NEAR bytes before their trigger share the SPAN - NEAR bytes from it; others share those before it.
NEAR = 140
#: Starts that one piece of a long text covers.
SEGMENT = 1 << 20
#: A phrase's place is its first start and, in the low bits, its starts, REACH at most.
PLACE = 8
#: Distinct phrases of one core that a task compares; larger groups are compared string by string.
GROUP = 8192


def rolling(data: np.ndarray) -> np.ndarray:
    """The rolling hash of the GRAM bytes from each place on, past the end zeros: a polynomial in BASE, modulo 2 ** 64.

    A window of 2k bytes is two of k, so all windows take as many passes as GRAM has doublings.
    """
    h, base, step = np.append(data, np.zeros(GRAM, np.uint8)).astype(np.uint64), BASE, 1
    while step < GRAM:
        h = h[:-step] * np.uint64(base) + h[step:]
        base, step = base * base % (1 << 64), 2 * step
    return h[: len(data)]


def triggers(data: np.ndarray) -> np.ndarray:
    """For each start of a string of SPAN bytes, the place of its trigger: its window with the least mixed hash, the first of equals.

    A trigger depends on the string alone, so equal strings have theirs at the same place. 32 bits of the hash decide.
    """
    n = len(data)
    h = rolling(data)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    least = h & np.uint64(0xFFFFFFFF00000000) | np.arange(n, dtype=np.uint64)
    reach = 1
    while reach < REACH:
        step = min(reach, REACH - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)[: max(0, n - SPAN + 1)]


def phrases(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first start, end of starts, trigger) of each run of starts with one trigger, places within the joined texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    where = triggers(np.frombuffer(b"".join(texts), np.uint8))
    text = np.repeat(np.arange(len(texts)), sizes)[: len(where)]
    start = np.flatnonzero(np.arange(len(where)) + SPAN <= ends[text])
    text, where = text[start], where[start]
    if not len(start):
        return text, start, start, where
    new = np.flatnonzero(np.append(True, (where[1:] != where[:-1]) | (text[1:] != text[:-1])))
    return text[new], start[new], np.append(start[new[1:] - 1], start[-1]) + 1, where[new]


def _segments(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(texts, places of the segments in them, segments); strings are judged alone, so a cut between starts changes nothing."""
    own, place, part, held = [], [], [], 0
    for i, t in enumerate(texts):
        for s in range(0, max(1, len(t) - SPAN + 1), SEGMENT):
            own.append(i), place.append(s), part.append(t[s : s + SEGMENT + SPAN - 1])
            held += len(part[-1])
            if held >= 2 * SEGMENT:
                yield own, place, part
                own, place, part, held = [], [], [], 0
    if own:
        yield own, place, part


def parse(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first start, starts, core hash, phrase hash) of every phrase, each split at NEAR bytes before its trigger."""
    out = []
    digest = xxhash.xxh3_64_intdigest
    for own, place, part in _segments(texts):
        flat = b"".join(part)
        text, low, high, at = phrases(part)
        begin = np.cumsum([0, *map(len, part)])[:-1]
        edge = at - NEAR
        for far, lo, hi, a, b in ((0, np.maximum(low, edge), high, at, at + SPAN - NEAR), (1, low, np.minimum(high, edge), edge - 1, at + GRAM)):
            live = lo < hi
            i, lo, hi, a, b = text[live], lo[live], hi[live], a[live], b[live]
            core = np.fromiter((digest(flat[x:y], far) for x, y in zip(a.tolist(), b.tolist())), np.uint64, len(i))
            whole = np.fromiter((digest(flat[x:y], 7) for x, y in zip(lo.tolist(), (hi + SPAN - 1).tolist())), np.uint64, len(i))
            out.append((np.array(own, np.int64)[i], lo - begin[i] + np.array(place, np.int64)[i], hi - lo, core.view(np.int64), whole.view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 5


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in text_batches(batches, "row"):
        text, low, n, core, whole = parse(texts)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(text)), pa.array(low << PLACE | n), pa.array(core), pa.array(whole)], names=["row", "place", "core", "phrase"])


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes that the strings of wanted phrases cover."""
    for batch in batches:
        rows: list[tuple] = []
        held = 0
        for raw, wanted in zip(batch.column(0), batch.column(1)):
            text = unpacked(raw.as_py())
            for w in wanted.as_py():
                low, n = divmod(w["place"], 1 << PLACE)
                rows.append((w["core"], w["phrase"], w["many"], text[low : low + n + SPAN - 1]))
                held += n + SPAN
            if held > 1 << 22:
                yield _content_batch(rows)
                rows, held = [], 0
        if rows:
            yield _content_batch(rows)


def _content_batch(rows: list[tuple]) -> pa.RecordBatch:
    core, phrase, many, content = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(core, pa.int64()), pa.array(phrase, pa.int64()), pa.array(many, pa.bool_()), pa.array(content, pa.binary())], names=["core", "phrase", "many", "content"])


def strings(content: bytes) -> list[bytes]:
    """128-bit names of the strings of SPAN bytes in content, in order."""
    return [xxhash.xxh3_128_digest(content[j : j + SPAN]) for j in range(len(content) - SPAN + 1)]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bits of the strings that another phrase of the same core has too; groups come one after the other."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    out: list[tuple[int, int, bytes]] = []
    for core, group in groupby(rows(), key=lambda r: r[0]):
        own = [(phrase, many, strings(content)) for _, phrase, many, content in group]
        seen: dict[bytes, int] = {}
        for _, _, names in own:
            for x in names:
                seen[x] = seen.get(x, 0) + 1
        for phrase, many, names in own:
            if not many:
                bits = np.array([seen[x] > 1 for x in names])
                if bits.any():
                    out.append((core, phrase, np.packbits(bits).tobytes()))
        if len(out) > 10_000:
            yield _bits_batch(out)
            out = []
    yield _bits_batch(out)


def _bits_batch(rows: list[tuple]) -> pa.RecordBatch:
    core, phrase, bits = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(core, pa.int64()), pa.array(phrase, pa.int64()), pa.array(bits, pa.binary())], names=["core", "phrase", "bits"])


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        core, phrase, many, content = (c.to_pylist() for c in batch.columns)
        for i in range(0, len(core), 500):
            rows = [(core[k], phrase[k], many[k], j, x[:8], x[8:]) for k in range(i, min(i + 500, len(core))) for j, x in enumerate(strings(content[k]))]
            a, b, m, j, x, y = zip(*rows)
            longs = lambda v: pa.array(np.frombuffer(b"".join(v), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(m), pa.array(j, pa.int32()), longs(x), longs(y)], names=["core", "phrase", "many", "j", "x", "y"])


def covered(size: int, runs: list[dict]) -> np.ndarray:
    """Which bytes of a text the repeated strings cover. A run: its place, and bits, or null if all repeat."""
    starts = np.zeros(size + 1, np.int32)
    for r in runs:
        low, n = divmod(r["place"], 1 << PLACE)
        starts[low : low + n] |= 1 if r["bits"] is None else np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=n)
    upto = np.cumsum(starts)
    return (upto[:size] - np.concatenate([np.zeros(min(SPAN, size), np.int32), upto[: max(0, size - SPAN)]])) > 0


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for raw, runs in zip(batch.column(1), batch.column(2)):
            text = unpacked(raw.as_py())
            own = runs.as_py()
            if not own:
                rows.append((len(text), 0, 0, hashlib.sha256(text).hexdigest()))
                continue
            gone = covered(len(text), own)
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            rows.append((len(text), len(text) - len(kept), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
        columns = [pa.array(x) for x in zip(*rows)] if rows else [pa.array([], pa.int64())] * 3 + [pa.array([], pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[x.split()[0] for x in RESULT.split(", ")])


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of docs (doc_id, text).

    A string of SPAN bytes that starts in more than one place, in one text or two, is removed wherever it is. Rolling-hash
    triggers cut each text into phrases: all strings with one trigger, so equal strings lie in phrases with equal cores, the
    bytes at the trigger that all strings of the phrase hold. Phrases whose core is alone hold no repeated string and are
    dropped first. The dictionary of the rest gives the classes: strings of a phrase that occurs twice all repeat; others are
    compared, string by string, with the other phrases of their core, in one task if those are at most GROUP, and in one
    aggregation by the strings' 128-bit names where they are more, so no group meets in one task. Copies count before they
    move: counts combine before every shuffle, and only distinct phrases are ever compared.

    docs is read three times and must keep its partitions between reads, as tables do. Null texts are empty; texts below SPAN
    bytes lose nothing; a row that repeats a text of SPAN bytes or more loses all of it. Rows that repeat, or whose doc_id is
    null, come back like any other. Other columns are left out; an empty table gives no rows.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parsed = rows.select("row", "text").mapInArrow(_parsed, "row long, place long, core long, phrase long")
    # written, so that both sides of the join are dealt for it alone and a core of many phrases can be split
    shared = cut(parsed.groupBy("core").agg(F.count("*").alias("uses")).where("uses > 1").select("core"))
    found = cut(parsed.join(shared, "core"))

    dictionary = found.groupBy("core", "phrase").agg(F.count("*").alias("uses"), F.min(F.struct("row", "place")).alias("at"))
    dictionary = cut(dictionary.select("core", "phrase", (F.col("uses") > 1).alias("many"), "at"))
    sizes = dictionary.groupBy("core").agg(F.count("*").alias("size"), F.min("many").alias("settled")).where("size > 1 AND NOT settled")
    wanted = dictionary.join(sizes, "core")
    # a row's list is bounded by its own text
    asked = wanted.groupBy("at.row").agg(F.collect_list(F.struct("core", "phrase", "many", F.col("at.place").alias("place"))).alias("wanted"))
    squeezed = rows.mapInArrow(squeeze, "row long, doc_id long, text binary")
    contents = cut(squeezed.join(asked, "row").select("text", "wanted").mapInArrow(_contents, "core long, phrase long, many boolean, content binary"))

    few = contents.join(sizes.where(F.col("size") <= GROUP).select("core"), "core").select("core", "phrase", "many", "content")
    compared = few.repartition("core").sortWithinPartitions("core").mapInArrow(_compared, "core long, phrase long, bits binary")
    hot = contents.join(sizes.where(F.col("size") > GROUP).select("core"), "core").select("core", "phrase", "many", "content")
    names = hot.mapInArrow(_named, "core long, phrase long, many boolean, j int, x long, y long")
    twice = names.groupBy("x", "y").agg(F.count("*").alias("uses")).where("uses > 1").select("x", "y")
    own = names.where("NOT many").join(twice, ["x", "y"]).groupBy("core", "phrase").agg(F.collect_set("j").alias("js"))
    # bits of the repeated starts, in bytes, as packbits writes them
    byte = lambda b: F.aggregate(F.filter("js", lambda j: F.floor(j / 8) == b), F.lit(0), lambda s, j: s + F.pow(F.lit(2.0), 7 - j % 8).cast("int"))
    hexed = F.transform(F.sequence(F.lit(0), F.lit((REACH - 1) // 8)), lambda b: F.lpad(F.hex(byte(b)), 2, "0"))
    named = own.select("core", "phrase", F.unhex(F.array_join(hexed, "")).alias("bits"))

    whole = dictionary.where("many").select("core", "phrase", F.lit(None).cast("binary").alias("bits"))
    classes = whole.union(compared).union(named)
    runs = found.join(classes, ["core", "phrase"]).groupBy("row").agg(F.collect_list(F.struct("place", "bits")).alias("runs"))
    return squeezed.join(runs, "row", "left").select("doc_id", "text", "runs").mapInArrow(_removed, RESULT)
