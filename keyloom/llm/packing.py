"""Packing of tokenized documents into sequences of bounded length."""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import cut, text_batches

LIMIT = 2048
END = 0
#: Rows of one length that one window orders.
RANKED = 2_000
#: Most rows of the plan of bins that are broadcast; more are joined by a shuffle.
BROADCAST = 100_000
#: Split of pre-tokens of the byte-level vocabulary: a fixed value of that vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Ids of the vocabulary's special tokens, as its JSON form reads them in a text: fixed values of that vocabulary.
SPECIAL = {"<|endoftext|>": 50256}

Bin = tuple[tuple[int, int], ...]


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def encoder(path: str):
    """Byte-level BPE over the ranks at path; the same ids as the vocabulary's JSON form, several times as fast."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=SPECIAL)


def pieces(docs: DataFrame, limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and one END, cut only where longer than limit.

    The first piece of a cut document takes what the full pieces leave. A null text is empty: one piece of one id. A special
    token's string in a text is that token.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path or vocabulary()).encode_to_numpy
        for ids, texts in text_batches(batches):
            rows: list[tuple[int, int, int, int, int]] = []
            for i, text in enumerate(texts):
                tokens = np.append(encode(text.decode("utf-8", "replace"), allowed_special="all"), END).astype("<u4")
                first = len(tokens) % limit or limit
                for k, start in enumerate([0, *range(first, len(tokens), limit)]):
                    part = tokens[start : first if k == 0 else start + limit]
                    rows.append((i, k, start, len(part), zlib.crc32(part.tobytes())))
            own, piece, start, length, crc = (pa.array(x) for x in zip(*rows))
            yield pa.RecordBatch.from_arrays([ids.take(own), piece.cast(pa.int32()), start, length, crc], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(counts: dict[int, int], limit: int = LIMIT) -> Counter[Bin]:
    """Best-fit decreasing over a histogram of lengths; equal bins are one entry with its count."""
    done: Counter[Bin] = Counter()
    rooms: list[int] = []
    by_room: dict[int, Counter[Bin]] = {}

    def put(room: int, held: Bin, n: int) -> None:
        if room not in by_room:
            insort(rooms, room)
            by_room[room] = Counter()
        by_room[room][held] += n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                each = min(limit // length, left)
                put(limit - each * length, ((length, each),), left // each)
                left %= each
                continue
            room = rooms[k]
            held, n = next(iter(by_room[room].items()))
            each = min(room // length, left)
            n = min(n, left // each)
            left -= n * each
            by_room[room][held] -= n
            if not by_room[room][held]:
                del by_room[room][held]
            if not by_room[room]:
                del by_room[room], rooms[k]
            put(room - each * length, tuple(sorted((Counter(dict(held)) + Counter({length: each})).items())), n)
    for own in by_room.values():
        done.update(own)
    return done


def total(held: Bin) -> int:
    return sum(x * n for x, n in held)


def changed(held: Bin, out: tuple[int, ...], put: tuple[int, ...]) -> Bin:
    own = Counter(dict(held))
    own.subtract(out)
    own.update(put)
    return tuple(sorted((x, n) for x, n in own.items() if n))


class Rooms:
    """Underfull kinds of bins by an item that they hold and by their room; item 0 stands for none, so every kind holds it."""

    def __init__(self, limit: int):
        self.limit = limit
        self.kinds: dict[tuple[int, int], dict[Bin, None]] = {}
        self.rooms: dict[int, list[int]] = {}
        #: The largest room of a kind that holds the item, -1 without one.
        self.top = np.full(limit + 1, -1)

    def add(self, held: Bin, room: int) -> None:
        for x in (0, *(x for x, _ in held)):
            own = self.kinds.setdefault((x, room), {})
            if not own:
                rooms = self.rooms.setdefault(x, [])
                insort(rooms, room)
                self.top[x] = rooms[-1]
            own[held] = None

    def drop(self, held: Bin, room: int) -> None:
        for x in (0, *(x for x, _ in held)):
            own = self.kinds.get((x, room), {})
            if held not in own:
                return
            del own[held]
            if not own:
                rooms = self.rooms[x]
                del self.kinds[x, room], rooms[bisect_left(rooms, room)]
                self.top[x] = rooms[-1] if rooms else -1


def takings(held: Bin) -> tuple[set[int], set[int]]:
    """The sizes of one item of a bin, and of two."""
    single = {x for x, _ in held}
    counts = dict(held)
    items = sorted(single)
    double = {x + y for i, x in enumerate(items) for y in items[i + (counts[x] < 2) :]}
    return single, double


def exchange(giver: Bin, room: int, among: Rooms) -> tuple[Bin, tuple[int, ...], tuple[int, ...]] | None:
    """(receiver, what it gives, what it gets): the exchange of one or two items for one or none that a receiver has room for.

    Of the items that a receiver may give, the one whose roomiest holder would raise the squared fill most is taken, and of its
    holders again the best. None if no kind among those given gains from the giver.
    """
    limit = among.limit
    single, double = takings(giver)
    here = np.zeros(limit + 1, np.int64)
    sizes = np.array(sorted(x for x in single | double if x <= limit))
    here[sizes] = sizes
    fits = np.maximum.accumulate(here)  # the largest taking of a size or below
    out = np.flatnonzero(among.top > 0)
    gain = fits[np.minimum(out + among.top[out], limit)] - out
    out, gain = out[gain > 0], gain[gain > 0]
    if not len(out):
        return None
    given = int(out[np.argmax(gain * (room - among.top[out] + gain))])
    rooms = np.array(among.rooms[given])
    gain = fits[np.minimum(given + rooms, limit)] - given
    best = int(np.argmax(np.where(gain > 0, gain * (room - rooms + gain), -1)))
    receiver = next(iter(among.kinds[given, int(rooms[best])]))
    size = given + int(gain[best])
    if size in single:
        got = (size,)
    else:
        counts = dict(giver)
        got = next((x, size - x) for x in sorted(single) if counts.get(size - x, 0) > (x == size - x))
    return receiver, (given,) if given else (), got


def local_search(bins: Counter[Bin], limit: int = LIMIT) -> Counter[Bin]:
    """Raise the squared fill of underfull bins by moves and swaps until bins empty or nothing gains.

    A giver hands one or two items to a receiver that is at least as full, for one of its items or for none, so that the
    receiver is fuller than before; the sum of squared fills grows with each exchange, and a bin that ends empty is gone. In a
    pass every underfull bin is a giver once it is the emptiest left, again after each exchange, and all others are its
    receivers, found by the items that they hold and by their room. Passes go on until one has no exchange, or until the number of
    bins is the least that their lengths allow. Equal pairs of bins are exchanged together, so the work follows the number of
    kinds of bins, not of bins.
    """
    bins = Counter({k: n for k, n in bins.items() if n})
    many = sum(bins.values())
    least = -(-sum(total(k) * n for k, n in bins.items()) // limit)
    moved = True
    while moved and many > least:
        moved, among = False, Rooms(limit)
        order = sorted((total(k) - limit, k) for k in bins if total(k) < limit)
        for room, k in order:
            among.add(k, -room)
        while order and many > least:
            room, giver = heappop(order)
            room = -room
            if not bins[giver]:
                continue
            if bins[giver] == 1:
                among.drop(giver, room)
            step = exchange(giver, room, among)
            if step is None:
                among.drop(giver, room)
                continue
            moved = True
            receiver, out, got = step
            n = bins[giver] // 2 if receiver == giver else min(bins[giver], bins[receiver])
            for k, m in ((giver, -n), (receiver, -n), (changed(receiver, out, got), n), (changed(giver, got, out), n)):
                if not k:
                    many -= n
                    continue
                bins[k] += m
                left = limit - total(k)
                if not bins[k]:
                    del bins[k]
                    among.drop(k, left)
                elif left and (m > 0 or k == giver):
                    among.add(k, left)
                    heappush(order, (-left, k))
    return bins


def plan(counts: Counter[int] | dict[int, int], limit: int = LIMIT, most: int | None = None) -> Counter[Bin]:
    """Bins for a histogram of lengths: best fit, then local search over all of it, however many pieces there are.

    Only a caller that gives `most` gets less: of more than `most` pieces a q-th of each length is packed, that packing is taken q
    times, and what the division leaves is planned in the same way; so the work follows `most` and the logarithm of the number of
    pieces. Where best fit over all of them needs fewer sequences, that is the plan.
    """
    many = sum(counts.values())
    if most is None or many <= most:
        return local_search(best_fit(counts, limit), limit)
    q = -(-many // most)
    part = {k: n // q for k, n in counts.items() if n >= q}
    rest = plan({k: n % q for k, n in counts.items() if n % q}, limit, most)
    for k, n in local_search(best_fit(part, limit), limit).items():
        rest[k] += n * q
    return min(rest, best_fit(counts, limit), key=lambda bins: sum(bins.values()))


def slots(bins: Counter[Bin]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, items a bin, first sequence, offset in it) of each length in each kind of bin."""
    out, sequence, used = [], 0, Counter()
    for held, n in sorted(bins.items()):
        offset = 0
        for length, each in held:
            out.append((length, used[length], used[length] + n * each, each, sequence, offset))
            used[length] += n * each
            offset += length * each
        sequence += n
    return out


def ranked(rows: DataFrame) -> DataFrame:
    """rows with `rank`, from 0 without gaps within each length, however many rows a length has.

    Rows of a length are dealt into parts of about RANKED rows by a hash of their ids; a window ranks within a part, and the
    sizes of the parts before it are added.
    """
    most = rows.groupBy("length").count().agg(F.max("count")).first()[0] or 0
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(1 + most // RANKED)))
    sizes = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = sizes.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    inner = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32"))
    return dealt.withColumn("inner", inner).join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("inner") - 1).drop("part", "inner", "before")


def pack(parts: DataFrame, limit: int = LIMIT) -> DataFrame:
    """parts with sequence_id and offset. The plan is made over the histogram of lengths, which has at most `limit` rows."""
    spark = parts.sparkSession
    counts = {int(n): int(c) for n, c in parts.groupBy("length").count().collect()}
    laid = slots(plan(counts, limit)) if counts else []
    # A step of the packing adds two kinds of bins at most, so this table follows `limit`, not the rows.
    places = spark.createDataFrame(laid, "length long, low long, high long, each long, sequence long, place long")
    places = F.broadcast(places) if len(laid) <= BROADCAST else places
    placed = ranked(parts).join(places, "length").where("rank >= low AND rank < high")
    k = F.col("rank") - F.col("low")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.floor(k / F.col("each"))).cast("long").alias("sequence_id"), (F.col("place") + (k % F.col("each")) * F.col("length")).alias("offset"),
    )


def packed(docs: DataFrame, limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row of docs (doc_id, text).

    Null and empty texts are one piece of the single END id. Rows that repeat, or whose doc_id is null, are packed like any
    other. Other columns are left out. An empty table gives no rows.
    """
    return pack(cut(pieces(docs, limit, path)), limit)
