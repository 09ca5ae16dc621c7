"""Media columns: payloads as baseline JPEG coefficients, read back by a Huffman decoder in numpy."""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import text_batches

UNIT = 64
#: Byte that becomes the coefficient 0.
CENTRE = 101
#: Blocks from one restart marker to the next; intervals decode side by side.
INTERVAL = 8
#: Payload bytes that are coded at once; a longer payload is coded and decoded in runs of whole restart intervals of that size.
BATCH = 1 << 20
#: Blocks of such a run: restart markers count modulo 8, so each run begins at marker 0.
RUN = BATCH // UNIT
assert RUN % (8 * INTERVAL) == 0
ZRL, EOB = 0xF0, 0x00


def code_lengths(weights: dict[int, float]) -> dict[int, int]:
    """Huffman code lengths; one more symbol, -1, keeps the code of all ones unused."""
    heap = [(w, k, (s,)) for k, (s, w) in enumerate(sorted({**weights, -1: 0.0}.items()))]
    length = dict.fromkeys([*weights, -1], 0)
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            length[s] += 1
        n += 1
        heapq.heappush(heap, (a[0] + b[0], n, a[2] + b[2]))
    return length


def canonical(length: dict[int, int]) -> tuple[list[int], list[int], dict[int, tuple[int, int]]]:
    """(codes of each length 1 to 16, symbols in code order, {symbol: (code, length)})."""
    order = sorted((n, s) for s, n in length.items() if s >= 0)
    codes, code, before = {}, 0, 0
    for n, s in order:
        code <<= n - before
        codes[s] = (code, n)
        code, before = code + 1, n
    return [sum(n == k for n, _ in order) for k in range(1, 17)], [s for _, s in order], codes


# Weights by a rule: sizes 5 to 7 are letters and marks around the centre, longer runs of zeros ever rarer.
_SIZE = {1: 3, 2: 6, 3: 12, 4: 16, 5: 22, 6: 12, 7: 24, 8: 3, 9: 0.2, 10: 0.1}
_DC = canonical(code_lengths({s: _SIZE.get(s, 1) + 0.5 for s in range(12)}))
_AC = canonical(code_lengths({EOB: 0.3, ZRL: 0.3} | {r << 4 | s: max(0.02, w * 4.0**-r) for s, w in _SIZE.items() for r in range(16)}))
assert max(n for _, n in [*_DC[2].values(), *_AC[2].values()]) <= 16 and _AC[2][ZRL][1] <= 11


def _arrays(codes: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    code, bits = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    for s, (c, n) in codes.items():
        code[s], bits[s] = c, n
    return code, bits


_DC_CODE, _DC_BITS = _arrays(_DC[2])
_AC_CODE, _AC_BITS = _arrays(_AC[2])


def grid(blocks: int) -> tuple[int, int]:
    """Blocks across and down."""
    wide = int(np.ceil(np.sqrt(blocks)))
    return wide, -(-blocks // wide)


def head(payload: int, wide: int, high: int) -> bytes:
    """Markers up to the scan: one 8-bit component, quantisers of 1, the payload's length as a comment."""
    segment = lambda mark, body: struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body
    return (
        b"\xff\xd8" + segment(0xFE, b"payload %d" % payload) + segment(0xDB, b"\0" + b"\1" * 64)
        + segment(0xC0, struct.pack(">BHHBBBB", 8, high * 8, wide * 8, 1, 1, 0x11, 0))
        + segment(0xC4, b"\x00" + bytes(_DC[0]) + bytes(_DC[1])) + segment(0xC4, b"\x10" + bytes(_AC[0]) + bytes(_AC[1]))
        + segment(0xDD, struct.pack(">H", INTERVAL)) + segment(0xDA, b"\1\1\x00\x00\x3f\x00")
    )


def _sizes(v: np.ndarray) -> np.ndarray:
    return np.frexp(np.abs(v).astype(np.float32))[1].astype(np.int64)


def _magnitude(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v < 0, v + (1 << size) - 1, v).astype(np.uint64)


def encode(payloads: list[bytes]) -> list[bytes]:
    """A JPEG file per payload, whose length is a positive multiple of 64: a block's coefficients are 64 of its bytes."""
    shapes = [grid(len(p) // UNIT) for p in payloads]
    blocks = [a * b for a, b in shapes]
    scans: dict[int, bytes] = {}
    short = [i for i, n in enumerate(blocks) if n <= RUN]
    for i, j in _chunks([blocks[i] * UNIT for i in short], BATCH):
        scans |= zip(short[i:j], code([payloads[k] for k in short[i:j]], [blocks[k] for k in short[i:j]]))
    for i, n in enumerate(blocks):
        if n > RUN:
            runs = (code([payloads[i][k * UNIT : (k + RUN) * UNIT]], [min(RUN, n - k)])[0] for k in range(0, n, RUN))
            scans[i] = b"\xff\xd7".join(runs)
    return [head(len(p), *shapes[i]) + scans[i] + b"\xff\xd9" for i, p in enumerate(payloads)]


def code(parts: list[bytes], sizes: list[int]) -> list[bytes]:
    """The scan of each part, whose blocks are padded with zeros to the size given; the first interval of each has marker 0 behind it."""
    used = np.array([len(p) // UNIT for p in parts], np.int64)
    blocks = np.array(sizes, np.int64)
    first = np.cumsum(blocks) - blocks
    raw = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, UNIT)
    values = np.zeros((int(blocks.sum()), UNIT), np.int16)
    values[np.repeat(first - (np.cumsum(used) - used), used) + np.arange(len(raw))] = ((raw.astype(np.int16) - CENTRE + 128) & 255) - 128
    n = len(values)
    within = np.arange(n) - np.repeat(first, blocks)
    starts = within % INTERVAL == 0
    last = np.append(starts[1:], True)

    dc = values[:, 0].astype(np.int64)
    step = dc - np.where(starts, 0, np.append(0, dc[:-1]))
    ac = values[:, 1:]
    flat = np.flatnonzero(ac)
    block, place = flat // 63, flat % 63
    count = np.bincount(block, minlength=n)
    opens = np.append(True, block[1:] != block[:-1]) if len(block) else np.zeros(0, bool)
    run = np.where(opens, place, place - np.append(0, place[:-1]) - 1)
    final = np.full(n, -1)
    final[block] = place  # the last one stays
    ends = final < 62

    room = 1 + count + ends + last  # one of padding closes an interval
    at = np.cumsum(room) - room
    value, bits = np.zeros(int(room.sum()), np.uint64), np.zeros(int(room.sum()), np.int64)
    size = _sizes(step)
    value[at] = _DC_CODE[size] << size.astype(np.uint64) | _magnitude(step, size)
    bits[at] = _DC_BITS[size] + size
    v = ac.ravel()[flat].astype(np.int64)
    size = _sizes(v)
    symbol = (run % 16) << 4 | size
    own = _AC_CODE[symbol] << size.astype(np.uint64) | _magnitude(v, size)
    length = _AC_BITS[symbol] + size
    for k in (1, 2, 3):
        far = run >= 16 * k
        if far.any():
            own[far] |= _AC_CODE[ZRL] << length[far].astype(np.uint64)
            length[far] += _AC_BITS[ZRL]
    slot = at[block] + 1 + np.arange(len(flat)) - (np.cumsum(count) - count)[block]
    value[slot], bits[slot] = own, length
    slot = (at + 1 + count)[ends]
    value[slot], bits[slot] = _AC_CODE[EOB], _AC_BITS[EOB]
    begin = at[starts]
    total = np.add.reduceat(bits, begin)
    close = (at + room - 1)[last]
    bits[close] = -total % 8
    value[close] = (1 << bits[close]).astype(np.uint64) - np.uint64(1)
    nbytes = (total + 7) // 8

    place = np.cumsum(bits) - bits
    word, shift = place >> 6, place & 63
    over = shift + bits - 64
    words = np.zeros(int(nbytes.sum()) // 8 + 2, np.uint64)
    part = np.where(over > 0, value >> np.maximum(over, 0).astype(np.uint64), value << np.maximum(-over, 0).astype(np.uint64) % np.uint64(64))
    part[bits == 0] = 0
    heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    words[word[heads]] = np.bitwise_or.reduceat(part, heads)
    cross = np.flatnonzero(over > 0)
    words[word[cross] + 1] |= value[cross] << (64 - over[cross]).astype(np.uint64)
    data = words.astype(">u8").view(np.uint8)[: int(nbytes.sum())]

    # stuffing after each 0xFF, and a restart marker after each interval but a file's last
    full = data == 0xFF
    ordinal = (within // INTERVAL)[starts]
    closing = np.append(ordinal[1:] == 0, True)
    ahead = np.cumsum(np.where(closing, 0, 2)) - np.where(closing, 0, 2)
    to = np.arange(len(data)) + np.cumsum(full) - full + np.repeat(ahead, nbytes)
    out = np.zeros(len(data) + int(full.sum()) + int(2 * (~closing).sum()), np.uint8)
    out[to] = data
    ends_at = np.cumsum(nbytes) - 1
    after = to[ends_at] + 1 + full[ends_at]
    out[after[~closing]] = 0xFF
    out[after[~closing] + 1] = 0xD0 + ordinal[~closing] % 8
    stops = after[closing]
    scan = out.tobytes()
    return [scan[i:j] for i, j in zip(np.append(0, stops[:-1]).tolist(), stops.tolist())]


def parse(media: bytes) -> dict:
    """Markers of a baseline file with one component: sizes, quantisers, Huffman tables, interval, comment, where the scan lies."""
    if media[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    found: dict = {"tables": {}, "interval": 0, "comment": b""}
    at = 2
    while True:
        mark, length = media[at + 1], int.from_bytes(media[at + 2 : at + 4], "big")
        body = media[at + 4 : at + 2 + length]
        if media[at] != 0xFF:
            raise ValueError("no marker")
        if mark == 0xC0:
            depth, high, wide, parts = struct.unpack(">BHHB", body[:6])
            if depth != 8 or parts != 1:
                raise ValueError("one component of 8 bits is read")
            found |= {"wide": wide, "high": high}
        elif mark == 0xDB:
            found["dc_step"] = body[1]
        elif mark == 0xC4:
            while body:
                n = sum(body[1:17])
                found["tables"][body[0]] = body[1 : 17 + n]
                body = body[17 + n :]
        elif mark == 0xDD:
            found["interval"] = int.from_bytes(body, "big")
        elif mark == 0xFE:
            found["comment"] = body
        elif 0xC1 <= mark <= 0xCF:
            raise ValueError("not baseline")
        at += 2 + length
        if mark == 0xDA:
            return found | {"scan": at}


def lookup(dc: bytes, ac: bytes) -> np.ndarray:
    """For 16 bits ahead, AC first, then DC: code length, size << 8, run << 16."""
    out = np.zeros(2 << 16, np.int32)
    for base, table in ((0, ac), (1 << 16, dc)):
        code, k = 0, 16
        for n in range(1, 17):
            for _ in range(table[n - 1]):
                s = table[k]
                low = base + (code << (16 - n))
                out[low : low + (1 << (16 - n))] = n | (s & 15) << 8 | (s >> 4) << 16
                code, k = code + 1, k + 1
            code <<= 1
    return out


def decode(media: list[bytes]) -> list[tuple[dict, np.ndarray]]:
    """(markers, coefficients (blocks, 64) in scan order) per file; files with equal tables are decoded together, long ones in runs."""
    heads = [parse(m) for m in media]
    out: list = [None] * len(media)
    groups: dict = {}
    for i, h in enumerate(heads):
        groups.setdefault((h["tables"][0x00], h["tables"][0x10], h["interval"]), []).append(i)
    for (dc, ac, interval), own in groups.items():
        table = lookup(dc, ac)
        sizes = {i: -(-heads[i]["wide"] // 8) * -(-heads[i]["high"] // 8) for i in own}
        short = [i for i in own if not interval or sizes[i] <= RUN]
        for a, b in _chunks([sizes[i] * UNIT for i in short], BATCH):
            some = short[a:b]
            blocks = np.array([sizes[i] for i in some], np.int64)
            values = _scans([media[i][heads[i]["scan"] : -2] for i in some], blocks, table, interval or int(blocks.max()))
            for i, part in zip(some, np.split(values, np.cumsum(blocks)[:-1])):
                out[i] = (heads[i], part)
        for i in own:
            if interval and sizes[i] > RUN:
                out[i] = (heads[i], _runs(memoryview(media[i])[heads[i]["scan"] : -2], sizes[i], table, interval))
    return out


def _runs(scan: memoryview, blocks: int, table: np.ndarray, interval: int) -> np.ndarray:
    """Coefficients of one long scan, decoded in runs of whole intervals."""
    raw = np.frombuffer(scan, np.uint8)
    marks = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] >= 0xD0) & (raw[1:] <= 0xD7))
    if len(marks) != -(-blocks // interval) - 1:
        raise ValueError("restart markers don't match the size")
    many = max(1, RUN // interval)
    out = np.empty((blocks, UNIT), np.int16)
    begin = 0
    for k in range(0, len(marks) + 1, many):
        end = int(marks[k + many - 1]) if k + many <= len(marks) else len(raw)
        first = k * interval
        own = min(many * interval, blocks - first)
        out[first : first + own] = _scans([bytes(scan[begin:end])], np.array([own], np.int64), table, interval)
        begin = end + 2
    return out


def _scans(scans: list[bytes], blocks: np.ndarray, table: np.ndarray, interval: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(scans) + b"\0", np.uint8)
    after = np.append(False, raw[:-1] == 0xFF)
    stuffed = after & (raw == 0)
    marker = after & (raw >= 0xD0) & (raw <= 0xD7)
    drop = stuffed | marker | np.append(marker[1:], False)
    kept = np.cumsum(~drop) - ~drop  # place of each byte, or of the next kept one
    sizes = np.array([len(s) for s in scans], np.int64)
    begins = np.sort(np.concatenate([kept[np.cumsum(sizes) - sizes], kept[np.flatnonzero(marker) + 1]]))
    data = np.append(raw[~drop], np.zeros(8, np.uint8))
    ahead = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1)).copy().view(">u8").ravel().astype(np.uint64)

    pieces = -(-blocks // interval)
    file = np.repeat(np.arange(len(blocks)), pieces)
    nth = np.arange(len(file)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    block = (np.cumsum(blocks) - blocks)[file] + nth * interval
    stop = np.minimum(block + interval, np.cumsum(blocks)[file])
    if len(begins) != len(block):
        raise ValueError("restart markers don't match the size")
    bit, k, before = begins * 8, np.zeros(len(block), np.int64), np.zeros(len(block), np.int64)
    out = np.zeros(int(blocks.sum()) * UNIT, np.int16)
    seven, sixty3, one = np.uint64(7), np.uint64(63), np.uint64(1)
    while len(block):
        b = bit.astype(np.uint64)
        x = ahead[bit >> 3] << (b & seven)
        direct = k == 0
        e = table[(x >> np.uint64(48)).astype(np.int64) + (direct << 16)]
        length, size, run = e & 255, (e >> 8) & 255, (e >> 16).astype(np.int64)
        v = (((x << length.astype(np.uint64)) >> one) >> (sixty3 - size.astype(np.uint64))).astype(np.int64)
        v = np.where(v >> np.maximum(size - 1, 0) == 0, v - (1 << size.astype(np.int64)) + 1, v)  # 0 for size 0
        bit = bit + length + size
        before = np.where(direct, before + v, before)
        k = k + run
        live = direct | (size > 0)
        out[(block * UNIT + k)[live]] = np.where(direct, before, v)[live]
        k = np.where(live | (run == 15), k + 1, UNIT)
        over = k >= UNIT
        if over.any():
            block, k = block + over, np.where(over, 0, k)
            on = block < stop
            if not on.all():
                bit, k, before, block, stop = bit[on], k[on], before[on], block[on], stop[on]
    return out.reshape(-1, UNIT)


def thumbnail_hashes(shapes: np.ndarray, dc: np.ndarray) -> np.ndarray:
    """64-bit average hash of DC-only luminance thumbnails: shapes (files, 2) of blocks across and down, dc of all blocks.

    A pixel is its block's mean, DC / 8 + 128, clipped to 0 to 255. The thumbnail falls into 8 x 8 cells; a bit is 1 where a
    cell is lighter than the whole; cells without a pixel are 0.
    """
    blocks = shapes.prod(1)
    file = np.repeat(np.arange(len(shapes)), blocks)
    nth = np.arange(len(dc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    pixel = np.clip(np.rint(dc / 8 + 128), 0, 255)
    wide, high = shapes[file, 0], shapes[file, 1]
    cell = file * 64 + (nth // wide) * 8 // high * 8 + (nth % wide) * 8 // wide
    sums, counts = np.bincount(cell, pixel, len(shapes) * 64), np.bincount(cell, minlength=len(shapes) * 64)
    mean = np.bincount(file, pixel, len(shapes)) / blocks
    bits = (sums > counts * np.repeat(mean, 64)).reshape(-1, 64)
    return np.packbits(bits, axis=1).view(">u8").ravel()


def to_bytes(markers: dict, values: np.ndarray) -> bytes:
    """The payload that encode() stored."""
    n = int(markers["comment"].removeprefix(b"payload "))
    return ((values.ravel()[:n] + CENTRE) & 255).astype(np.uint8).tobytes()


def _chunks(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    first = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield first, i
            first, held = i, 0
        held += n
    if first < len(sizes):
        yield first, len(sizes)


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) of every row: its text as UTF-8, bytes 0 up to a positive multiple of 64, as a JPEG file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_batches(batches):
            media = encode([t + bytes(-len(t) % UNIT or (0 if t else UNIT)) for t in texts])
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int"


def features(stored: DataFrame) -> DataFrame:
    """Reads stored media back: sizes, hashes of the payload and of the media, and the thumbnail's size and hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stored_ = batch.column(2)
            for i, j in _chunks(pa.compute.binary_length(stored_).to_pylist(), BATCH):
                media = stored_.slice(i, j - i).to_pylist()
                found = decode(media)
                shapes = np.array([(h["wide"] // 8, h["high"] // 8) for h, _ in found], np.int64)
                hashes = thumbnail_hashes(shapes, np.concatenate([v[:, 0] * np.int64(h["dc_step"]) for h, v in found]))
                payloads = [to_bytes(h, v) for h, v in found]
                columns = [
                    batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array([len(p) for p in payloads], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in payloads]), pa.array([zlib.crc32(p[-UNIT:]) for p in payloads], pa.int64()),
                    pa.array([len(m) for m in media], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media]),
                    pa.array([f"{a}x{b}:{h:016x}" for (a, b), h in zip(shapes.tolist(), hashes.tolist())]),
                    pa.array(shapes[:, 0] * 8, pa.int32()), pa.array(shapes[:, 1] * 8, pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in DIGEST.split(", ")])

    return stored.mapInArrow(run, DIGEST)


def media(docs: DataFrame) -> DataFrame:
    """Stores every row's text and reads it back; see store() and features().

    A null text is empty, and an empty one 64 bytes 0. Rows that repeat, or whose doc_id is null, come back like any other. Other
    columns are left out. An empty table gives no rows.
    """
    return features(store(docs))
