import hashlib
import random
import subprocess
import sys
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keyloom.llm import jpeg as J


def scalar_decode(media):
    """One bit after the other, from the markers alone."""
    h = J.parse(media)
    trees = {}
    for k, table in h["tables"].items():
        code, at, tree = 0, 16, {}
        for n in range(1, 17):
            for _ in range(table[n - 1]):
                tree[n, code] = table[at]
                code, at = code + 1, at + 1
            code <<= 1
        trees[k] = tree
    raw, parts, k = media[h["scan"] : -2], [bytearray()], 0
    while k < len(raw):
        if raw[k] == 0xFF:
            if raw[k + 1] == 0:
                parts[-1].append(0xFF)
            else:
                assert raw[k + 1] == 0xD0 + (len(parts) - 1) % 8
                parts.append(bytearray())
            k += 2
        else:
            parts[-1].append(raw[k])
            k += 1
    blocks, total = [], -(-h["wide"] // 8) * -(-h["high"] // 8)
    for part in parts:
        bits, at, before = "".join(f"{b:08b}" for b in part), 0, 0

        def symbol(tree):
            nonlocal at
            n = 1
            while (n, int(bits[at : at + n], 2)) not in tree:
                n += 1
            at += n
            return tree[n, int(bits[at - n : at], 2)]

        def value(n):
            nonlocal at
            at += n
            v = int(bits[at - n : at], 2) if n else 0
            return v if not n or v >> (n - 1) else v - (1 << n) + 1

        for _ in range(min(h["interval"], total - len(blocks))):
            before += value(symbol(trees[0x00]))
            own, k = [before] + [0] * 63, 1
            while k < 64:
                s = symbol(trees[0x10])
                if s == 0:
                    break
                k += s >> 4
                if s & 15:
                    own[k] = value(s & 15)
                k += 1
            blocks.append(own)
        assert set(bits[at:]) <= {"1"} and len(bits) - at < 8
    return h, np.array(blocks)


def payloads():
    draw = random.Random(3)
    return [bytes(64), bytes([101]) * 64, bytes([101]) * 1280, b"\xff" * 640, bytes(draw.randrange(256) for _ in range(64 * 19)), bytes([101] * 50 + [7] + [101] * 13), "é漢字😀 text ".encode() * 64] + [
        bytes(draw.choices([101, 32, 0, 255, 97], [60, 1, 1, 1, 1], k=64 * draw.randrange(1, 30))) for _ in range(30)
    ]


def test_round_trip_and_a_scalar_decoder():
    own = payloads()
    media = J.encode(own)
    for p, m, (h, v) in zip(own, media, J.decode(media)):
        assert J.to_bytes(h, v) == p
        other, blocks = scalar_decode(m)
        assert (blocks == v).all() and other["wide"] == h["wide"]
        assert h["wide"] * h["high"] >= len(p)
    assert J.encode(own[3:4]) == media[3:4]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 12).flatmap(lambda n: st.binary(min_size=64 * n, max_size=64 * n)), min_size=1, max_size=6))
def test_any_payload(own):
    assert [J.to_bytes(h, v) for h, v in J.decode(J.encode(own))] == own


def test_long_payloads_are_coded_in_runs():
    draw = np.random.default_rng(2)
    sizes = [J.RUN * J.UNIT, J.RUN * J.UNIT - J.UNIT, J.RUN * J.UNIT + J.UNIT, 2 * J.BATCH + 64 * 777]
    own = [draw.choice(np.array([32, 101, 97, 110, 0, 255], np.uint8), n, p=[0.2, 0.4, 0.2, 0.17, 0.02, 0.01]).tobytes() for n in sizes] + [b"short" * 64]
    media = J.encode(own)
    for p, m, (h, v) in zip(own, media, J.decode(media)):
        assert J.to_bytes(h, v) == p
        marks = np.frombuffer(m[h["scan"] : -2], np.uint8)
        at = np.flatnonzero((marks[:-1] == 0xFF) & (marks[1:] >= 0xD0) & (marks[1:] <= 0xD7))
        assert (marks[at + 1] == 0xD0 + np.arange(len(at)) % 8).all()
    whole = J.code([own[2]], [J.grid(sizes[2] // 64)[0] * J.grid(sizes[2] // 64)[1]])[0]
    assert media[2] == J.head(sizes[2], *J.grid(sizes[2] // 64)) + whole + b"\xff\xd9"
    with pytest.raises(ValueError):
        J.decode([media[3][:40_000] + media[3][60_000:]])


def test_a_long_text_takes_little_memory():
    code = "import resource, sys; from keyloom.llm import jpeg as J; t = (b'some words of a text ' * 1_000_000)[:20_000_000 // 64 * 64]; h, v = J.decode(J.encode([t]))[0]; assert J.to_bytes(h, v) == t; print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert int(out.stdout) < 900


def test_codes_are_prefix_free_and_leave_all_ones_unused():
    for _, _, codes in (J._DC, J._AC):
        words = sorted(f"{c:0{n}b}" for c, n in codes.values())
        assert all(not b.startswith(a) for a, b in zip(words, words[1:]))
        assert all("0" in w for w in words)


def test_thumbnails():
    shapes = np.array([(16, 16), (1, 1)])
    dc = np.concatenate([np.tile(np.repeat([-800, 800], 8), 16), [0]])
    left, flat = J.thumbnail_hashes(shapes, dc)
    assert int(left) == int("0f" * 8, 16) and int(flat) == 0


@pytest.mark.parametrize("wrong", [b"", b"\xff\xd8\x00\x00\x00\x00", b"text that is no image"])
def test_what_is_no_baseline_file_is_refused(wrong):
    with pytest.raises((ValueError, IndexError)):
        J.parse(wrong)


def test_query(documents, no_documents, texts):
    def want(t):
        b = (t or "").encode()
        p = b + bytes(-len(b) % 64 or (0 if b else 64))
        return len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])

    rows = J.media(documents).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows) == sorted((str(i), *want(t)) for i, t in texts)
    same = {}
    for r in rows:
        same.setdefault(r["payload_sha256"], set()).add((r["feature"], r["media_sha256"], r["media_bytes"]))
    assert all(len(v) == 1 for v in same.values())
    assert J.media(no_documents).collect() == []
