"""Files put together byte by byte from the format's description, and a second reader, slow and plain, over odd files."""

from __future__ import annotations

import random

import pytest

from tidemark.llm import matroska

HEAD = bytes.fromhex("1A45DFA3 8B 4282 88") + b"matroska"


def hexed(s: str) -> bytes:
    return bytes.fromhex(s)


def test_laces_by_hand():
    # Two tracks; ticks of 0.5 ms; a cluster at tick 100 with, in turn: an EBML lace of 4 frames of 5, 3, 70 and 2 bytes (first
    # size 85, then -2 as BD of 7 bits, +67 in two bytes), a Xiph lace of 300 and 1 bytes in a group that lasts 7 ticks, two
    # fixed frames of 2 bytes three ticks before the cluster's time, and a plain block.
    info = hexed("1549A966 87 2AD7B1 83 07A120")
    tracks = hexed("1654AE6B A4 AE 8F D7 81 01 86 85") + b"V_VP9" + hexed("23E383 81 0A".replace(" ", "")) + hexed("AE 91 D7 81 02 86 8C") + b"A_OPUS_LONGX"
    ebml = hexed("81 0005 86 03 85 BD 6042".replace(" ", "")) + b"a" * 5 + b"b" * 3 + b"c" * 70 + b"d" * 2
    xiph = hexed("82 0000 02 01 FF 2D".replace(" ", "")) + b"e" * 300 + b"f"
    fixed = hexed("82 FFFD 84 01".replace(" ", "")) + b"ghij"
    plain = hexed("81 0007 00".replace(" ", "")) + b"k"
    blocks = [hexed("A3") + bytes([0x80 | len(ebml)]) + ebml, hexed("A0 413D A1 4134".replace(" ", "")) + xiph + hexed("9B 81 07 FB 81 FF"), hexed("A3") + bytes([0x80 | len(fixed)]) + fixed, hexed("A3 85") + plain]
    assert len(xiph) == 0x134 and len(blocks[1]) == 3 + 0x13D
    time = hexed("E7 81 64")
    cluster = hexed("1F43B675 01000000000001") + bytes([len(time) + sum(map(len, blocks)) - 256]) + time + b"".join(blocks)
    blob = HEAD + hexed("18538067 01FFFFFFFFFFFFFF") + info + tracks + cluster
    start = len(HEAD) + 12 + len(info) + len(tracks)
    at = [start + 12 + 3]
    for x in blocks:
        at.append(at[-1] + len(x))
    got, error = matroska.parse(blob)
    assert error is None
    assert [blob[p.byte_offset : p.byte_offset + p.n_bytes] for p in got] == [b"aaaaa", b"bbb", b"c" * 70, b"dd", b"e" * 300, b"f", b"gh", b"ij", b"k"]
    half = 500_000
    assert [p.timestamp_ns for p in got] == [105 * half, 105 * half + 10, 105 * half + 20, 105 * half + 30, 100 * half, 100 * half + 7 * half // 2, 97 * half, 97 * half, 107 * half]
    assert [p.duration_ns for p in got] == [10, 10, 10, 10, 7 * half // 2, 7 * half // 2, None, None, 10]
    assert [p.track for p in got] == [1, 1, 1, 1, 2, 2, 2, 2, 1] and [p.codec for p in got][3:5] == ["V_VP9", "A_OPUS_LONGX"]
    assert [p.keyframe for p in got] == [True] * 4 + [False] * 2 + [True] * 2 + [False]
    assert [p.block_offset for p in got] == [at[0]] * 4 + [at[1]] * 2 + [at[2]] * 2 + [at[3]] and {p.cluster_offset for p in got} == {start}


def test_cues_by_hand():
    # Cues before the clusters: by time within a cluster, by place in it, by number, at no cluster, for a track that isn't there.
    def cluster(tick, *blocks):
        body = hexed("E7 81") + bytes([tick]) + b"".join(hexed("A3 85") + bytes([0x80 | t, 0, rel, 0x80]) + b"x" for t, rel in blocks)
        return hexed("1F43B675") + bytes([0x80 | len(body)]) + body

    one, two = cluster(10, (1, 0), (2, 0), (1, 5)), cluster(20, (2, 0), (1, 0), (1, 1))

    def cues(size):
        def point(tick, *fields):
            inner = b"".join(i + bytes([0x80 | 1, v]) for i, v in fields)
            body = hexed("B3 81") + bytes([tick]) + hexed("B7") + bytes([0x80 | len(inner)]) + inner
            return hexed("BB") + bytes([0x80 | len(body)]) + body

        t, c, r, n = b"\xf7", b"\xf1", b"\xf0", b"\x53\x78"
        a, b = size, size + len(one)
        body = point(15, (t, 1), (c, a)) + point(20, (t, 1), (c, b), (r, 3 + 7)) + point(99, (t, 2), (c, b), (n, 1)) + point(20, (t, 1), (c, b + 1)) + point(20, (t, 3), (c, b)) + point(20, (t, 1)) + point(10, (t, 1), (c, b))
        return hexed("1C53BB6B 40") + bytes([len(body)]) + body

    head = cues(len(cues(0)))
    body = head + one + two
    blob = HEAD + hexed("18538067 40") + bytes([len(body)]) + body
    base = len(HEAD) + 6
    found, got, error = matroska.read(blob)
    assert error is None and len(found) == 6
    a, b = base + len(head), base + len(head) + len(one)
    assert [(c.track, c.timestamp_ns, c.cluster_offset, c.packet) for c in got] == [
        (1, 15_000_000, a, 2), (1, 20_000_000, b, 4), (2, 99_000_000, b, 3), (1, 20_000_000, b + 1, None), (3, 20_000_000, b, None), (1, 20_000_000, None, 4), (1, 10_000_000, b, None),
    ]
    for c in got:
        if c.packet is not None:
            p = found[c.packet]
            assert (p.block_offset, p.byte_offset, p.n_bytes) == (c.block_offset, c.byte_offset, c.n_bytes) and blob[p.block_offset] == 0xA3 and p.cued
    assert [p.cued for p in found] == [False, False, True, True, True, False]


# ---- a second reader ----
MASTERS = {0x18538067, 0x1F43B675, 0xA0, 0x1C53BB6B, 0xBB, 0xB7, 0x1654AE6B, 0xAE, 0x1549A966}


def bits(n: int, width: int) -> str:
    return format(n, f"0{width}b")


def number(blob, at, keep):
    """A variable-length number by its bits."""
    s = bits(blob[at], 8)
    n = s.index("1") + 1
    s = "".join(bits(x, 8) for x in blob[at : at + n])
    return int(s if keep else s[n:], 2), n, set(s[n:]) == {"1"}


def tree(blob, at, end, level):
    """[(id, first byte, data's first byte, data's end, children)]; an element of unknown size ends where one of its level or above begins."""
    out = []
    while at < end:
        i, n, _ = number(blob, at, True)
        size, m, unknown = number(blob, at + n, False)
        data = at + n + m
        if unknown and i == 0x18538067:
            stop = end
        elif unknown:
            stop, p = end, data
            while p < end:
                j, a, _ = number(blob, p, True)
                if j in (0x1F43B675, 0x1C53BB6B, 0x1654AE6B, 0x1549A966):
                    stop = p
                    break
                size, c, _ = number(blob, p + a, False)
                p += a + c + size
        else:
            stop = data + size
        out.append((i, at, data, stop, tree(blob, data, stop, level + 1) if i in MASTERS else []))
        at = stop
    return out


def slow(blob):
    value = lambda e: int.from_bytes(blob[e[2] : e[3]], "big")
    seg = next(e for e in tree(blob, 0, len(blob), 0) if e[0] == 0x18538067)
    default = {}
    for tracks in (e for e in seg[4] if e[0] == 0x1654AE6B):
        for entry in tracks[4]:
            default[next(value(e) for e in entry[4] if e[0] == 0xD7)] = next(value(e) for e in entry[4] if e[0] == 0x23E383)
    out = []
    for n, c in enumerate(e for e in seg[4] if e[0] == 0x1F43B675):
        base = next(value(e) for e in c[4] if e[0] == 0xE7)
        for e in c[4]:
            if e[0] not in (0xA3, 0xA0):
                continue
            inner = e if e[0] == 0xA3 else next(x for x in e[4] if x[0] == 0xA1)
            spans = [value(x) for x in e[4] if x[0] == 0x9B]
            track, k, _ = number(blob, inner[2], False)
            at = inner[2] + k
            rel = (blob[at] << 8 | blob[at + 1]) - (65536 if blob[at] >= 128 else 0)
            kind, at = bits(blob[at + 2], 8)[5:7], at + 3
            sizes = []
            if kind != "00":
                frames, at = blob[at] + 1, at + 1
                if kind == "01":
                    for _ in range(frames - 1):
                        size = 0
                        while blob[at] == 255:
                            size, at = size + 255, at + 1
                        sizes.append(size + blob[at])
                        at += 1
                elif kind == "11":
                    for f in range(frames - 1):
                        v, k, _ = number(blob, at, False)
                        sizes.append(v if not f else sizes[-1] + v - (2 ** (7 * k - 1) - 1))
                        at += k
                else:
                    sizes = [(inner[3] - at) // frames] * (frames - 1)
            sizes.append(inner[3] - at - sum(sizes))
            for f, size in enumerate(sizes):
                lasts = spans[0] * 1_000_000 if spans else default[track]
                out.append((track, (base + rel) * 1_000_000 + (0 if not f else f * default[track]), lasts, n, c[1], f, e[1], at, size))
                at += size
    return out


@pytest.mark.parametrize("seed", range(12))
def test_against_the_slow_reader(seed):
    rng = random.Random(seed)
    frames = [rng.randbytes(rng.choice([0, 1, 2, 126, 127, 128, 254, 255, 256, 511, 5000, 70_000])) for _ in range(rng.randrange(1, 60))]
    blob = matroska.mux(frames, rng.choice([1, 7, 1000]), bool(seed % 2), rng.choice([1, 3, 16, 30]))
    found, cues, error = matroska.read(blob)
    assert error is None
    assert [(p.track, p.timestamp_ns, p.duration_ns, p.cluster, p.cluster_offset, p.lace, p.block_offset, p.byte_offset, p.n_bytes) for p in found] == slow(blob)
    assert [c.packet for c in cues] == [i for i, p in enumerate(found) if p.cued] and all(c.cluster_offset == found[c.packet].cluster_offset for c in cues)


def test_tables(spark):
    big = [b"z" * 1_000_000] * 30
    rows = [(1, bytearray(matroska.mux([b"a", b"b", b"c"]))), (1, bytearray(matroska.mux([b"a", b"b", b"c"]))), (None, bytearray(matroska.mux([b"a"]))), (2, None), (3, bytearray(b"")), (4, bytearray(matroska.mux(big)))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, media binary, error string")
    got = matroska.cues(df).collect()
    assert sorted((r["doc_id"] or 0, r["packet_no"]) for r in got) == [(0, 0), (1, 0), (1, 0), (4, 0), (4, 16)] and matroska.cues(df.limit(0)).count() == 0
    assert matroska.packets(df).where("doc_id = 4 and n_bytes = 1000000").count() == 30
