"""Matroska media columns (operator 3): EBML elements, clusters, lacing and cues to packet tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

EBML, SEGMENT, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1F43B675, 0x1C53BB6B
SEEK, INFO, TRACKS, TAGS, CHAPTERS, ATTACHMENTS = 0x114D9B74, 0x1549A966, 0x1654AE6B, 0x1254C367, 0x1043A770, 0x1941A469
#: Elements that end a cluster of unknown size.
_TOP = frozenset((EBML, SEGMENT, CLUSTER, CUES, SEEK, INFO, TRACKS, TAGS, CHAPTERS, ATTACHMENTS))


class Damaged(ValueError):
    pass


class Packet(NamedTuple):
    track: int
    codec: str | None
    timestamp_ns: int
    duration_ns: int | None
    keyframe: bool
    cluster: int
    cluster_offset: int  # where the cluster element begins
    lace: int  # place in the block's lace; 0 without lacing
    block_offset: int  # where the block or block group element begins
    byte_offset: int
    n_bytes: int
    cued: bool  # a cue leads to this block; of a lace, to its first frame


class Cue(NamedTuple):
    track: int
    timestamp_ns: int
    cluster_offset: int | None  # where the cue says that the cluster begins
    block_offset: int | None  # where the block that it leads to begins
    packet: int | None  # number of that block's first packet in the file
    byte_offset: int | None
    n_bytes: int | None


def vint(b: bytes, at: int, end: int) -> tuple[int, int, bool]:
    """(value, next position, all ones) of a variable-length integer without its marker bit."""
    if at >= end or not b[at]:
        raise Damaged(f"no integer at {at}")
    n = 9 - b[at].bit_length()
    if at + n > end:
        raise Damaged(f"integer cut off at {at}")
    v = int.from_bytes(b[at : at + n], "big") & ((1 << 7 * n) - 1)
    return v, at + n, v == (1 << 7 * n) - 1


def element(b: bytes, at: int, end: int) -> tuple[int, int, int | None]:
    """(id, start of data, end of data or None where the size is unknown)."""
    if at >= end or not b[at] or b[at] < 0x10:
        raise Damaged(f"no element at {at}")
    n = 9 - b[at].bit_length()
    if at + n > end:
        raise Damaged(f"element cut off at {at}")
    size, data, unknown = vint(b, at + n, end)
    if unknown:
        return int.from_bytes(b[at : at + n], "big"), data, None
    if data + size > end:
        raise Damaged(f"element at {at} ends beyond its parent")
    return int.from_bytes(b[at : at + n], "big"), data, data + size


def _uint(b: bytes, lo: int, hi: int) -> int:
    return int.from_bytes(b[lo:hi], "big")


def lace_sizes(b: bytes, at: int, end: int, kind: int) -> tuple[list[int], int]:
    """(sizes of the frames, where they begin); kind: 0 none, 1 Xiph, 2 fixed, 3 EBML."""
    if not kind:
        return [end - at], at
    if at >= end:
        raise Damaged(f"no lace count at {at}")
    count, at = b[at] + 1, at + 1
    if kind == 2:
        if (end - at) % count:
            raise Damaged(f"fixed lace at {at} doesn't divide")
        return [(end - at) // count] * count, at
    sizes: list[int] = []
    if kind == 1:
        for _ in range(count - 1):
            n = 0
            while True:
                if at >= end:
                    raise Damaged(f"lace cut off at {at}")
                n += b[at]
                at += 1
                if b[at - 1] != 255:
                    break
            sizes.append(n)
    elif count > 1:
        n, at, _ = vint(b, at, end)
        sizes.append(n)
        for _ in range(count - 2):
            width = 9 - b[at].bit_length() if at < end else 0
            d, at, _ = vint(b, at, end)
            n += d - ((1 << 7 * width - 1) - 1)
            sizes.append(n)
    last = end - at - sum(sizes)
    if last < 0 or any(n < 0 for n in sizes):
        raise Damaged(f"lace at {at} is larger than its block")
    return [*sizes, last], at


class _Block(NamedTuple):
    track: int
    ticks: int
    duration: int | None
    key: bool
    cluster: int
    offset: int
    frames: list[tuple[int, int]]  # (first byte, bytes)


class _Cluster(NamedTuple):
    offset: int
    data: int


class _Mark(NamedTuple):
    """A cue as it stands in the file; positions count from the segment's data, or from the cluster's."""

    track: int
    ticks: int
    cluster: int | None
    block: int | None
    nth: int | None


class _Segment:
    """What a segment says, put together when all of it is read: cues and tracks may stand before or after what they speak of."""

    def __init__(self, data: int, first_cluster: int):
        self.data, self.first_cluster = data, first_cluster
        self.scale = 1_000_000
        self.tracks: dict[int, tuple[str | None, int | None]] = {}
        self.clusters: list[_Cluster] = []
        self.blocks: list[_Block] = []
        self.marks: list[_Mark] = []

    def target(self, m: _Mark, within: dict[int, list[int]], at: dict[int, int]) -> int | None:
        """The block that a cue leads to: the one at its place in the cluster, the one of its number, or else the track's first
        of its time there. Without a place of the cluster, the track's first of its time in the segment."""
        if m.cluster is None:
            own = range(len(self.blocks))
        else:
            c = at.get(self.data + m.cluster)
            if c is None:
                return None
            own = within.get(c, [])
            if m.block is not None:
                place = self.clusters[c - self.first_cluster].data + m.block
                return next((i for i in own if self.blocks[i].offset == place and self.blocks[i].track == m.track), None)
            if m.nth is not None:
                i = own[m.nth - 1] if 0 < m.nth <= len(own) else None
                return i if i is not None and self.blocks[i].track == m.track else None
        return next((i for i in own if self.blocks[i].track == m.track and self.blocks[i].ticks == m.ticks), None)

    def tables(self, before: int) -> tuple[list[Packet], list[Cue]]:
        """Packets and cues; ``before`` packets of the file come first."""
        within: dict[int, list[int]] = {}
        by_time: dict[tuple[int, int], int] = {}
        for i, x in enumerate(self.blocks):
            within.setdefault(x.cluster, []).append(i)
            by_time.setdefault((x.track, x.ticks), i)
        at = {c.offset: self.first_cluster + n for n, c in enumerate(self.clusters)}
        targets = [by_time.get((m.track, m.ticks)) if m.cluster is None else self.target(m, within, at) for m in self.marks]
        cued = set(targets)
        packets: list[Packet] = []
        first: list[int] = []
        for i, x in enumerate(self.blocks):
            codec, default = self.tracks.get(x.track, (None, None))
            begin, n = x.ticks * self.scale, len(x.frames)
            first.append(before + len(packets))
            for k, (offset, size) in enumerate(x.frames):
                if x.duration is None:
                    after, span = k * (default or 0), default
                else:  # the block's duration is that of all its frames
                    after = x.duration * self.scale * k // n
                    span = x.duration * self.scale * (k + 1) // n - after
                packets.append(Packet(x.track, codec, begin + after, span, x.key, x.cluster, self.clusters[x.cluster - self.first_cluster].offset, k, x.offset, offset, size, not k and i in cued))
        cues = []
        for m, i in zip(self.marks, targets):
            place = None if m.cluster is None else self.data + m.cluster
            if i is None:
                cues.append(Cue(m.track, m.ticks * self.scale, place, None, None, None, None))
            else:
                x = self.blocks[i]
                cues.append(Cue(m.track, m.ticks * self.scale, place, x.offset, first[i], *x.frames[0]))
        return packets, cues


def read(b: bytes) -> tuple[list[Packet], list[Cue], str | None]:
    """(packets in file order, cues in file order, what is damaged or None). What comes before the damage is kept."""
    segments: list[_Segment] = []
    count = 0

    def block(s: _Segment, offset: int, lo: int, hi: int, time: int, key: bool | None, duration: int | None) -> None:
        track, at, _ = vint(b, lo, hi)
        if at + 3 > hi:
            raise Damaged(f"block cut off at {lo}")
        rel = int.from_bytes(b[at : at + 2], "big", signed=True)
        flags = b[at + 2]
        sizes, at = lace_sizes(b, at + 3, hi, (flags >> 1) & 3)
        frames = []
        for size in sizes:
            frames.append((at, size))
            at += size
        s.blocks.append(_Block(track, time + rel, duration, bool(flags & 0x80) if key is None else key, count - 1, offset, frames))

    def cluster(s: _Segment, lo: int, hi: int | None, end: int) -> int:
        at, time, stop = lo, 0, end if hi is None else hi
        while at < stop:
            i, d, e = element(b, at, stop)
            if hi is None and i in _TOP:
                return at
            if e is None:
                raise Damaged(f"unknown size inside a cluster at {at}")
            if i == 0xE7:
                time = _uint(b, d, e)
            elif i == 0xA3:
                block(s, at, d, e, time, None, None)
            elif i == 0xA0:
                inner, span, referenced = None, None, False
                for j, x, y in children(d, e):
                    if j == 0xA1:
                        inner = (x, y)
                    elif j == 0x9B:
                        span = _uint(b, x, y)
                    elif j == 0xFB:
                        referenced = True
                if inner:
                    block(s, at, *inner, time, not referenced, span)
            at = e
        return stop

    def children(lo: int, hi: int) -> Iterator[tuple[int, int, int]]:
        while lo < hi:
            i, d, e = element(b, lo, hi)
            if e is None:
                raise Damaged(f"unknown size at {lo}")
            yield i, d, e
            lo = e

    def cue(s: _Segment, lo: int, hi: int) -> None:
        when, places = 0, []
        for k, p, q in children(lo, hi):
            if k == 0xB3:
                when = _uint(b, p, q)
            elif k == 0xB7:
                places.append({m: _uint(b, u, v) for m, u, v in children(p, q) if m in (0xF7, 0xF1, 0xF0, 0x5378)})
        s.marks += [_Mark(x.get(0xF7, 0), when, x.get(0xF1), x.get(0xF0), x.get(0x5378)) for x in places]

    error = None
    try:
        if not b:
            raise Damaged("empty")
        i, d, e = element(b, 0, len(b))
        if i != EBML or e is None:
            raise Damaged("no EBML header")
        at = e
        while at < len(b):
            i, d, e = element(b, at, len(b))
            if i != SEGMENT:
                if e is None:
                    raise Damaged(f"unknown size at {at}")
                at = e
                continue
            stop = len(b) if e is None else e
            s = _Segment(d, count)
            segments.append(s)
            at = d
            while at < stop:
                i, d, e = element(b, at, stop)
                if i == CLUSTER:
                    s.clusters.append(_Cluster(at, d))
                    count += 1
                    at = cluster(s, d, e, stop)
                    continue
                if e is None:
                    raise Damaged(f"unknown size at {at}")
                if i == INFO:
                    for j, x, y in children(d, e):
                        s.scale = _uint(b, x, y) if j == 0x2AD7B1 else s.scale
                elif i == TRACKS:
                    for j, x, y in children(d, e):
                        if j == 0xAE:
                            t: dict[int, Any] = {k: b[p:q] for k, p, q in children(x, y)}
                            s.tracks[_uint(t.get(0xD7, b""), 0, 8)] = (t.get(0x86, b"").decode("ascii", "replace") or None, _uint(t[0x23E383], 0, 8) if 0x23E383 in t else None)
                elif i == CUES:
                    for j, x, y in children(d, e):
                        if j == 0xBB:
                            cue(s, x, y)
                at = e
    except Damaged as x:
        error = str(x)
    packets: list[Packet] = []
    cues: list[Cue] = []
    for s in segments:
        p, c = s.tables(len(packets))
        packets += p
        cues += c
    return packets, cues, error


def parse(b: bytes) -> tuple[list[Packet], str | None]:
    """(packets in file order, what is damaged or None)."""
    packets, _, error = read(b)
    return packets, error


_PACKET = "doc_id bigint, packet_no int, track int, codec string, timestamp_ns bigint, duration_ns bigint, keyframe boolean, cluster int, cluster_offset bigint, lace int, block_offset bigint, byte_offset bigint, n_bytes bigint, cued boolean, error string"
_CUE = "doc_id bigint, cue_no int, track int, timestamp_ns bigint, cluster_offset bigint, block_offset bigint, packet_no int, byte_offset bigint, n_bytes bigint"
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
_FLUSH = 50_000  # rows a batch that goes back to Spark


def _table(media: DataFrame, key: str, blob: str, schema: str, rows_of: Callable[[Any, bytes], Iterable[tuple]]) -> DataFrame:
    names, types = zip(*(x.strip().split() for x in schema.split(",")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [[]] * len(names)
            out = pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, t in zip(cols, types)], list(names))
            rows.clear()
            return out

        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if data.is_valid:
                    rows += rows_of(k, data.as_py())  # one file at a time
                    if len(rows) > _FLUSH:
                        yield flush()
        yield flush()

    return media.select(key, blob).mapInArrow(run, schema)


def packets(media: DataFrame, key: str = "doc_id", blob: str = "media") -> DataFrame:
    """One row a packet of each file: its number in the file, track, codec, time, duration, keyframe, cluster (number and place),
    place in the lace, places of the block and of the packet's own bytes in the column, whether a cue leads to it.

    A null file has no rows. A damaged or empty one has the packets before the damage and one row with ``error`` and no
    packet. A null key stays null; repeated rows give repeated packets; columns besides the two named are not read. Spark
    hands over files in batches of bounded bytes; long ones are read one at a time.
    """

    def rows_of(k: Any, data: bytes) -> Iterator[tuple]:
        found, error = parse(data)
        yield from ((k, n, *p, None) for n, p in enumerate(found))
        if error:
            yield (k, *[None] * 13, error)

    return _table(media, key, blob, _PACKET, rows_of)


def cues(media: DataFrame, key: str = "doc_id", blob: str = "media") -> DataFrame:
    """One row a cue and track of each file: its number in the file, track, time, the cluster's place, and the packet that it
    leads to with its byte range; nulls where it leads to none. Odd files as in ``packets``, without rows for errors."""
    return _table(media, key, blob, _CUE, lambda k, data: ((k, n, *c) for n, c in enumerate(read(data)[1])))


# ---- writing ----
def _size(n: int, width: int = 0) -> bytes:
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def el(i: int, data: bytes, unknown: bool = False) -> bytes:
    return i.to_bytes((i.bit_length() + 7) // 8, "big") + (b"\x01" + b"\xff" * 7 if unknown else _size(len(data))) + data


def _num(i: int, v: int) -> bytes:
    return el(i, v.to_bytes(max(1, (v.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: int) -> bytes:
    """Lace header and frames."""
    if not kind:
        return frames[0]
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if kind == 1:
        for n in sizes[:-1]:
            head += b"\xff" * (n // 255) + bytes([n % 255])
    elif kind == 3 and len(frames) > 1:
        head += _size(sizes[0])
        for a, c in zip(sizes, sizes[1:-1]):
            width = next(w for w in range(1, 9) if abs(c - a) < (1 << 7 * w - 1) - 1)
            head += _size(c - a + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def mux(lines: list[bytes], tick_ms: int = 1000, unknown: bool = False, per_cluster: int = 16) -> bytes:
    """A file with the lines as subtitle packets on track 1, ``tick_ms`` apart: one block alone, then laces of three in turn
    Xiph, fixed (where sizes agree, else EBML) and EBML; every other single block is a block group with a duration."""
    info = el(INFO, _num(0x2AD7B1, 1_000_000))
    track = el(TRACKS, el(0xAE, _num(0xD7, 1) + _num(0x73C5, 1) + _num(0x83, 0x11) + el(0x86, b"S_TEXT/UTF8") + _num(0x23E383, tick_ms * 1_000_000)))
    body, cues, turn = info + track, b"", 0
    for c in range(0, len(lines), per_cluster):
        own, at, data = lines[c : c + per_cluster], 0, _num(0xE7, c * tick_ms)
        while at < len(own):
            kind = turn % 4
            frames = own[at : at + (3 if kind else 1)]
            if kind == 2 and len({len(f) for f in frames}) > 1:
                kind = 3
            block = b"\x81" + (at * tick_ms).to_bytes(2, "big")
            if not kind and turn % 8:
                data += el(0xA0, el(0xA1, block + b"\x00" + frames[0]) + _num(0x9B, tick_ms))
            else:
                data += el(0xA3, block + bytes([0x80 | kind << 1]) + lace(frames, kind))
            at += len(frames)
            turn += 1
        relative = _num(0xF0, len(_num(0xE7, c * tick_ms))) if c // per_cluster % 2 else b""
        cues += el(0xBB, _num(0xB3, c * tick_ms) + el(0xB7, _num(0xF7, 1) + _num(0xF1, len(body)) + relative))
        body += el(CLUSTER, data, unknown)
    return el(EBML, el(0x4282, b"matroska") + _num(0x4287, 4) + _num(0x4285, 2)) + el(SEGMENT, body + el(CUES, cues), unknown)


def mux_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, media): each document as a subtitle file, a packet a line; null text has a null file. Odd identifiers get
    elements of unknown size."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for lo in range(0, len(keys), 512):
                files = [mux(t.as_py().encode().split(b"\n"), unknown=bool(k and k % 2)) if t.is_valid else None for k, t in zip(keys[lo : lo + 512], batch.column(1)[lo : lo + 512])]
                yield pa.RecordBatch.from_arrays([pa.array(keys[lo : lo + 512], pa.int64()), pa.array(files, pa.binary())], ["doc_id", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, media binary")
