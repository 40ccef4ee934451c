"""Passages that repeat across documents, from merged Burrows-Wheeler transforms (operator 1).

A passage is a window of ``Q * DEPTH`` = 50 words or a union of such windows. The work is cut into independent buckets by
each window's minimizer, the smallest hash of its word 8-grams: equal windows have equal minimizers, so that they meet in one
bucket. Neighbouring windows with one minimizer travel as one string of words. A first pass counts minimizers over all
documents; strings whose minimizer stands in one document only are not sent.

In a bucket, the symbols are runs of ``Q`` words; each string of words is ``Q`` strings of symbols, one for each residue. The
strings of each shard (what one or a few map tasks sent) have a Burrows-Wheeler transform of their own. All shards are merged
by interleave refinement: an interleave sorted by h symbols, read along the shards' transforms and spread stably by symbol,
is the interleave sorted by h + 1 symbols. A boundary that appears in round h separates suffixes with h - 1 common symbols;
what has no boundary after ``DEPTH`` rounds are the repeated intervals. Suffixes are never compared or sorted again.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import text as X
from tidemark.session import cut

Q, DEPTH, GRAM = 10, 5, 8
SHARD_WORDS = 1 << 17  # strings of this many words at least share a transform
GROUP_WORDS = 1 << 20  # a task takes up whole minimizers until it has this many words and windows: bounds its memory
MOST_BITS = 1 << 29  # of the broadcast filter (64 MB); where more would be due it lets more strings pass and results stay
NO_ID = -(2**63)
_LOW = np.uint64(0xFFFFFFFF)


class Strings(NamedTuple):
    """Strings of words, each with its document and the first word's place in it; or, where strings stand in several places, with
    its number and 0."""

    doc: np.ndarray
    first: np.ndarray
    length: np.ndarray
    word: np.ndarray  # uint32, all strings' words in turn


class Super(NamedTuple):
    """Runs of neighbouring windows with one minimizer, as places among a chunk's words."""

    key: np.ndarray
    row: np.ndarray
    start: np.ndarray
    windows: np.ndarray


def super_windows(t: X.Tokens, words: int = Q * DEPTH) -> Super:
    n = len(t.hash)
    none = np.zeros(0, np.int64)
    count = np.diff(t.ptr)
    if not (count >= words).any():
        return Super(np.zeros(0, np.uint64), none, none, none)
    g = np.zeros(n, np.uint64)
    for k in range(GRAM):  # grams that reach into the next document are in no window
        x = np.zeros(n, np.uint64)
        x[: n - k] = t.hash[k:]
        g = X.mix64(g * np.uint64(0xD6E8FEB86659FD93) + x)
    low = (g & ~_LOW) | np.arange(n, dtype=np.uint64)
    span, width = 1, words - GRAM + 1
    while 2 * span <= width:
        low = np.concatenate((np.minimum(low[:-span], low[span:]), low[-span:]))
        span *= 2
    if span < width:
        low = np.concatenate((np.minimum(low[: -(width - span)], low[width - span :]), low[-(width - span) :]))
    row = np.repeat(np.arange(len(count)), count)
    at = np.flatnonzero(t.ptr[row + 1] - np.arange(n) >= words)
    place = (low[at] & _LOW).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1) | (row[at][1:] != row[at][:-1])])
    # minimizers are small hashes by their making: mixed again, they are spread evenly over buckets and filter
    return Super(X.mix64(g[place[new]] ^ np.uint64(0xB5)), row[at[new]], at[new], np.diff(np.r_[new, len(at)]))


def _bucket(key: np.ndarray, n: int) -> np.ndarray:
    """Buckets are ranges of keys."""
    return (((key >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def _ids(col: pa.Array) -> np.ndarray:
    return col.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def _gather(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each range in turn."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64)
    for x, y in zip(cuts, np.r_[cuts[1:], len(b)]):
        yield int(b[x]), order[x:y]


def repeated_minimizers(docs: DataFrame, parts: int) -> DataFrame:
    """(keys, n): minimizers of windows that stand in two documents or more, as sorted uint64 blocks."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, own = _ids(batch.column(0)), [], []
            for at, c in X.chunks(batch.column(1)):
                s = super_windows(X.tokenize(c))
                keys.append(s.key)
                own.append(ids[at + s.row])
            if not keys:
                continue
            key, doc = np.concatenate(keys), np.concatenate(own)
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            if len(key):
                new = np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]
                key, doc = key[new], doc[new]
            rows = [(b, key[i].tobytes(), doc[i].tobytes()) for b, i in _by_bucket(_bucket(key, parts))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["bucket", "keys", "docs"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, own = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for batch in batches:
            for k, d in zip(batch.column(1), batch.column(2)):
                keys.append(np.frombuffer(k.as_buffer(), np.uint64))
                own.append(np.frombuffer(d.as_buffer(), np.int64))
        key, doc = np.concatenate(keys), np.concatenate(own)
        if len(key):
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            again = np.zeros(len(key), bool)
            again[1:] = (key[1:] == key[:-1]) & (doc[1:] != doc[:-1])
            key = np.unique(key[again])
        if len(key):
            yield pa.RecordBatch.from_arrays([pa.array([key.tobytes()], pa.binary()), pa.array([len(key)], pa.int64())], ["keys", "n"])

    found = docs.select("doc_id", "text").mapInArrow(find, "bucket int, keys binary, docs binary")
    return found.repartition(parts, "bucket").mapInArrow(count, "keys binary, n bigint")


def _filter(repeated: DataFrame, n: int) -> np.ndarray:
    """A bit map of ``repeated``: the executors make pieces of it, the driver at most ``MOST_BITS`` / 8 bytes."""
    bits = 1 << 10
    while bits < 16 * n and bits < MOST_BITS:
        bits *= 2
    shift = np.uint64(64 - (bits.bit_length() - 1))

    def piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0):
                at = np.unique(np.frombuffer(k.as_buffer(), np.uint64) >> shift).astype(np.int64)
                base = at[0] // 8 * 8
                own = np.zeros(at[-1] - base + 1, bool)
                own[at - base] = True
                # Buckets that went to one task leave gaps: zeros, cut out.
                packed = np.packbits(own, bitorder="little")
                some = np.flatnonzero(packed)
                for part in np.split(some, np.flatnonzero(np.diff(some) > 64) + 1):
                    yield pa.RecordBatch.from_arrays([pa.array([int(base // 8 + part[0])], pa.int64()), pa.array([packed[part[0] : part[-1] + 1].tobytes()], pa.binary())], ["at", "bits"])

    out = np.zeros(bits // 8, np.uint8)
    for r in repeated.select("keys").mapInArrow(piece, "at bigint, bits binary").toLocalIterator():
        b = np.frombuffer(r["bits"], np.uint8)
        out[r["at"] : r["at"] + len(b)] |= b
    return out


class Shard(NamedTuple):
    """The transform of some strings: the symbol before each suffix in sorted order (0: none), and the suffixes' nodes."""

    before: np.ndarray
    node: np.ndarray
    ends: int  # empty suffixes, sorted first


def _ranks(key: np.ndarray) -> np.ndarray:
    """Dense ranks from 1."""
    order = np.argsort(key)
    k = key[order]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(np.r_[True, k[1:] != k[:-1]])
    return out


def transform(code: np.ndarray, nxt: np.ndarray, prev: np.ndarray, node: np.ndarray, most: int) -> Shard:
    """``code``: each node's symbol, 0 for the end of a string; ``nxt`` and ``prev``: the node a symbol on or back, -1 for none;
    all of the shard's own nodes from 0. ``node``: their names outside. ``most``: symbols of the longest string."""
    r, step, h = _ranks(code), nxt, 1
    while h <= most:
        r = _ranks(r << 32 | np.where(step >= 0, r[step], 0))
        step = np.where(step >= 0, step[step], -1)
        h *= 2
    order = np.argsort(r, kind="stable")
    p = prev[order]
    return Shard(np.where(p >= 0, code[p], 0), node[order], int((code == 0).sum()))


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, lcp) of the merged order: all nodes sorted by their first ``depth`` symbols, and the number of symbols that each
    has in common with the one before, ``depth`` at most (-1 for the first)."""
    sizes = [len(s.node) for s in shards]
    base = np.cumsum([0, *sizes])
    n = int(base[-1])
    before = np.concatenate([s.before for s in shards])
    z = np.repeat(np.arange(len(shards)), sizes)  # the interleave: each place's shard
    ends = np.repeat(np.arange(len(shards)), [s.ends for s in shards])
    lcp = np.full(n, depth, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    lcp[0] = -1
    for h in range(1, depth + 1):
        source = np.empty(n, np.int64)  # place -> row of ``before``: shards are read in their own order
        source[np.argsort(z, kind="stable")] = np.arange(n)
        sym, block = before[source], np.cumsum(new)
        key = np.sort(sym << 32 | np.arange(n))
        order = (key & 0xFFFFFFFF)[len(ends) :]  # what follows the strings' ends; those have places of their own
        s, b = sym[order], block[order]
        fresh = np.zeros(n, bool)
        fresh[0] = True
        if len(order):
            fresh[len(ends)] = True
            fresh[len(ends) + 1 :] = (s[1:] != s[:-1]) | (b[1:] != b[:-1])
        lcp[fresh & (lcp == depth)] = h - 1
        moved = np.concatenate((ends, z[order]))
        still = h > 1 and (moved == z).all() and (fresh == new).all()
        z, new = moved, fresh
        if still:
            break
    source = np.empty(n, np.int64)
    source[np.argsort(z, kind="stable")] = np.arange(n)
    return np.concatenate([s.node for s in shards])[source], lcp


class Places(NamedTuple):
    """Where strings stand: those of string i are ptr[i]:ptr[i + 1]."""

    ptr: np.ndarray
    doc: np.ndarray
    first: np.ndarray


def repeats(shards: list[Strings], q: int = Q, depth: int = DEPTH, places: Places | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, first word, word after the last, documents that share it, the least of them) of each run of windows that stand in
    two documents or more; runs of one document don't overlap unless its strings do."""
    nothing = tuple(np.zeros(0, np.int64) for _ in range(5))
    shards = [s for s in shards if len(s.doc)]
    if not shards:
        return nothing
    doc, first, length = (np.concatenate([getattr(s, f) for s in shards]).astype(np.int64) for f in ("doc", "first", "length"))
    word = np.concatenate([s.word for s in shards]).astype(np.uint64)
    nodes = length + 1
    top = np.cumsum(nodes) - nodes
    total = int(nodes.sum())
    own = np.repeat(np.arange(len(doc)), nodes)
    pos = np.arange(total) - top[own]
    real = pos + q <= length[own]
    w = np.zeros(total + q, np.uint64)
    w[_gather(top, length)] = word
    g = np.zeros(total, np.uint64)
    for k in range(q):
        g = X.mix64(g * np.uint64(0xD6E8FEB86659FD93) + w[k : total + k])
    code = np.zeros(total, np.int64)
    code[real] = _ranks(g[real] >> np.uint64(1))
    i = np.arange(total)
    nxt, prev = np.where(real, i + q, -1), np.where(pos >= q, i - q, -1)
    built, at = [], 0
    for s in shards:
        lo, hi = int(top[at]), int(top[at + len(s.doc) - 1] + nodes[at + len(s.doc) - 1])
        built.append(transform(code[lo:hi], np.where(nxt[lo:hi] >= 0, nxt[lo:hi] - lo, -1), np.where(prev[lo:hi] >= 0, prev[lo:hi] - lo, -1), i[lo:hi], int(s.length.max()) // q + 1))
        at += len(s.doc)
    node, lcp = merge(built, depth)
    block = np.cumsum(lcp < depth)
    start = pos[node] + q * depth <= length[own[node]]
    node, block = node[start], block[start]
    d, at = doc[own[node]], first[own[node]] + pos[node]
    if places is not None:  # ``doc`` is the string's number
        n = places.ptr[d + 1] - places.ptr[d]
        i = _gather(places.ptr[d], n)
        at, block, d = np.repeat(at, n) + places.first[i], np.repeat(block, n), places.doc[i]
    order = np.lexsort((d, block))
    at, block, d = at[order], block[order], d[order]
    if not len(d):
        return nothing
    head = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    other = np.r_[True, (block[1:] != block[:-1]) | (d[1:] != d[:-1])]
    shared = np.repeat(np.add.reduceat(other.astype(np.int64), head), np.diff(np.r_[head, len(block)]))
    least = np.repeat(d[head], np.diff(np.r_[head, len(block)]))
    keep = shared > 1
    d, at, shared, least = d[keep], at[keep], shared[keep], least[keep]
    if not len(d):
        return nothing
    order = np.lexsort((at, d))
    d, at, shared, least = d[order], at[order], shared[order], least[order]
    run = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (at[1:] > at[:-1] + 1)])
    last = np.r_[run[1:], len(d)] - 1
    return d[run], at[run], at[last] + q * depth, np.maximum.reduceat(shared, run), np.minimum.reduceat(least, run)


class Sent(NamedTuple):
    """A map task's strings for a bucket, each once: minimizer, hash, words; and the places of all its copies."""

    key: np.ndarray
    hash: np.ndarray
    length: np.ndarray
    copies: np.ndarray
    word: np.ndarray
    doc: np.ndarray
    first: np.ndarray


_SENT = (np.uint64, np.uint64, np.int32, np.int32, np.uint32, np.int64, np.int32)


def _string_hash(t: X.Tokens, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    power, inverse = X._grow(len(t.hash) + 1)
    total = np.r_[np.zeros(1, np.uint64), np.cumsum(t.hash * power[: len(t.hash)], dtype=np.uint64)]
    return X.mix64((total[start + length] - total[start]) * inverse[start])


def _strings(docs: DataFrame, bits, parts: int) -> DataFrame:
    """A row a bucket and batch with the columns of ``Sent``: strings of words whose minimizers repeat."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        shift = np.uint64(64 - (8 * len(table)).bit_length() + 1)
        for batch in batches:
            ids, got = _ids(batch.column(0)), []
            for at, c in X.chunks(batch.column(1)):
                t = X.tokenize(c)
                s = super_windows(t)
                bit = (s.key >> shift).astype(np.int64)
                keep = (table[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0
                key, row, start, length = s.key[keep], s.row[keep], s.start[keep], s.windows[keep] + Q * DEPTH - 1
                h = _string_hash(t, start, length)
                _, one = np.unique(h ^ key, return_index=True)  # words of copies within the chunk are dropped at once
                words = np.zeros(len(h), np.int64)
                words[one] = length[one]
                got.append((key, h, length, ids[at + row], start - t.ptr[row], words, (t.hash[_gather(start[one := np.sort(one)], length[one])] >> np.uint64(32)).astype(np.uint32)))
            if not got:
                continue
            key, h, length, doc, first, words, word = (np.concatenate([g[i] for g in got]) for i in range(7))
            begin = np.cumsum(words) - words
            # a string's first copy has its words: it comes first in each chunk, so in the batch
            order = np.lexsort((np.arange(len(h)), h, key))
            new = np.flatnonzero(np.r_[True, (h[order][1:] != h[order][:-1]) | (key[order][1:] != key[order][:-1])]) if len(h) else np.zeros(0, np.int64)
            copies = np.diff(np.r_[new, len(order)])
            one = order[new]
            rows = []
            for b, i in _by_bucket(_bucket(key[one], parts)):
                places = order[_gather(new[i], copies[i])]
                cols = Sent(key[one[i]], h[one[i]], length[one[i]], copies[i], word[_gather(begin[one[i]], length[one[i]])], doc[places], first[places])
                rows.append((b, *[c.astype(t).tobytes() for c, t in zip(cols, _SENT)]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 7))], ["bucket", *Sent._fields])

    return docs.select("doc_id", "text").mapInArrow(send, "bucket int, " + ", ".join(f"{c} binary" for c in Sent._fields))


def _grouped(sent: list[Sent]) -> Iterator[tuple[list[Strings], Places]]:
    """The strings of a bucket, by minimizer: whole minimizers until there are ``GROUP_WORDS`` words and windows, each string once,
    in shards as their senders came, small ones joined."""
    key, h, length, copies, doc, first, word = (np.concatenate([getattr(s, f) for s in sent]).astype(np.int64 if f in ("length", "copies", "first") else getattr(sent[0], f).dtype) for f in ("key", "hash", "length", "copies", "doc", "first", "word"))
    shard = np.repeat(np.arange(len(sent)), [len(s.key) for s in sent])
    begin, place = np.cumsum(length) - length, np.cumsum(copies) - copies
    order = np.lexsort((shard, h, key))
    k, x = key[order], h[order]
    new = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (x[1:] != x[:-1])])
    senders = np.diff(np.r_[new, len(order)])
    total = np.add.reduceat(copies[order], new)
    weight = np.cumsum(length[order[new]] + total * (length[order[new]] - Q * DEPTH + 1))
    ends = np.flatnonzero(np.r_[k[new][1:] != k[new][:-1], True]) + 1  # after each minimizer's strings
    at = 0
    while at < len(ends):
        lo = int(ends[at - 1]) if at else 0
        done = int(weight[lo - 1]) if lo else 0
        to = max(at + 1, int(np.searchsorted(weight[ends - 1], done + GROUP_WORDS, side="right")))
        own = np.arange(lo, ends[to - 1])
        own = own[np.argsort(shard[order[new[own]]], kind="stable")]
        one = order[new[own]]
        words = np.cumsum(length[one])
        out, cut_at = [], 0
        for e in [*(np.flatnonzero(shard[one][1:] != shard[one][:-1]) + 1), len(one)]:
            if e == len(one) or words[e - 1] - (words[cut_at - 1] if cut_at else 0) >= SHARD_WORDS:
                i = one[cut_at:e]
                out.append(Strings(np.arange(cut_at, e), np.zeros(e - cut_at, np.int64), length[i], word[_gather(begin[i], length[i])]))
                cut_at = e
        entries = order[_gather(new[own], senders[own])]
        i = _gather(place[entries], copies[entries])
        yield out, Places(np.r_[0, np.cumsum(total[own])], doc[i], first[i])
        at = to


def _merged(strings: DataFrame, parts: int) -> DataFrame:
    names = ["doc_id", "lo", "hi", "n_docs", "first_doc"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[Sent]] = {}
        for batch in batches:
            for b, *cols in zip(batch.column(0).to_pylist(), *batch.columns[1:]):
                by.setdefault(b, []).append(Sent(*(np.frombuffer(c.as_py(), t) for c, t in zip(cols, _SENT))))
        for b in list(by):
            for group, places in _grouped(by.pop(b)):
                found = repeats(group, places=places)
                for lo in range(0, len(found[0]), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + 100_000]) for x in found], names)

    return strings.repartition(parts, "bucket").mapInArrow(work, ", ".join(f"{c} bigint" for c in names))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """One row a passage: doc_id, start_word, n_words, n_docs, first_doc.

    Every window of 50 words that also stands in another document is found; a passage is a union of windows of one document
    that overlap or touch. n_docs is the number of documents, this one too, that share its most frequent window; first_doc the
    least doc_id that shares one. Words as in ``text``, counted from 0. Texts under 50 words, empty and null ones have none.
    Rows with one doc_id are one document, those without are one, too, with a null in the result. Columns besides doc_id and
    text aren't read. Windows are equal if all their words' 32-bit hashes are.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    repeated = cut(repeated_minimizers(docs, parts))
    n = repeated.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = spark.sparkContext.broadcast(_filter(repeated, n))
    runs = _merged(_strings(docs, bits, parts), parts)
    by = Window.partitionBy("doc_id").orderBy("lo", "hi")
    far = F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.withColumn("new", F.when(F.col("lo") <= far, 0).otherwise(1)).withColumn("span", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    out = marked.groupBy("doc_id", "span").agg(F.min("lo").alias("start_word"), (F.max("hi") - F.min("lo")).alias("n_words"), F.max("n_docs").alias("n_docs"), F.min("first_doc").alias("first_doc"))
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return out.select(known("doc_id"), "start_word", "n_words", "n_docs", known("first_doc"))


ORACLE = r"""
WITH w AS (SELECT DISTINCT coalesce(doc_id, -9223372036854775808) AS d, regexp_extract_all(lower(text), '[0-9a-z_\x{80}-\x{10FFFF}]+') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT DISTINCT d, i, array_to_string(w[i + 1:i + 50], ' ') AS passage FROM (SELECT d, w, unnest(range(0, len(w) - 49)) AS i FROM w WHERE len(w) >= 50)),
r AS (SELECT passage, count(DISTINCT d) AS n, min(d) AS f FROM g GROUP BY passage HAVING count(DISTINCT d) > 1),
h AS (SELECT g.d, g.i, max(r.n) AS n, min(r.f) AS f FROM g JOIN r USING (passage) GROUP BY g.d, g.i),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY d ORDER BY i) AS span FROM (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY d ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM h))
SELECT nullif(d, -9223372036854775808) AS doc_id, min(i) AS start_word, max(i) + 50 - min(i) AS n_words, max(n) AS n_docs, nullif(min(f), -9223372036854775808) AS first_doc
FROM s GROUP BY d, span
"""
