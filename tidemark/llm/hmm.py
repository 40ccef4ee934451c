"""Hidden Markov language model (operator 2).

Every distinct word is a symbol of its own, known by its 64-bit hash. Documents are kept as shards: the shard's words in order of
hash and, for each place of a text, which of them it is. Baum-Welch: each task adds up expected counts of its shard's words,
which are summed by hash range across the cluster; from there each shard gets back the new emissions of its own words alone. So
neither a task nor the driver ever holds the emissions of all words. The forward recursion is scaled and gives the
exact likelihood of a sequence: texts are cut into segments of ``SEGMENT`` words; each segment's product of transitions and
emissions, a states x states matrix, is computed for all segments side by side, and chaining the products gives every segment
its exact entry (and, backward, exit) vector. So long texts run as wide as short ones.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import RDD, TaskContext
from pyspark.sql import DataFrame, Row

from tidemark.llm import text as X
from tidemark.session import cut, drop, drop_shuffle

STATES, ROUNDS = 6, 3
SHARD_WORDS = 1 << 22  # a shard is closed at so many words
SEGMENT = 256
BATCH_WORDS = 1 << 19
SMOOTH = 0.1  # added to each expected count
_SHARDS = "shard int, nth int, ids binary, flags binary, sizes binary, tokens binary, words binary"
_NO_ID, _NO_TEXT = 1, 2


class Model(NamedTuple):
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # symbols x states


class Counts(NamedTuple):
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    log_likelihood: float


def first_weights(words: np.ndarray, count: np.ndarray, states: int = STATES) -> np.ndarray:
    """Emissions, but for the scale, in proportion to the counts, tilted by word and state so that states can part."""
    tilt = np.stack([(X.mix64(words + X.mix64(np.full(1, k + 1, np.uint64))) >> np.uint64(11)).astype(float) / 2.0**53 for k in range(states)], 1)
    return (count + SMOOTH) * (0.5 + tilt)


class _Segments(NamedTuple):
    word: np.ndarray  # all first words of the segments, then all second ones ...; segments by falling length
    off: np.ndarray  # where the words of each place begin
    active: np.ndarray  # segments that have a word at each place
    length: np.ndarray
    doc: np.ndarray
    nth: np.ndarray  # place among the document's segments
    last: np.ndarray  # whether the document's last


def _segments(symbols: np.ndarray, ptr: np.ndarray) -> _Segments:
    n = np.diff(ptr)
    pieces = -(-n // SEGMENT)
    doc = np.repeat(np.arange(len(n)), pieces)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    length = np.minimum(SEGMENT, n[doc] - nth * SEGMENT)
    order = np.argsort(-length, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    place = np.arange(len(symbols)) - np.repeat(np.cumsum(length) - length, length)
    active = np.bincount(place)
    off = np.r_[0, np.cumsum(active)]
    word = np.empty_like(symbols)
    word[off[place] + np.repeat(rank, length)] = symbols
    doc, nth = doc[order], nth[order]
    return _Segments(word, off, active, length[order], doc, nth, nth == pieces[doc] - 1)


def _entries(m: Model, s: _Segments, need_exit: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """For each segment: the state distribution that its first word meets (after the transition into it), and, if asked, what
    the words after it say of the state at its last word (scaled)."""
    k = len(m.start)
    entry = np.repeat(m.start[None], len(s.doc), 0)
    leave = np.ones((len(s.doc), k)) if need_exit else None
    many = np.flatnonzero((s.nth > 0) | ~s.last)  # segments of documents that have several
    if not len(many):
        return entry, leave
    # product[i, j]: entering in state i, through the segment's words and on into state j, scaled
    product = np.repeat(np.eye(k)[None], len(many), 0)
    for t, off in enumerate(s.off[:-1].tolist()):
        a = int(np.searchsorted(-s.length[many], -t))  # those longer than t
        if not a:
            break
        x = (product[:a] * m.emit[s.word[off + many[:a]]][:, None, :]).reshape(-1, k) @ m.move
        x = x.reshape(a, k, k)
        product[:a] = x / x.sum((1, 2), keepdims=True)
    where = np.full(len(s.doc), -1)
    where[many] = np.arange(len(many))
    by = many[np.lexsort((s.nth[many], s.doc[many]))]
    for r in range(1, int(s.nth[many].max()) + 1):  # all documents' r-th segments at once
        at = np.flatnonzero(s.nth[by] == r)
        here, before = by[at], by[at - 1]
        x = np.einsum("si,sij->sj", entry[before], product[where[before]])
        entry[here] = x / x.sum(1, keepdims=True)
    if leave is not None:
        # what a segment's words and all after them say of its first word's state; rows of ``move`` sum to 1
        future = product.sum(2)
        for r in range(int(s.nth[many].max()) - 1, -1, -1):
            at = np.flatnonzero((s.nth[by] == r) & ~s.last[by])
            here, after = by[at], by[at + 1]
            ahead = future[where[after]]
            x = np.einsum("sij,sj->si", product[where[here]], ahead)
            future[where[here]] = x / x.sum(1, keepdims=True)
            x = ahead @ m.move.T
            leave[here] = x / x.sum(1, keepdims=True)
    return entry, leave


def forward(m: Model, symbols: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Log-likelihood of each document; 0 for one without words."""
    out = np.zeros(len(ptr) - 1)
    s = _segments(symbols, ptr)
    entry, _ = _entries(m, s, False)
    total = np.zeros(len(s.doc))
    for off, a in zip(s.off.tolist(), s.active.tolist()):
        x = entry[:a] * m.emit[s.word[off : off + a]]
        scale = x.sum(1)
        total[:a] += np.log(scale)
        entry[:a] = (x / scale[:, None]) @ m.move
    np.add.at(out, s.doc, total)
    return out


def expected(m: Model, symbols: np.ndarray, ptr: np.ndarray) -> Counts:
    """Expected starts, transitions and emissions of the documents (the E step)."""
    k, v = len(m.start), len(m.emit)
    s = _segments(symbols, ptr)
    entry, leave = _entries(m, s, True)
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((v, k))
    if not len(s.doc):
        return Counts(start, move, emit, 0.0)
    at = [slice(x, y) for x, y in zip(s.off[:-1].tolist(), s.off[1:].tolist())]
    seen = m.emit[s.word]
    alpha, scales = np.empty_like(seen), np.empty((len(seen), 1))
    x = entry
    for t, a in zip(at, s.active.tolist()):
        y = x[:a] * seen[t]
        scale = y.sum(1, keepdims=True)
        scales[t] = scale
        y /= scale
        alpha[t] = y
        x = y @ m.move
    beta, first_seen = leave.copy(), seen[at[0]].copy()
    weight = seen  # each place is read before it is written over
    ahead = None
    ends = s.off[s.length - 1] + np.arange(len(s.doc))  # where each segment's last word is
    for i in range(len(at) - 1, -1, -1):
        t, a = at[i], int(s.active[i])
        if ahead is not None:
            b = len(ahead)
            before = alpha[t][:b]
            back = ahead @ m.move.T
            norm = (before * back).sum(1, keepdims=True)
            move += before.T @ (ahead / norm)
            beta[:b] = back / norm
        own = beta[:a]
        ahead = seen[t] * own
        g = alpha[t] * own
        weight[t] = g / g.sum(1, keepdims=True)
    # Transitions between segments: from the state at a segment's end into the next.
    inner = np.flatnonzero(~s.last)
    if len(inner):
        by = np.lexsort((s.nth, s.doc))
        follows = np.empty(len(by), np.int64)
        follows[by[:-1]] = by[1:]
        after = follows[inner]
        ahead = first_seen[after] * beta[after]
        a = alpha[ends[inner]]
        norm = np.einsum("si,ij,sj->s", a, m.move, ahead)
        move += a.T @ (ahead / norm[:, None])
    move *= m.move
    start += weight[at[0]][s.nth == 0].sum(0)
    for i in range(k):
        emit[:, i] = np.bincount(s.word, weight[:, i], minlength=v)
    return Counts(start, move, emit, float(np.log(scales).sum()))


# ---- over tables ----
def symbol_table(docs: DataFrame, most: int = SHARD_WORDS) -> DataFrame:
    """The documents as shards, one or more a partition, in order: ids, flags and numbers of words of its rows, tokens (places in
    ``words``) and words (64-bit hashes, rising). A null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, nth, rows, held = TaskContext.get().partitionId(), 0, [], 0

        def packed() -> pa.RecordBatch:
            ids, flags, sizes, hashes = (np.concatenate(x) for x in zip(*rows))
            words, tokens = np.unique(hashes, return_inverse=True)
            cells = (ids.astype(np.int64), flags.astype(np.uint8), sizes.astype(np.int64), tokens.astype(np.uint32), words)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([nth], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in cells)], ["shard", "nth", "ids", "flags", "sizes", "tokens", "words"])

        for batch in batches:
            for at, c in X.chunks(batch.column(1)):
                t, n = X.tokenize(c), len(c)
                ids, text = batch.column(0).slice(at, n).cast(pa.int64()), batch.column(1).slice(at, n)
                flags = _NO_ID * ids.is_null().to_numpy(zero_copy_only=False) + _NO_TEXT * text.is_null().to_numpy(zero_copy_only=False)
                rows.append((pa.compute.fill_null(ids, 0).to_numpy(zero_copy_only=False), flags, np.diff(t.ptr), t.hash))
                held += len(t.hash)
                if held >= most:
                    yield packed()
                    nth, held = nth + 1, 0
                    rows.clear()
        if rows:
            yield packed()

    return docs.select("doc_id", "text").mapInArrow(X.tidy(run), _SHARDS)


def _batches(row: Row) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, end, symbols of their words, where each document's begin), about ``BATCH_WORDS`` words at a time."""
    tokens, size = np.frombuffer(row.tokens, np.uint32), np.frombuffer(row.sizes, np.int64)
    ends, at = np.cumsum(size), 0
    while at < len(size):
        done = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + BATCH_WORDS, side="right")))
        yield at, to, tokens[done : ends[to - 1]].astype(np.int64), np.r_[0, np.cumsum(size[at:to])]
        at = to


def _messages(row: Row, cells: np.ndarray, parts: int) -> Iterator[tuple[int, tuple[int, int, bytes, bytes]]]:
    """A shard's counts by hash range, in single precision. The first range gets one in any case, so that each shard is answered."""
    words = np.frombuffer(row.words, np.uint64)
    cuts = np.searchsorted(((words >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32), np.arange(parts + 1))
    for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])):
        if y > x or not b:
            yield b, (row.shard, row.nth, words[x:y].tobytes(), cells[x:y].astype(np.float32).tobytes())


def _summed(messages: list[tuple[int, int, bytes, bytes]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of a range, their counts over all shards in double precision, which word each row of the messages is)."""
    words, at = np.unique(np.concatenate([np.frombuffer(m[2], np.uint64) for m in messages]), return_inverse=True)
    cells = np.concatenate([np.frombuffer(m[3], np.float32) for m in messages]).reshape(-1, width)
    return words, np.stack([np.bincount(at, cells[:, k], minlength=len(words)) for k in range(width)], 1), at


def _answers(messages: RDD, weigh: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int, shards: DataFrame, n: int) -> DataFrame:
    """(nth, weights): for each shard, in its own partition, the weights of its words. The messages are gone afterwards."""

    def answer(it: Iterator) -> Iterator:
        got = [(b, m) for b, m in it if len(m) == 4]
        if got:
            words, total, at = _summed([m for _, m in got], width)
            weights, x = weigh(words, total).astype(np.float32), 0
            for b, m in got:
                y = x + len(m[2]) // 8
                yield m[0], (m[1], b, weights[at[x:y]].tobytes())
                x = y

    def join(it: Iterator) -> Iterator:
        by: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
        for _, (nth, b, x) in it:
            by[nth].append((b, x))
        for nth in sorted(by):
            yield nth, b"".join(x for _, x in sorted(by[nth]))

    back = messages.mapPartitions(answer).partitionBy(n, int).mapPartitions(join)
    out = cut(shards.sparkSession.createDataFrame(back, "nth int, weights binary", verifySchema=False))
    drop_shuffle(back)
    drop_shuffle(messages)
    return out


class Fitted(NamedTuple):
    start: np.ndarray
    move: np.ndarray
    total: np.ndarray  # by state, the sum of all words' weights
    weights: DataFrame | None  # by shard; None where there are no words
    history: list[float]  # the corpus' log-likelihood before each round


def _own(row: Row, got: Row, f: Fitted) -> Model:
    """The model as far as a shard's words go."""
    k = len(f.start)
    if row.nth != got.nth or len(got.weights) * 2 != len(row.words) * k:
        raise RuntimeError("weights of another shard")
    return Model(f.start, f.move, np.frombuffer(got.weights, np.float32).reshape(-1, k) / f.total)


def fit(shards: DataFrame, states: int = STATES, rounds: int = ROUNDS, parts: int | None = None) -> Fitted:
    """The model of all documents; all of them count in every round. ``shards`` must be cut."""
    spark, data = shards.sparkSession, shards.rdd
    sc, n = spark.sparkContext, data.getNumPartitions()
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    f = Fitted(np.full(states, 1 / states), np.full((states, states), 0.5 / states) + 0.5 * np.eye(states), np.zeros(states), None, [])
    if not n:
        return f

    def tally(it: Iterator[Row]) -> Iterator:
        for row in it:
            words = len(row.words) // 8
            yield from _messages(row, np.bincount(np.frombuffer(row.tokens, np.uint32), minlength=words)[:, None], parts)

    def first(words: np.ndarray, count: np.ndarray) -> np.ndarray:
        return first_weights(words, count, states)

    def totals(it: Iterator) -> list[tuple[int, np.ndarray]]:
        got = [m for _, m in it]
        if not got:
            return []
        words, count, _ = _summed(got, 1)
        return [(len(words), first(words, count).sum(0))]

    messages = data.mapPartitions(tally).partitionBy(parts, int)
    by_range = sc.runJob(messages, totals)
    distinct = sum(x for x, _ in by_range)
    if not distinct:
        return f
    f = f._replace(total=sum(x for _, x in by_range), weights=_answers(messages, first, 1, shards, n))
    for _ in range(rounds):

        def gather(it: Iterator[tuple[Row, Row]], f: Fitted = f._replace(weights=None)) -> Iterator:
            start, move, total, ll = np.zeros(states), np.zeros((states, states)), np.zeros(states), 0.0
            for row, got in it:
                m = _own(row, got, f)
                emit = np.zeros_like(m.emit)
                for _, _, w, ptr in _batches(row):
                    c = expected(m, w, ptr)
                    start += c.start
                    move += c.move
                    emit += c.emit
                    ll += c.log_likelihood
                total += emit.sum(0)
                yield from _messages(row, emit, parts)
            yield parts, (start, move, total, ll, None)  # the range after the last; five, as others are four

        messages = data.zip(f.weights.rdd).mapPartitions(gather).partitionBy(parts + 1, int)
        start, move, total, ll = (sum(x) for x in list(zip(*sc.runJob(messages, lambda it: [m for _, m in it], [parts])))[:4])
        start, move = start + SMOOTH, move + SMOOTH
        weights = _answers(messages, lambda _, total: total + SMOOTH, states, shards, n)
        drop(f.weights)
        f = Fitted(start / start.sum(), move / move.sum(1, keepdims=True), total + SMOOTH * distinct, weights, [*f.history, float(ll)])
    return f


def train(shards: DataFrame, states: int = STATES, rounds: int = ROUNDS, parts: int | None = None) -> tuple[Model, list[float]]:
    """(model, the corpus' log-likelihood before each round). The model has all words, in order of hash: for small corpora."""
    shards = cut(shards)
    f = fit(shards, states, rounds, parts)
    if f.weights is None:
        return Model(f.start, f.move, np.zeros((0, states))), f.history
    own = f._replace(weights=None)  # what goes to the tasks
    got = shards.rdd.zip(f.weights.rdd).map(lambda x: (np.frombuffer(x[0].words, np.uint64), _own(*x, own).emit)).collect()
    _, at = np.unique(np.concatenate([w for w, _ in got]), return_index=True)
    return Model(f.start, f.move, np.concatenate([e for _, e in got])[at]), f.history


def score(shards: DataFrame, f: Fitted) -> DataFrame:
    """One row a row of the documents: doc_id, n_words, log_likelihood, perplexity (a word)."""
    weights, own = f.weights, f._replace(weights=None)

    def run(it: Iterator) -> Iterator[tuple]:
        for x in it:
            row, m = (x, Model(own.start, own.move, np.zeros((0, len(own.start))))) if isinstance(x, Row) else (x[0], _own(*x, own))
            ids, flags = np.frombuffer(row.ids, np.int64), np.frombuffer(row.flags, np.uint8)
            for at, to, w, ptr in _batches(row):
                n, ll = np.diff(ptr), forward(m, w, ptr)
                per = np.round(np.exp(-ll / np.maximum(n, 1)), 6)
                for i, flag, a, b, c in zip(ids[at:to].tolist(), flags[at:to].tolist(), n.tolist(), np.round(ll, 6).tolist(), per.tolist()):
                    gone = flag & _NO_TEXT
                    yield None if flag & _NO_ID else i, None if gone else a, None if gone else b, None if gone or not a else c

    rows = (shards.rdd if weights is None else shards.rdd.zip(weights.rdd)).mapPartitions(run)
    return shards.sparkSession.createDataFrame(rows, "doc_id bigint, n_words bigint, log_likelihood double, perplexity double", verifySchema=False)


def score_documents(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """A model is trained on all documents and scores each: doc_id, n_words, log_likelihood, perplexity.

    A text without words has likelihood 1 (logarithm 0) and null perplexity; a null text nulls. Null identifiers stay null;
    repeated rows are scored, and count in training, once each. An empty table gives none. Only doc_id and text are read.
    """
    shards = cut(symbol_table(docs))
    return score(shards, fit(shards, states, rounds))
