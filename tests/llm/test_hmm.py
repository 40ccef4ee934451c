import math

import numpy as np
import pytest

from tidemark.llm import hmm


def naive_forward(m, w):
    """Unscaled, word by word."""
    a = m.start * m.emit[w[0]]
    for x in w[1:]:
        a = (a @ m.move) * m.emit[x]
    return math.log(a.sum())


def naive_expected(m, w):
    n, k = len(w), len(m.start)
    al, be = np.zeros((n, k)), np.ones((n, k))
    al[0] = m.start * m.emit[w[0]]
    for t in range(1, n):
        al[t] = (al[t - 1] @ m.move) * m.emit[w[t]]
    for t in range(n - 2, -1, -1):
        be[t] = m.move @ (m.emit[w[t + 1]] * be[t + 1])
    p = al[-1].sum()
    g = al * be / p
    emit = np.zeros_like(m.emit)
    np.add.at(emit, w, g)
    move = sum((np.outer(al[t], m.emit[w[t + 1]] * be[t + 1]) * m.move / p for t in range(n - 1)), np.zeros((k, k)))
    return g[0], move, emit


@pytest.fixture
def model():
    rng = np.random.default_rng(3)
    return hmm.Model(rng.dirichlet(np.ones(4)), rng.dirichlet(np.ones(4), 4), rng.dirichlet(np.ones(32), 4).T)


def docs(seed, sizes):
    rng = np.random.default_rng(seed)
    return rng.integers(0, 32, sum(sizes)), np.r_[0, np.cumsum(sizes)]


def test_forward_and_counts_are_exact(model, monkeypatch):
    monkeypatch.setattr(hmm, "SEGMENT", 7)
    sizes = [5, 0, 1, 7, 8, 40, 14, 21, 100]
    w, ptr = docs(1, sizes)
    got, c = hmm.forward(model, w, ptr), hmm.expected(model, w, ptr)
    start, move, emit = np.zeros(4), np.zeros((4, 4)), np.zeros((32, 4))
    for i, n in enumerate(sizes):
        if n:
            own = w[ptr[i] : ptr[i + 1]]
            assert got[i] == pytest.approx(naive_forward(model, own), abs=1e-9)
            s, m, e = naive_expected(model, own)
            start, move, emit = start + s, move + m, emit + e
        else:
            assert got[i] == 0
    np.testing.assert_allclose(c.start, start, atol=1e-9)
    np.testing.assert_allclose(c.move, move, atol=1e-9)
    np.testing.assert_allclose(c.emit, emit, atol=1e-9)
    assert c.log_likelihood == pytest.approx(got.sum())


def test_very_long_sequence_does_not_underflow(model):
    w, ptr = docs(2, [60_000])
    assert hmm.forward(model, w, ptr)[0] / 60_000 == pytest.approx(np.mean([hmm.forward(model, w[i : i + 3000], np.array([0, 3000]))[0] / 3000 for i in range(0, 60_000, 3000)]), abs=0.01)


def test_training_rises_and_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{x}" for x in rng.integers(0, 9, 30))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    one = hmm.train(hmm.symbol_table(df.repartition(1)), 3, 5)
    many = hmm.train(hmm.symbol_table(df.repartition(5)), 3, 5)
    assert one[1] == sorted(one[1]) and one[1][-1] > one[1][0]
    np.testing.assert_allclose(one[1], many[1], rtol=1e-6)
    np.testing.assert_allclose(one[0].emit, many[0].emit, atol=1e-6)


def test_odd_rows(spark):
    rows = [(1, None, "x"), (None, "a b a", "y"), (2, "", "z"), (3, "... !", "z"), (3, "a b a", "z"), (3, "a b a", "z"), (4, "b " * 30_000, "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, log_likelihood string")
    out = sorted(map(tuple, hmm.score_documents(df).collect()), key=repr)
    by = {}
    for r in out:
        by.setdefault(r[0], []).append(r[1:])
    assert by[1] == [(None, None, None)]
    assert by[2] == [(0, 0.0, None)]
    assert len(by[3]) == 3 and by[3].count((0, 0.0, None)) == 1 and by[None][0] in by[3]
    assert by[4][0][0] == 30_000 and by[4][0][1] < 0
    assert hmm.score_documents(df.limit(0)).count() == 0


def test_every_word_is_a_symbol(spark):
    """Against Baum-Welch in memory over a dictionary of words, with more words than a table of 2^8 or 2^12 has slots, over several shards a partition."""
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 6000, 100)) for _ in range(90)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    m, _ = hmm.train(hmm.symbol_table(df, 700), 3, 2)
    hashes = hmm.X.tokenize(hmm.pa.array(texts)).hash
    words, w = np.unique(hashes, return_inverse=True)
    assert len(m.emit) == len(words) == len({x for t in texts for x in t.split()})
    ptr, f = np.arange(0, len(w) + 1, 100), hmm.first_weights(words, np.bincount(w)[:, None], 3)
    own = hmm.Model(np.full(3, 1 / 3), np.full((3, 3), 0.5 / 3) + 0.5 * np.eye(3), f / f.sum(0))
    for _ in range(2):
        c = hmm.expected(own, w, ptr)
        own = hmm.Model(*((x + hmm.SMOOTH) for x in c[:3]))
        own = hmm.Model(own.start / own.start.sum(), own.move / own.move.sum(1, keepdims=True), own.emit / own.emit.sum(0))
    np.testing.assert_allclose(m.emit, own.emit, rtol=1e-4)
    got = {r.doc_id: r.log_likelihood for r in hmm.score_documents(df, 3, 2).collect()}
    np.testing.assert_allclose([got[i] for i in range(90)], hmm.forward(own, w, ptr), rtol=1e-6)
