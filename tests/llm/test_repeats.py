import numpy as np
import pytest

from tests.compare import assert_same, normal, spark_rows
from tidemark.llm import repeats as R

SF = "/root/testdata/sf0.001"
NAMES = ["doc_id", "start_word", "n_words", "n_docs", "first_doc"]


def brute(docs):
    """Every window of 50 words against all others."""
    seen = {}
    for d, w in docs:
        for i in range(len(w) - 49):
            seen.setdefault(tuple(w[i : i + 50]), set()).add(d)
    out = []
    for d in {d for d, _ in docs}:
        at = {}
        for e, w in docs:
            if e == d:
                for i in range(len(w) - 49):
                    who = seen[tuple(w[i : i + 50])]
                    if len(who) > 1:
                        n, f = at.get(i, (0, None))
                        at[i] = (max(n, len(who)), min(x for x in (f, *who) if x is not None))
        spans = []
        for i in sorted(at):
            if spans and i <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 50, max(spans[-1][2], at[i][0]), min(spans[-1][3], at[i][1]))
            else:
                spans.append((i, i + 50, *at[i]))
        out += [(d, a, b - a, n, f) for a, b, n, f in spans]
    return out


def test_merge_gives_the_order_and_prefixes_of_a_full_sort():
    rng = np.random.default_rng(0)
    shards, texts, at = [], [], 0
    for n in (40, 1, 90, 30):
        strings = [list(rng.integers(1, 4, rng.integers(0, 12))) for _ in range(n)]
        code, nxt, prev, node = [], [], [], []
        for s in strings:
            base = len(code)
            for i in range(len(s) + 1):
                code.append(s[i] if i < len(s) else 0)
                nxt.append(base + i + 1 if i < len(s) else -1)
                prev.append(base + i - 1 if i else -1)
                node.append(at + base + i)
                texts.append(s[i:])
        shards.append(R.transform(np.array(code), np.array(nxt), np.array(prev), np.array(node), 12))
        at += len(code)
    for depth in (1, 3, 8):
        node, lcp = R.merge(shards, depth)
        assert sorted(node) == list(range(at))
        cut = [texts[i][:depth] for i in node]
        assert cut == sorted(cut)
        for a, b, n in zip(cut, cut[1:], lcp[1:]):
            common = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert n == (depth if a == b else common)


def test_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(400)]
    passages = [list(rng.choice(words, n)) for n in (50, 51, 49, 60, 130, 400)]
    docs = []
    for d in range(40):
        w = list(rng.choice(words, rng.integers(0, 120)))
        for _ in range(rng.integers(0, 4)):
            w += passages[rng.integers(0, len(passages))] + list(rng.choice(words, rng.integers(0, 9)))
        docs.append((d, w))
    docs += [(40, docs[3][1] * 3), (41, ["same"] * 500), (42, ["same"] * 60), (41, ["same"] * 500)]
    monkeypatch.setattr(R, "SHARD_WORDS", 200)
    monkeypatch.setattr(R, "GROUP_WORDS", 1500)
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id bigint, text string").repartition(5)
    assert spark_rows(R.repeated_passages(df)) == normal(NAMES, brute(docs))


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    p = " ".join(f"p{i}" for i in range(60))
    rows = [(1, None, 1), (2, "", 1), (None, p, 1), (3, p.upper(), 1), (3, p.upper(), 1), (4, "a " + long, 1), (5, long + " b", 1), (6, " ".join(p.split()[:49]), 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lo int")
    got = sorted((tuple(r) for r in R.repeated_passages(df).collect()), key=repr)
    assert got == sorted([(3, 0, 60, 2, None), (None, 0, 60, 2, None), (4, 1, 30_000, 2, 4), (5, 0, 30_000, 2, 4)], key=repr)
    assert R.repeated_passages(df.limit(0)).count() == 0
    assert R.repeated_passages(spark.createDataFrame([(1, p), (1, p)], "doc_id bigint, text string")).count() == 0


@pytest.mark.parametrize("sf", [SF])
def test_sql(spark, sf):
    assert assert_same(R.repeated_passages(spark.read.parquet(f"{sf}/documents.parquet")), R.ORACLE, sf)
