"""Quality rules against a plain version, text by text, and hosts that meet their documents either way."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality


def plain(text):
    t = text or ""
    words = re.findall(r"[^ \n\t\r]+", t)
    solid = sum(map(len, words))
    lines = t.split("\n")
    w = re.findall(r"[0-9a-z_\x80-\U0010ffff]+", t.lower())
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n, k = max(len(t), 1), max(len(words), 1)
    share = lambda test, xs: sum(map(test, xs)) / max(len(xs), 1)
    return [
        len(words) < 5,
        bool(words) and not 2 <= solid / k <= 12,
        sum(c in quality.SYMBOLS for c in t) / n > 0.05,
        sum(c in quality.MARKS for c in t) / k > 0.4,
        sum("A" <= c <= "Z" for c in t) / n > 0.3,
        sum(c in "0123456789" for c in t) / n > 0.2,
        len(lines) >= 4 and (len(lines) - len(set(lines))) / len(lines) > 0.3,
        len(lines) >= 3 and share(lambda x: x[:1] in ("-", "*", "•"), lines) > 0.9,
        len(lines) >= 3 and share(lambda x: x.endswith(("...", "…")), lines) > 0.3,
        len(w) >= 20 and 0 < share(lambda x: x in quality.FUNCTION_WORDS, w) < 0.05,
        len(w) >= 10 and sum(a == b for a, b in zip(w, w[1:])) / len(w) > 0.2,
        len(w) >= 10 and (len(grams) - len(set(grams))) / len(grams) > 0.3,
    ]


def odd_texts(seed):
    rng = random.Random(seed)
    out = [None, "", "\n", " ", "\n\n\n\n", "a", "- x\n- y\n* z", "• é\n• é\n• é", "a...\nb…\nc", "…", "...\n...\n...\n...", "漢字 🙂", "ÄÖ\r\n\tß", None, "A" * 50, "x" * 30 + "\n"]
    for _ in range(400):
        pick = rng.choice([quality.FUNCTION_WORDS, quality.FUNCTION_WORDS + [f"w{i}" for i in range(900)], ["a", "b", "the"], ["Ä1", "$$", "#x|", "1234", "WORD", "l...", "-"]])
        text = "".join(rng.choice(pick) + rng.choice([" ", " ", " ", "\n", "\n- ", "...\n", "…\n", "\n\n", ". "]) for _ in range(rng.choice([0, 1, 4, 5, 9, 10, 19, 20, 60, 300])))
        out.append(text * rng.choice([1, 1, 1, 3]))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_rules_one_by_one(seed):
    texts = odd_texts(seed) + [" ".join(f"w{i}" for i in range(n)) + end for n in (19, 20, 60) for end in ("", " the", " the of")]
    got = quality.failed_rules(pa.array(texts, pa.string()))
    for t, row in zip(texts, got.tolist()):
        assert row == plain(t), (t, dict(zip(quality.RULES, row)))
    assert quality.failed_rules(pa.array([], pa.string())).shape == (0, len(quality.RULES))
    seen = np.array(got).any(0)
    assert seen.all(), quality.RULES


def frame(spark):
    texts = odd_texts(9)
    rows = [(i if i % 9 else None, x, None if i % 31 == 0 else f"h{i % 5}", "x", i) for i, x in enumerate(texts)]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, source string, __q_n string, _host int").repartition(3)


def test_whole_against_plain(spark):
    rows, df = frame(spark)
    n = [sum(plain(r[1])) for r in rows]
    docs, bad = Counter(r[2] for r in rows), Counter(r[2] for r, k in zip(rows, n) if k)
    rates = [bad[h] / docs[h] for h in docs]
    m, v = float(np.mean(rates)), float(np.var(rates))
    s = 2.0 if v <= 0 else max(2.0, m * (1 - m) / v - 1)
    shrunk = {h: round((bad[h] + m * s) / (docs[h] + s), 9) for h in docs}  # as the operator and its SQL have it
    cut = sorted(shrunk.values())[len(shrunk) // 2]
    want = sorted((r for r, k in zip(rows, n) if k < 1 or (k == 1 and shrunk[r[2]] <= cut)), key=repr)
    kept = quality.keep(df, cut)
    assert kept.dtypes == df.dtypes and sorted(map(tuple, kept.collect()), key=repr) == want and 0 < len(want) < len(rows)
    got = quality.report(df, cut).collect()
    assert Counter((r["doc_id"], r["host"], r["rules_failed"], r["kept"]) for r in got) == Counter((r[0], r[2], k, k < 1 or (k == 1 and shrunk[r[2]] <= cut)) for r, k in zip(rows, n))
    assert all(r["host_rate"] == pytest.approx(shrunk[r["host"]], abs=1e-8) for r in got)
    assert quality.keep(df.limit(0)).count() == 0


def test_many_hosts_meet_their_documents_in_a_salted_join(spark):
    rows, df = frame(spark)
    flags = quality._judged(df.select("doc_id", "source", "text"), "_n").select("doc_id", F.col("source").alias("_host"), "_n")
    hosts = quality.host_verdicts(flags)
    one, two = (sorted(map(tuple, quality._with_hosts(flags, "_host", hosts, "__q_", most).collect()), key=repr) for most in (quality.HOSTS, 0))
    assert one == two and len(one) == len(rows)
