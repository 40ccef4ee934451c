"""Odd rows, and each operator against a slower way to the same result."""

import base64
import bz2
import gzip
import json
import lzma
import math
import random
import re
import zlib
from urllib.parse import quote

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import assert_same
from tidemark.llm import bpe, html, jaccard, matroska, mixing, quality, queries, secrets, template
from tidemark.llm import text as X

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, _n int, copies string, __q_n string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns with the operators' own names."""
    long = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}" for i in range(40_000))
    rows = [(1, None), (2, ""), (None, "a plain text that has no id but has words"), (3, "the same row twice over and over again"), (3, "the same row twice over and over again"), (4, long), (5, "   \n\t "), (6, "ÄÖ ß é 漢字 🙂 words"), (None, None)]
    return spark.createDataFrame([(d, t, None if d == 2 else "en", None if d in (None, 6) else f"s{d % 2}", None if t is None else len(t), "x", 1, "y", "z") for d, t in rows], DOCS).repartition(3)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), queries.ORACLES[name], SF)


# ---- quality ----
def test_quality(spark, odd):
    got = quality.report(odd)
    assert got.count() == odd.count() and quality.report(odd.limit(0)).count() == 0
    by = {r["doc_id"]: r for r in got.collect() if r["doc_id"] is not None}
    assert by[1]["rules_failed"] == by[2]["rules_failed"] == by[5]["rules_failed"] == by[4]["rules_failed"] == 1
    kept = quality.keep(odd)
    assert kept.dtypes == odd.dtypes
    assert 3 in {r["doc_id"] for r in kept.collect()}


def test_host_rates_are_shrunk(spark):
    fine = "the cat sat on the mat and looked at what was there"
    rows = [(i, fine if i % 10 else "$$ " * 20, f"h{i % 7}") for i in range(210)] + [(999, "$$ && ## %% ** one two", "lonely")] + [(1000 + i, "$$ " * 20, "bad") for i in range(50)]
    hosts = {r["_host"]: r for r in quality.host_verdicts(quality._judged(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), "_n").select(F.col("source").alias("_host"), "_n")).collect()}
    rates = {h: r["_bad"] / r["_docs"] for h, r in hosts.items()}
    m, v = np.mean(list(rates.values())), np.var(list(rates.values()))
    s = max(2.0, m * (1 - m) / v - 1)
    for h, r in hosts.items():
        assert r["_rate"] == pytest.approx((r["_bad"] + m * s) / (r["_docs"] + s), abs=1e-8)
    assert rates["lonely"] == rates["bad"] == 1.0 and hosts["lonely"]["_rate"] < hosts["bad"]["_rate"]


# ---- near duplicates ----
def naive_sets(text):
    w = re.findall(r"[0-9a-z_\x80-\U0010ffff]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def naive_groups(docs, t=0.4):
    sets = [(d, naive_sets(x)) for d, x in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and len(a & b) / len(a | b) >= t:
                parent[find(i)] = find(j)
    groups = {}
    for i, (d, s) in enumerate(sets):
        if s:
            groups.setdefault(find(i), set()).add(d)
    return {(d, min(g), len(g)) for g in groups.values() if len(g) > 1 for d in g}


def near_corpus(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    common = [rng.choice(words) for _ in range(90)]
    docs = []
    for _ in range(n):
        kind = rng.random()
        if docs and kind < 0.5:  # a copy with some words changed
            w = rng.choice(docs)[1].split()
            w = [rng.choice(words) if rng.random() < rng.choice([0, 0.02, 0.08, 0.15]) else x for x in w]
        else:
            w = [rng.choice(words) for _ in range(rng.choice([3, 8, 30, 120, 400]))]
            if kind > 0.8:
                w += common
        docs.append((len(docs), " ".join(w)))
    return docs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_against_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(jaccard, "FREQUENT", 3)
    monkeypatch.setattr(jaccard, "ALL_PAIRS", 3)
    docs = near_corpus(seed)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    assert {tuple(r) for r in jaccard.near_groups(df).collect()} == naive_groups(docs)


def test_jaccard_odd_rows(spark, odd):
    assert rows_of(jaccard.near_groups(odd)) == []  # rows of one doc_id and text are one document
    kept = jaccard.keep_one(odd)
    assert kept.dtypes == odd.dtypes
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 5, 6]
    assert jaccard.near_groups(odd.limit(0)).count() == jaccard.keep_one(odd.limit(0)).count() == 0


def test_keep_one_keeps_one_of_each_group(spark):
    docs = near_corpus(7)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    lost = {d for d, g, _ in naive_groups(docs) if d != g}
    assert sorted(r["doc_id"] for r in jaccard.keep_one(df).collect()) == [d for d, _ in docs if d not in lost]


def test_words_are_those_of_the_pattern():
    import pyarrow as pa

    texts = ["", None, "A b_c 9-x", "É ß漢字 …", "x" * 5000, " a ", "ab"]
    t = X.tokenize(pa.array(texts))
    want = [re.findall(r"[0-9a-z_\x80-\U0010ffff]+", (x or "").lower()) for x in texts]
    assert np.diff(t.ptr).tolist() == [len(w) for w in want]
    h = {}
    for w, x in zip([w for ws in want for w in ws], t.hash.tolist()):
        assert h.setdefault(w, x) == x
    assert len(set(h.values())) == len(h)


# ---- secrets ----
TOKEN = 'token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"'
WRAP = {
    "plain": lambda s: s,
    "url": lambda s: quote(s, safe=""),
    "unicode": lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
    "base64": lambda s: base64.b64encode(s.encode()).decode(),
    "gzip": lambda s: base64.b64encode(gzip.compress(s.encode())).decode(),
    "zlib twice": lambda s: base64.b64encode(zlib.compress(zlib.compress(s.encode()))).decode(),
}


@pytest.mark.parametrize("outer", WRAP)
@pytest.mark.parametrize("inner", WRAP)
def test_nested_secrets(outer, inner):
    before, after = "Some prose ä before it: ", " and more after. "
    text = before + WRAP[outer](WRAP[inner](TOKEN)) + after
    found = secrets.scan(text)
    assert {f.secret for f in found if f.rule == "assigned"} == {TOKEN.split('"')[1]}
    for f in found:
        assert len(before) <= f.start < f.end <= len(text) - len(after)
    clean = secrets.redact(text, found)
    assert clean.startswith(before) and clean.endswith(after)
    assert not [f for f in secrets.scan(clean) if f.secret == TOKEN.split('"')[1]]


def test_spans_are_exact_in_plain_sight_and_in_escapes():
    text = "é x " + TOKEN + " y"
    (f,) = secrets.scan(text)
    assert text[f.start : f.end] == f.secret
    text = "é x " + quote(TOKEN) + " y"
    (f,) = secrets.scan(text)
    assert text[f.start : f.end] == f.secret and f.layers == "url"


def test_worklist_ends_and_prose_is_left_alone():
    assert secrets.scan("%25" * 2000) == [] and secrets.scan("token passwords are a topic: they say") == []
    s = "x"
    for _ in range(30):
        s = base64.b64encode(s.encode()).decode()
        if len(s) > 20_000:
            break
    assert secrets.scan(s) == []
    bomb = base64.b64encode(gzip.compress(b"a" * (1 << 22))).decode()
    assert secrets.scan(bomb, most=1 << 20) == []


def test_every_occurrence_of_an_encoded_secret():
    for wrap in WRAP.values():
        text = f"one {wrap(TOKEN)} two {wrap(TOKEN)} three"
        found = [f for f in secrets.scan(text) if f.rule == "assigned"]
        assert len(found) == 2 and found[0].end < text.index(" two ") + 1 and found[1].start > text.index(" two ")
        assert not [f for f in secrets.scan(secrets.redact(text, found)) if f.secret == found[0].secret]


def test_all_secrets_of_a_compressed_layer():
    config = "".join(f'password{i} = x\npassword = "hunter-number-{i}"\n' for i in range(5))
    found = secrets.scan("a " + base64.b64encode(gzip.compress(config.encode())).decode() + " b")
    assert sorted(f.secret for f in found) == [f"hunter-number-{i}" for i in range(5)]


@pytest.mark.parametrize("pack", [lambda b: b, gzip.compress])
def test_layers_of_any_characters(pack):
    for said in ("\ufeff" + TOKEN, "Voil\u00e0\u00a0: \u200b\f\x1b" + TOKEN):
        for code in ("utf-8", "latin-1", "utf-16", "utf-16-le", "utf-16-be"):
            if code != "latin-1" or "\u200b" not in said:
                text = "a " + base64.b64encode(pack(said.encode(code, "ignore"))).decode() + " b"
                found = secrets.scan(text)
                assert TOKEN.split('"')[1] in {f.secret for f in found}
                assert not [f for f in secrets.scan(secrets.redact(text, found)) if f.rule == "assigned"]
    assert TOKEN.split('"')[1] in {f.secret for f in secrets.scan("".join(f"%{b:02X}" for b in ("\u00e9 " + TOKEN).encode("latin-1")))}
    assert TOKEN.split('"')[1] in {f.secret for f in secrets.scan("".join(f"%{b:02X}" for b in TOKEN.encode("utf-16-le")))}


@pytest.mark.parametrize("pack", [lambda b: b, gzip.compress, bz2.compress, lzma.compress, zlib.compress])
def test_wrapped_and_glued_base64(pack):
    rng = random.Random(4)
    filler = "".join(chr(rng.randrange(97, 123)) for _ in range(300))
    blob = base64.b64encode(pack((filler[:40] + " " + TOKEN + " " + filler).encode())).decode()
    lines = "\n".join(blob[i : i + 64] for i in range(0, len(blob), 64))
    for text in ("mail:\n\n" + lines + "\n\nRegards", "key: " + lines.replace("\n", "\r\n  ") + "\nnext line", *(f"see {x}{blob}, there" for x in ("data/", "key_", "a-b-", "x", "xy", "xyz"))):
        found = secrets.scan(text)
        assert TOKEN.split('"')[1] in {f.secret for f in found}, text
        assert TOKEN.split('"')[1] not in {f.secret for f in secrets.scan(secrets.redact(text, found))}


def test_secret_rows(spark, odd):
    assert secrets.find(odd).count() == 0 and secrets.find(odd.limit(0)).count() == 0
    assert rows_of(secrets.clean(odd)) == rows_of(odd)
    df = spark.createDataFrame([(None, "a " + TOKEN + " b", 9, "z"), (7, TOKEN, 1, "z")], "doc_id bigint, text string, n_chars int, rule string")
    got = secrets.clean(df).collect()
    assert all("9b0b" not in r["text"] and r["n_chars"] == len(r["text"]) and r["rule"] == "z" for r in got)


# ---- mixing ----
def naive_mix(rows, factor, seed, weights):
    import hashlib

    def key(d, t):
        u = (int(hashlib.md5(f"{'null' if d is None else d}:{seed}".encode()).hexdigest()[:13], 16) + 1) / float(2**52 + 1)
        q = max(0.05, len([c for c in t or "" if c not in mixing.NOISE]) / max(1, len(t or "")))
        return -math.log(u) / q

    by = {}
    for d, s, t in rows:
        by.setdefault(s, []).append((key(d, t), -(2**63) if d is None else d, len(re.findall(r"[^ \n\t\r]+", t or "")), d))
    alls = {s: sum(x[2] for x in v) for s, v in by.items()}
    share = {s: math.sqrt(a) if weights is None else weights.get(s, 0.0) for s, a in alls.items()}
    out = []
    for s, v in by.items():
        budget = math.floor(factor * sum(alls.values()) * share[s] / sum(share.values())) if sum(share.values()) > 0 else 0
        epochs, rest = divmod(budget, alls[s]) if alls[s] else (1, 0)
        run = 0
        for _, _, n, d in sorted(v):
            run += n
            if copies := epochs + (run <= rest):
                out.append((d, s, n, copies))
    return sorted(out, key=repr)


@pytest.mark.parametrize("factor, weights", [(1.0, None), (3.7, {"a": 1.0, "b": 2.0}), (0.2, {"c": 1.0}), (1.0, {})])
def test_mixing_against_a_whole_sort(spark, factor, weights):
    rng = random.Random(5)
    rows = [(i if rng.random() < 0.97 else None, rng.choice(["a", "b", "c", None]), None if rng.random() < 0.05 else "tok#1 " * rng.randrange(0, 30)) for i in range(300)]
    rows += [(7, "a", "x y z"), (7, "a", "x y z"), (7, "a", "x y z")]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string").repartition(4)
    want = naive_mix(rows, factor, 17, weights)
    assert rows_of(mixing.report(df, factor, weights=weights)) == want
    got = rows_of(mixing.sample(df, factor, weights=weights).select("doc_id", "source"))
    assert got == sorted(((d, s) for d, s, _, c in want for _ in range(c)), key=repr)


def test_mixing_odd_rows(spark, odd):
    assert mixing.sample(odd).dtypes == odd.dtypes and mixing.report(odd.limit(0)).count() == mixing.sample(odd.limit(0)).count() == 0
    assert mixing.report(odd).count() > 0


# ---- byte-level BPE ----
def test_tree_is_the_whole_encoding():
    enc = bpe.encoding()
    rng = random.Random(9)
    texts = ["", "a", " ", "\n\n\n", "a" * 3000, " " * 3000, "don't I'll " * 200, "漢字🙂é" * 300, "x\n \n  y" * 200, "1234567890" * 100, "ab  cd \t e" * 100]
    texts += ["".join(rng.choice(["a", "é", " ", "  ", "\n", "7", "'s", "!", "🙂", "word", "　", " "]) for _ in range(rng.randrange(0, 900))) for _ in range(150)]
    for t in texts:
        for leaf in (1, 7, 64):
            ids = bpe.encode(t, leaf=leaf)
            assert ids == enc.encode_ordinary(t)
            assert bpe.decode(ids) == t


def test_any_bracketing_is_the_same():
    t = "The quick  brown fox's tail, 123 times.\nNew é line " * 9
    parts = [t[i : i + 37] for i in range(0, len(t), 37)]
    leaves = [bpe.encode_tree(p) for p in parts]
    left = leaves[0]
    for x in leaves[1:]:
        left = bpe.join(left, x)
    right = leaves[-1]
    for x in reversed(leaves[:-1]):
        right = bpe.join(x, right)
    assert left.ids == right.ids == bpe.encoding().encode_ordinary(t)


def test_bpe_rows(spark, odd):
    got = bpe.encode_documents(odd)
    assert got.count() == odd.count() and bpe.encode_documents(odd.limit(0)).count() == 0
    for r in got.collect():
        assert (r["token_ids"] is None) == (r["n_tokens"] is None) == (r["round_trip"] is None)
        assert r["round_trip"] in (True, None)
    assert rows_of(bpe.decode_tokens(got).select("text")) == rows_of(odd.select("text"))


# ---- chat templates ----
def test_template_language():
    render = template.compile_template("{% for m in messages %}{% if loop.first %}[{% elif not loop.last %}|{% else %}]{% endif %}{{ m.role|upper ~ ':' }}{% generation %}{{ m['content'] | trim }}{% endgeneration %}{% endfor %}{# note #}{{ '!' if bang else '?' }}")
    text, spans = render(messages=[{"role": "a", "content": " x "}, {"role": "b", "content": "yy"}, {"role": "c", "content": ""}], bang=True)
    assert text == "[A:x|B:yy]C:!" and [text[a:b] for a, b in spans] == ["x", "yy", ""]
    tree = template.simplify(template.parse("{{ 'a' ~ 1 + 2 }}{% if false %}never{% endif %}{% if 1 < 2 %}yes{% endif %}"))
    assert [n[0] for n in tree] == ["text"]
    for bad in ("{% if x %}", "{{ x.__class__() }}", "{{ 'a' * 9 }}", "{% import os %}", "{{ x | system }}", "{% endif %}", "{{ }}"):
        with pytest.raises(template.TemplateError):
            template.compile_template(bad)(x="y")
    assert template.compile_template("{{ x.__class__ }}{{ x['__len__'] }}")(x="y")[0] == ""


def test_conversation_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (None, 0, None, None), (2, 0, "assistant", ""), (2, 0, "assistant", ""), (2, None, "user", "first")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, messages string")
    got = {r["conv_id"]: r for r in template.format_conversations(df).collect()}
    assert got[1]["text"] == "<s><|user|>\na<|end|>\n<|assistant|>\nb<|end|>\n" and got[None]["text"] == "<s><|user|>\n<|end|>\n"
    a, b = map(int, got[1]["generated"].split("-"))
    assert got[1]["text"][a:b] == "b<|end|>\n" and got[2]["n_messages"] == 3 and got[2]["text"].startswith("<s><|user|>\nfirst")
    assert template.format_conversations(df.limit(0)).count() == 0
    assert template.format_conversations(df, add_generation_prompt=True).where("conv_id = 1").first()["text"].endswith("<|assistant|>\n")


# ---- pages ----
PROSE = "It was the best of times and it was the worst of times, and they had all that was to be had in the town by the river, which is not a place that you would like to be at in the night. "


def test_html_blocks():
    page = f"<html><head><title>T</title><script>var a='<p>no</p>';</script></head><body><nav><ul><li><a href=/>home</a><li><a href=/x>more</a></ul></nav><h1>Head</h1><p>{PROSE * 2}</p><p>Short &amp; sweet.</p><p>{PROSE * 2}<!-- no <p>x</p> --></p><div><a href=/a>{'link ' * 60}</a></div><footer>Copyright the owner of it</footer></body></html>"
    text, n, good = html.extract(page)
    lines = text.split("\n")
    assert "Short & sweet." in lines and sum(x.startswith("It was") for x in lines) == 2 and "link" not in text and "home" not in text and "Copyright" not in text and "no" not in lines
    assert html.extract("") == ("", 0, 0)
    assert "It was" in html.extract("<p>" + PROSE)[0]  # never closed
    assert html.extract("<" * 5000)[1] >= 0 and html.extract("<div>" * 20_000 + PROSE * 3)[2] == 1


def test_elements_that_do_not_hide_the_rest():
    good = f"<p>{PROSE * 2}</p>"
    for page in (f"<form>{good}</form>", f"<select><option>a<option>b</select>{PROSE * 2}", f"<option>a{good}", f"<svg class='x' />{good}", f"<svg/>{good}<svg><text>no</text></svg>", f"<header>{good}</header>"):
        assert html.extract(page)[0] == (PROSE * 2).strip(), page
    assert html.extract(f"<svg><g/><text>no</text></svg>{good}<form><select><option>no<option>no</select></form>{good}")[0].split("\n") == [(PROSE * 2).strip()] * 2


def test_blocks_take_the_label_of_the_nearest_decided():
    good, bad, short = html.Block(PROSE * 2, 0, False, False), html.Block("x " * 60, 120, False, False), html.Block("Short one.", 0, False, False)
    assert html.classify([good, short, good, short, bad, short]) == ["good", "good", "good", "bad", "bad", "bad"]
    assert html.classify([good, short, short, short, bad]) == ["good", "good", "bad", "bad", "bad"]
    assert html.classify([]) == []


def test_page_rows(spark):
    df = spark.createDataFrame([(1, None, None, "t"), (None, "u", "", "t"), (2, "u", "<p>" + PROSE * 3, "t"), (2, "u", "<p>" + PROSE * 3, "t")], "page_id bigint, url string, html string, text string")
    got = rows_of(html.extract_pages(df))
    assert got[0] == (1, None, None, 0, 0) and len(got) == 4 and (None, "u", "", 0, 0) in got and got.count(got[1]) == 2
    assert html.extract_pages(df.limit(0)).count() == 0


# ---- media ----
@pytest.mark.parametrize("unknown", [False, True])
def test_matroska_round_trip(unknown):
    rng = random.Random(3)
    for n in (1, 2, 5, 16, 17, 60):
        frames = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 3, 200, 300, 600]))) for _ in range(n)]
        blob = matroska.mux(frames, unknown=unknown)
        got, error = matroska.parse(blob)
        assert error is None and [blob[p.byte_offset : p.byte_offset + p.n_bytes] for p in got] == frames
        assert [p.timestamp_ns for p in got] == [i * 1_000_000_000 for i in range(n)]
        assert {p.codec for p in got} == {"S_TEXT/UTF8"} and [p.cluster for p in got] == [i // 16 for i in range(n)]
        assert [i for i, p in enumerate(got) if p.cued] == list(range(0, n, 16))


def test_matroska_damage():
    blob = matroska.mux([b"abc", b"defg", b"h" * 400] * 9)
    whole = matroska.parse(blob)[0]
    rng = random.Random(1)
    for n in range(0, len(blob), 7):
        got, error = matroska.parse(blob[:n])
        assert error and got[: len(got)] == [p._replace(cued=g.cued) for p, g in zip(whole, got)]
    for _ in range(300):
        b = bytearray(blob)
        b[rng.randrange(len(b))] = rng.randrange(256)
        matroska.parse(bytes(b))  # no other error than its own


def test_media_rows(spark, odd):
    media = matroska.mux_documents(odd)
    got = matroska.packets(media)
    assert got.where("error is not null").count() == 0 and matroska.packets(media.limit(0)).count() == 0
    sizes = {r["doc_id"]: r["n"] for r in got.groupBy("doc_id").agg(F.sum("n_bytes").alias("n")).collect()}
    assert 1 not in sizes and sizes[2] == 0 and sizes[6] == len("ÄÖ ß é 漢字 🙂 words".encode())
    df = spark.createDataFrame([(None, bytearray(b"")), (5, None), (6, bytearray(b"\x1a\x45"))], "doc_id bigint, media binary")
    assert sorted(r["doc_id"] or 0 for r in matroska.packets(df).where("error is not null").collect()) == [0, 6]


def test_everything_is_plain_json(spark):
    assert json.dumps(sorted(queries.QUERIES))
