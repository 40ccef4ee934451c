"""Page extraction against a slow version of the same rules, and pages made to be slow."""

from __future__ import annotations

import html as pyhtml
import random
import re
import time

import pytest

from tidemark.llm import html

LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def slow_marks(page):
    """A list of characters and (tag, closing), one character at a time."""
    out, i, quotes = [], 0, True
    while i < len(page):
        rest = page[i:]
        if rest.startswith("<!--"):
            i = page.index("-->", i + 4) + 3 if "-->" in page[i + 4 :] else len(page)
        elif rest.startswith("<![CDATA[") and "]]>" in rest[9:]:
            i = page.index("]]>", i + 9) + 3
        elif rest[:2] in ("<!", "<?") and ">" in rest[2:]:
            i = page.index(">", i + 2) + 1
            out.append(None)
            continue
        elif m := re.match(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)", rest):
            closing, tag = bool(m[1]), m[2].lower()
            j, open_, end = i + m.end(), "", None
            while quotes and j < len(page):
                c = page[j]
                if open_:
                    open_ = "" if c == open_ else open_
                elif c in "\"'":
                    open_ = c
                elif c == ">":
                    end = j + 1
                    break
                j += 1
            if end is None:
                quotes = False
                end = page.index(">", i + m.end()) + 1 if ">" in page[i + m.end() :] else None
            if end is None:
                out.append("<")
                i += 1
                continue
            if tag in html.SKIP_TAGS and not closing and not (tag == "svg" and page[end - 2] == "/"):
                stop = re.compile("</" + tag + r"\s*>", re.I).search(page, end)
                i = stop.end() if stop else len(page)
                out.append(None)
                continue
            out.append((tag, closing))
            i = end
            continue
        else:
            out.append(page[i])
            i += 1
            continue
        out.append(None)
    return out


def slow_blocks(page):
    blocks, pieces, run = [], [], ""
    depth = {"a": 0, "h": 0, "boiler": 0}
    option = False

    def end_run():
        nonlocal run
        if run:
            pieces.append((pyhtml.unescape(run), depth["a"] > 0))
        run = ""

    def end_block():
        text = " ".join("".join(t for t, _ in pieces).split())
        if text:
            blocks.append((text, sum(len(" ".join(t.split())) for t, a in pieces if a), depth["h"] > 0, depth["boiler"] > 0 or option))
        pieces.clear()

    for m in slow_marks(page):
        if isinstance(m, str):
            run += m
            continue
        end_run()
        if m is None:
            continue
        tag, closing = m
        step = -1 if closing else 1
        if tag == "a":
            depth["a"] = max(0, depth["a"] + step)
        elif tag in html.BLOCK_TAGS or tag in ("select", "optgroup", "datalist"):
            end_block()
            option = (tag, closing) == ("option", False)
            if re.fullmatch("h[1-6]", tag):
                depth["h"] = max(0, depth["h"] + step)
            if tag in ("nav", "header", "footer", "aside", "title"):
                depth["boiler"] = max(0, depth["boiler"] + step)
    end_run()
    end_block()
    return blocks


def slow_labels(blocks):
    stops = {k: [0] * len(blocks) for k in html.STOP_WORDS}
    words = [re.findall(r"[^\W\d_]+", b[0].lower()) for b in blocks]
    for i, ws in enumerate(words):
        for k, s in html.STOP_WORDS.items():
            stops[k][i] = len([w for w in ws if w in s])
    lang = max(html.STOP_WORDS, key=lambda k: sum(stops[k])) if blocks else "en"
    first = []
    for i, (text, link, _, boiler) in enumerate(blocks):
        d = stops[lang][i] / len(words[i]) if words[i] else 0
        if link > 0.2 * len(text):
            first.append("bad")
        elif len(text) > 200 and d >= 0.28:
            first.append("good")
        elif boiler:
            first.append("bad")
        else:
            first.append("short" if len(text) < 70 else "near" if d >= 0.2 else "bad")
    out = []
    for i, own in enumerate(first):
        if own in ("good", "bad"):
            out.append(own)
            continue
        left = next(((i - j, first[j]) for j in range(i - 1, -1, -1) if first[j] in ("good", "bad")), (i + 1, "bad"))
        right = next(((j - i, first[j]) for j in range(i + 1, len(first)) if first[j] in ("good", "bad")), (len(first) - i, "bad"))
        undecided = not any(x in ("good", "bad") for x in first)
        if left[1] == right[1]:
            out.append("good" if own == "near" and undecided else left[1])
        elif left[0] != right[0]:
            out.append(min(left, right)[1])
        else:
            out.append("good" if own == "near" or blocks[i][2] else "bad")
    return out


STOPS = {k: sorted(v) for k, v in html.STOP_WORDS.items()}


def piece(rng):
    """Prose of one language, more or less dense; marks of all kinds, whole and broken."""
    kind = rng.randrange(12)
    if kind < 6:
        lang, share = rng.choice(sorted(STOPS)), rng.choice([0, 0.15, 0.22, 0.3, 0.5])
        return " ".join(rng.choice(STOPS[lang]) if rng.random() < share else "".join(rng.choice(LETTERS) for _ in range(rng.randrange(1, 9))) for _ in range(rng.choice([1, 5, 12, 40])))
    if kind < 10:
        tag = rng.choice(["p", "div", "h1", "h2", "li", "nav", "footer", "a", "b", "span", "br", "option", "select", "form", "td", "title", "A", "P", "x:y"])
        attrs = rng.choice(["", "", " x=1", " href='a>b'", ' t="<p>"', " q='", ' r="', " /", "\n"])
        return f"<{rng.choice(['', '', '/'])}{tag}{attrs}{rng.choice(['>'] * 9 + [''])}"
    return rng.choice(["<!-- n <p> -->", "<!--", "-->", "<![CDATA[ z ]]>", "<![CDATA[", "<!DOCTYPE html>", "<?php x ?>", "<!", "<script>if (a<b) '</p>'</script>", "<style>", "</STYLE >", "<svg/>", "<svg><text>t</text></svg>", "<noscript>n</noscript>", "&amp;", "&#233;", "&lt;p&gt;", "<", ">", "<3", " ", "'", '"'])


@pytest.mark.parametrize("seed", range(8))
def test_against_the_slow_version(seed):
    rng = random.Random(seed)
    for _ in range(150):
        page = "".join(piece(rng) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(1, 40)))
        want = slow_blocks(page)
        got = html.blocks(page)
        assert [tuple(b) for b in got] == want, page
        assert html.classify(got) == slow_labels(want), page


@pytest.mark.parametrize("bad", ["<a '", "<![CDATA[", '<a x=">', "<!", "<a ", "<script>", "</script ", "<a x='\"", "&#9999999999", "<!--", "<svg/", "<option '", "<script '", "&", "<", "<a\"'", "<p>x", "<a href='"])
def test_time_in_proportion(bad):
    began = time.perf_counter()
    html.extract(bad * (1_000_000 // len(bad)))
    assert time.perf_counter() - began < 5


def test_numbers_of_characters():
    html.extract("<p>&#" + "9" * 6000 + ";&#x" + "f" * 6000 + ";&#99999999&#0;&#xD800;")
