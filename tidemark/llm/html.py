"""Main text of web pages by two-pass block rules (operator 4)."""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

STOP_WORDS: dict[str, frozenset[str]] = {
    "en": frozenset("the of and in to is it that was for on with as by at this from are be an or a have not but which they you he she his her we their has had were been".split()),
    "de": frozenset("der die das und in zu den mit von ist im für auf ein eine nicht sich dem des als auch es an aus bei nach wie einer einem werden war sie er wir ich".split()),
    "fr": frozenset("le la les de des du et en un une que qui dans pour par sur au aux ce il elle ne pas est avec plus se sont son sa ses nous vous ou mais".split()),
    "es": frozenset("el la los las de del y en un una que por con para se no es al lo como más su sus o pero este esta fue son ha le ya".split()),
}
BLOCK_TAGS = frozenset("address article aside blockquote body br canvas center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol option p pre section summary table tbody td textarea tfoot th thead title tr ul".split())
SKIP_TAGS = ("script", "style", "noscript", "template", "svg")
_SIMPLE = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)[^<>\"']*+(?:\"[^\"<>]*+\"[^<>\"']*+)*+>")  # looks no further than the next angle
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_IN_TAG = re.compile(r"[>\"']")
_SKIP_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in SKIP_TAGS}
_LONG_NUMBER = re.compile(r"&#(?:[0-9]{8}|[xX][0-9a-fA-F]{7})[0-9a-fA-F]*;?")  # beyond all characters, and slow or an error to read
_BLANK = re.compile(r"\s+")
_WORDS = re.compile(r"[^\W\d_]+")


class Block(NamedTuple):
    text: str
    link_chars: int
    heading: bool
    boiler: bool  # within nav, header, footer, aside, title or option


class Rules(NamedTuple):
    """Thresholds: lengths in characters, densities as shares."""

    short: int = 70
    long: int = 200
    stop_low: float = 0.20
    stop_high: float = 0.28
    link_most: float = 0.2


_BOILER = frozenset("nav header footer aside title".split())
_OPTION_ENDS = BLOCK_TAGS | {"select", "optgroup", "datalist"}  # </option> may be left out


class _Marks:
    """Tags, comments and elements without text of a page, in one pass: (first character, end, tag in lower case or "", closing).

    The work is in proportion to the page whatever it holds: what is once looked for in vain isn't looked for again. A tag ends at
    the first ``>`` outside quotes; where quotes don't close, that tag and all after it end at the first ``>``. A ``<`` that begins
    nothing is text. Comments, and elements in ``SKIP_TAGS``, that are never closed go to the page's end.
    """

    def __init__(self, page: str):
        self.page = page
        self.missing: set[str] = set()
        self.quotes = True

    def find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def tag_end(self, at: int) -> int:
        """The place after the ``>`` of a tag whose name ends at ``at``; -1 if there is none."""
        if self.quotes:
            x = at
            while True:
                m = _IN_TAG.search(self.page, x)
                if m is None:
                    break
                if m[0] == ">":
                    return m.end()
                x = self.find(m[0], m.end()) + 1
                if not x:
                    break
            self.quotes = False
        return self.find(">", at) + 1 or -1

    def __iter__(self) -> Iterator[tuple[int, int, str, bool]]:
        page, at, n = self.page, 0, len(self.page)
        while (lo := page.find("<", at)) >= 0:
            at, tag = lo + 1, ""
            if m := _SIMPLE.match(page, lo):
                tag, closing, end = m[2].lower(), bool(m[1]), m.end()
            elif m := _NAME.match(page, at + (closing := page.startswith("/", at))):
                tag, end = m[0].lower(), self.tag_end(m.end())
            elif page.startswith("!--", at):
                end = self.find("-->", at + 3) + 3
                end = end if end > 2 else n
            elif page.startswith("![CDATA[", at) and (end := self.find("]]>", at + 8) + 3) > 2:
                pass
            elif page[at : at + 1] in ("!", "?"):
                end = self.find(">", at + 1) + 1
            else:
                continue
            if tag in _SKIP_END and not closing and end > 0 and not (tag == "svg" and page[end - 2] == "/"):
                close = _SKIP_END[tag].search(page, end)
                tag, end = "", close.end() if close else n
            if end > 0:
                yield lo, end, tag, closing
                at = end


def _unescape(text: str) -> str:
    if "&#" in text:
        text = _LONG_NUMBER.sub("\ufffd", text)
    return _html.unescape(text) if "&" in text else text


def blocks(page: str) -> list[Block]:
    """Blocks of visible text in order, blanks collapsed; blocks without text are left out."""
    out: list[Block] = []
    parts: list[tuple[str, bool]] = []
    links, heading, boiler, option, at = 0, 0, 0, False, 0

    def close() -> None:
        if parts:
            text = _BLANK.sub(" ", "".join(p for p, _ in parts)).strip()
            if text:
                out.append(Block(text, sum(len(_BLANK.sub(" ", p).strip()) for p, a in parts if a), heading > 0, boiler > 0 or option))
            parts.clear()

    for begin, stop, tag, end in _Marks(page):
        if begin > at:
            parts.append((_unescape(page[at:begin]), links > 0))
        at = stop
        if tag == "a":
            links = max(0, links - 1) if end else links + 1
        elif tag in _OPTION_ENDS:
            close()
            option = tag == "option" and not end
            if tag[0] == "h" and tag[1:] in "123456" and len(tag) == 2:
                heading = max(0, heading - 1) if end else heading + 1
            if tag in _BOILER:
                boiler = max(0, boiler - 1) if end else boiler + 1
    if at < len(page):
        parts.append((_unescape(page[at:]), links > 0))
    close()
    return out


def stop_counts(text: str) -> tuple[int, dict[str, int]]:
    words = _WORDS.findall(text.lower())
    return len(words), {lang: sum(w in s for w in words) for lang, s in STOP_WORDS.items()}


def classify(bs: list[Block], rules: Rules = Rules()) -> list[str]:
    """``good`` or ``bad`` for each block.

    Pass 1 looks at a block alone: ``bad`` with links over ``link_most`` of its characters, or inside boilerplate elements
    unless it is ``good`` by length and density; else ``short`` (undecided) under ``short`` characters; else by the density of the page's stop words: ``good`` at
    ``stop_high`` and over ``long`` characters, ``near`` (undecided) at ``stop_low``, ``bad`` below. Pass 2: an undecided
    block takes the label of its nearest decided neighbours: where both sides agree, theirs; else the nearer side's; at equal
    distance ``near`` blocks and headings are good and other short ones bad. The page's ends count as bad neighbours.
    """
    counts = [stop_counts(b.text) for b in bs]
    lang = max(STOP_WORDS, key=lambda x: sum(c[x] for _, c in counts)) if bs else "en"
    first: list[str] = []
    for b, (n, c) in zip(bs, counts):
        density = c[lang] / n if n else 0.0
        if b.link_chars > rules.link_most * len(b.text):
            first.append("bad")
        elif len(b.text) >= rules.short and density >= rules.stop_high and len(b.text) > rules.long:
            first.append("good")
        elif b.boiler:
            first.append("bad")
        elif len(b.text) < rules.short:
            first.append("short")
        elif density >= rules.stop_low:
            first.append("near")
        else:
            first.append("bad")
    n = len(bs)
    before, after = [(-1, "bad")] * n, [(n, "bad")] * n
    last = (-1, "bad")
    for i in range(n):
        before[i] = last
        if first[i] in ("good", "bad"):
            last = (i, first[i])
    last = (n, "bad")
    for i in range(n - 1, -1, -1):
        after[i] = last
        if first[i] in ("good", "bad"):
            last = (i, first[i])
    final = []
    for i, label in enumerate(first):
        if label in ("short", "near"):
            (p, a), (q, b) = before[i], after[i]
            if a == b:
                # A whole page of undecided prose has no decided neighbour at all.
                label = "good" if label == "near" and p == -1 and q == n else a
            elif i - p != q - i:
                label = a if i - p < q - i else b
            else:
                label = "good" if label == "near" or bs[i].heading else "bad"
        final.append(label)
    return final


def extract(page: str, rules: Rules = Rules()) -> tuple[str, int, int]:
    """(text of the good blocks, a line each; blocks; good blocks)."""
    bs = blocks(page)
    labels = classify(bs, rules)
    good = [b.text for b, x in zip(bs, labels) if x == "good"]
    return "\n".join(good), len(bs), len(good)


def extract_pages(pages: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row a page: page_id, url, text, n_blocks, n_good.

    Null html has null text and no blocks; empty html has empty text. Null identifiers and addresses stay null, repeated
    rows give repeated rows, columns besides page_id, url and html are not read. Time grows in proportion to a page's length,
    whatever stands in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n, good = [], [], []
            for x in batch.column(2):
                t = extract(x.as_py(), rules) if x.is_valid else (None, 0, 0)
                texts.append(t[0])
                n.append(t[1])
                good.append(t[2])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(texts, pa.string()), pa.array(n, pa.int32()), pa.array(good, pa.int32())], ["page_id", "url", "text", "n_blocks", "n_good"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_blocks int, n_good int")
