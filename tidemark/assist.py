"""Questions in plain words, and models that enrich facts. The models themselves are given by the caller."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from typing import TYPE_CHECKING, Any

import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions.fields import resolve
from tidemark.operators import read, search, temporal
from tidemark.plans.ast import Query, QueryError

if TYPE_CHECKING:
    from tidemark.engine import Engine, Result

KNOWN_FROM, SOURCES, RATING = 1.0, 6, 0.5
_BOOKS = ("model:", "kb:", "kb_gap:", "acl:", "feedback:", "snapshot:", "rollback:")


def slug(text: str) -> str:
    return "-".join(re.findall(r"[^\W_]+", text.lower())[:6]) or "question"


def feedback(engine: Engine, event_id: str, rating: float, now: int) -> None:
    """A rating from -1 to 1 of an event as a source for answers."""
    engine.store.append([{"subject": f"feedback:{event_id}", "facet": "rating", "value": {"event": event_id, "rating": max(-1.0, min(1.0, rating))}, "provenance": "HUMAN_ENTRY"}], now)


def ask(engine: Engine, question: str, now: int) -> Result:
    """From the knowledge base (``kb:*``) if a fact there scores ``KNOWN_FROM``; else the best sources, rated ones nudged, go to the
    caller's ``answer``; without one, or without sources, the gap is noted as a fact."""
    from tidemark.engine import Result

    base = engine.base
    kb = read.gather(base.facts, Query("facts", "kb:*"))
    hit = search.search(base, kb, question, 1).first()
    if hit is not None and hit["keyword"] >= KNOWN_FROM:
        return Result("ask", kb.where(F.col("event_id") == hit["event_id"]), {"from": "knowledge", "event_id": hit["event_id"]})
    view = temporal.current(base.facts)
    for prefix in _BOOKS:
        view = view.where(~F.col("subject").startswith(prefix))
    vector = engine.embed(question) if engine.embed else None
    found = search.search(base, view, question, 10 * SOURCES, vector, 0.5, vector is not None)
    rated = temporal.current(base.facts.where(F.col("subject").startswith("feedback:")))
    rating = resolve(rated, "rating").number
    rated = rated.select(resolve(rated, "event").text.alias("_e"), rating.alias("_r"))
    found = found.join(rated, found["event_id"] == rated["_e"], "left").withColumn("score", F.col("score") + RATING * F.coalesce("_r", F.lit(0.0)))
    best = found.orderBy(F.desc("score"), "event_id").limit(SOURCES).select("event_id", "score")
    sources = [r.asDict(True) for r in best.join(view, "event_id").orderBy(F.desc("score"), "event_id").withColumn("value", F.to_json("value")).collect()]  # SOURCES rows
    if engine.answer and sources:
        return Result("ask", None, {"from": "sources", "answer": engine.answer(question, sources), "sources": [s["event_id"] for s in sources]})
    engine.store.append([{"subject": f"kb_gap:{slug(question)}", "facet": "question", "value": {"question": question}, "provenance": "AI_INFERRED"}], now)
    return Result("ask", None, {"from": "gap", "sources": [s["event_id"] for s in sources]})


def enrich(engine: Engine, q: Query, now: int) -> Result:
    """The model's result for current facts that have none of its kind yet, as enrichments. A model takes and gives lists; it runs
    on the executors, a batch at a time."""
    from tidemark.engine import Result

    name = q.options["model"]
    model = engine.models.get(name)
    if model is None:
        raise QueryError(f"no model {name!r}")
    kind = q.options.get("as", name)
    base = engine.base
    view = read.gather(base.facts, Query("facts", q.subject, facet=q.facet))
    done = base.enrichments.where((F.col("kind") == kind) & (F.col("model_id") == name)).select(F.col("target_event").alias("_e"))
    todo = view.join(done, view["event_id"] == done["_e"], "left_anti").orderBy("subject", "facet")
    todo = todo.limit(q.limit) if q.limit else todo
    text = resolve(todo, q.options["on"]).text if "on" in q.options else F.to_json("value")
    tip = engine.store.tip()
    salt = uuid.uuid4().hex[:8]

    def infer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = model(b["text"].tolist())
            vectors = bool(got) and isinstance(got[0], (list, tuple))
            yield pd.DataFrame({
                "log_seq": b["n"] + tip + 1, "enrichment_id": [f"{salt}:{e}" for e in b["event_id"]], "target_event": b["event_id"], "kind": kind, "model_id": name,
                "text": [None] * len(b) if vectors else [str(g) for g in got], "vector": [list(map(float, g)) for g in got] if vectors else [None] * len(b), "confidence": 1.0, "created_at": now,
            })

    from tidemark.model import ENRICHMENTS

    rows = todo.select("event_id", text.alias("text"), F.monotonically_increasing_id().alias("n")).where("text is not null")
    out = rows.mapInPandas(infer, ENRICHMENTS)
    engine.store.add_enrichments(out, now)
    return Result("enrich", engine.store.base().enrichments.where(F.col("kind") == kind), {"model": name, "kind": kind})


# ---- plain words to statements ----
_RULES: list[tuple[re.Pattern[str], Any]] = [
    (re.compile(r"how many (\S+?)s?(?: are there| do we have)?\??\Z", re.I), lambda m: f"FACTS COUNT(*) OF {m[1]}:*"),
    (re.compile(r"(?:what|which) changed (?:between (.+) and (.+))\??\Z", re.I), lambda m: f"DIFF OF * BETWEEN '{m[1]}' AND '{m[2].rstrip('?')}'"),
    (re.compile(r"why (?:did|is|was) (\S+)(?: happen| so)?\??\Z", re.I), lambda m: f"WHY {m[1].rstrip('?')}"),
    (re.compile(r"what (?:did|does) (\S+) (?:cause|lead to|affect)\??\Z", re.I), lambda m: f"EFFECTS {m[1]}"),
    (re.compile(r"(?:show|give)(?: me)? (?:the )?history of (\S+)\Z", re.I), lambda m: f"HISTORY OF {m[1]}"),
    (re.compile(r"what (?:was|were) (\S+) (?:on|at|as of) (.+?)\??\Z", re.I), lambda m: f"FACTS OF {m[1]} AS OF '{m[2]}'"),
    (re.compile(r"what is pending (?:on|in|at) (\S+?)\??\Z", re.I), lambda m: f"PENDING {m[1]}"),
    (re.compile(r"(?:where|which systems?) (?:do|does).* disagree (?:on|about) (\S+?)\??\Z", re.I), lambda m: f"DISAGREE ON {m[1]}"),
    (re.compile(r"(?:average|mean) (\S+) of (\S+?)(?: by (\S+))?\??\Z", re.I), lambda m: f"FACTS{f' {m[3]},' if m[3] else ''} AVG({m[1]}) OF {m[2]}:*" + (f" GROUP BY {m[3]}" if m[3] else "")),
    (re.compile(r"(?:profile|describe) (\S+)\Z", re.I), lambda m: f"PROFILE OF {m[1]}:*" if ":" not in m[1] else f"PROFILE OF {m[1]}"),
    (re.compile(r"(?:find|search(?: for)?|look for) (.+)\Z", re.I), lambda m: "SEARCH '" + m[1].replace("'", " ") + "'"),
    (re.compile(r"(?:tell me about|what do (?:we|you) know about|what is|show(?: me)?) (\S+:\S+?)\??\Z", re.I), lambda m: f"CONTEXT FOR {m[1]}"),
]


def statement(words: str, now: int) -> str:
    """A statement for plain words; what no rule knows is searched for. Whatever comes out has been parsed."""
    from tidemark.plans.parser import parse

    words = " ".join(words.split())
    for pattern, make in _RULES:
        if m := pattern.match(words):
            text = make(m)
            try:
                parse(text, now)
                return text
            except QueryError:
                continue
    text = "SEARCH '" + words.replace("'", " ") + "'"
    parse(text, now)
    return text
