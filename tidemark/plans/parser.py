"""The temporal query language: text to ``Query``. Clauses are small readers in one table; a statement names those it takes."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from tidemark.functions import naturaltime
from tidemark.plans.ast import AGGREGATES, COMPARISONS, Expr, Having, Item, Query, QueryError, check

_LEX = re.compile(r"\s+|'([^']*)'|\"([^\"]*)\"|(!=|<=|>=|[(),=<>])|([\w:/\-*.@]+)", re.U)
_TIME_WORDS = frozenset("AGO BEFORE BACK".split())


class Tokens:
    """kind is one of str, op, num, word; a word keeps its case and compares without it."""

    def __init__(self, text: str, now: int):
        self.now, self.at, self.toks = now, 0, []
        i = 0
        while i < len(text):
            m = _LEX.match(text, i)
            if not m:
                raise QueryError(f"unexpected character {text[i]!r}" if text[i] not in "'\"" else "unclosed quote")
            i = m.end()
            if m[1] is not None or m[2] is not None:
                self.toks.append(("str", m[1] if m[1] is not None else m[2]))
            elif m[3]:
                self.toks.append(("op", m[3]))
            elif m[4]:
                try:
                    self.toks.append(("num", float(m[4])) if re.match(r"[-\d.]", m[4]) else ("word", m[4]))
                    self.raw = m[4]
                except ValueError:
                    self.toks.append(("word", m[4]))
                if self.toks[-1][0] == "num":
                    self.toks[-1] = ("num", self.toks[-1][1], m[4])

    @property
    def kind(self) -> str:
        return self.toks[self.at][0] if self.at < len(self.toks) else "end"

    def shown(self) -> str:
        return str(self.toks[self.at][-1]) if self.at < len(self.toks) else "the end"

    def sees(self, *words: str) -> bool:
        return self.kind == "word" and self.toks[self.at][1].upper() in words

    def eat(self, *words: str) -> bool:
        if self.sees(*words):
            self.at += 1
            return True
        return False

    def op(self, *ops: str) -> str:
        if self.kind == "op" and self.toks[self.at][1] in ops:
            self.at += 1
            return self.toks[self.at - 1][1]
        return ""

    def need(self, *words: str) -> None:
        for w in words:
            if not self.eat(w):
                raise QueryError(f"expected {w}, got {self.shown()}")

    def name(self, what: str) -> str:
        if self.kind in ("word", "str", "num"):
            self.at += 1
            return str(self.toks[self.at - 1][-1])
        raise QueryError(f"expected {what}, got {self.shown()}")

    def quoted(self, what: str) -> str:
        if self.kind != "str":
            raise QueryError(f"expected {what} in quotes")
        return self.name(what)

    def number(self, what: str) -> float:
        if self.kind != "num":
            raise QueryError(f"{what} needs a number, got {self.shown()}")
        self.at += 1
        return self.toks[self.at - 1][1]

    def count(self, what: str) -> int:
        n = self.number(what)
        if n != int(n) or n < 0:
            raise QueryError(f"{what} needs a whole number")
        return int(n)

    def value(self) -> Any:
        if self.kind == "num":
            return self.number("a value")
        if self.kind == "word":
            w = self.name("a value")
            return {"true": True, "false": False}.get(w.lower(), w)
        return self.name("a value")

    def when(self) -> int:
        if self.kind == "num":
            n = self.number("a time")
            if self.kind == "word" and self.at + 1 < len(self.toks) and str(self.toks[self.at + 1][1]).upper() in _TIME_WORDS:
                unit, way = self.name("a unit"), self.name("AGO")
                return self._moment(f"{int(n)} {unit} {way}")
            return int(n)
        return self._moment(self.name("a time"))

    def _moment(self, text: str) -> int:
        try:
            return naturaltime.parse(text, self.now)
        except ValueError as e:
            raise QueryError(str(e)) from e


# ---- predicates ----
def predicate(t: Tokens, depth: int = 0) -> Expr:
    kids = [_all(t, depth)]
    while t.eat("OR"):
        kids.append(_all(t, depth))
    return kids[0] if len(kids) == 1 else Expr("or", tuple(kids))


def _all(t: Tokens, depth: int) -> Expr:
    kids = [_one(t, depth)]
    while t.eat("AND"):
        kids.append(_one(t, depth))
    return kids[0] if len(kids) == 1 else Expr("and", tuple(kids))


def _one(t: Tokens, depth: int) -> Expr:
    if depth > 100:
        raise QueryError("predicates are nested too deep")
    if t.eat("NOT"):
        return Expr("not", (_one(t, depth + 1),))
    if t.eat("EXISTS"):
        return Expr("exists", name=t.name("a field"))
    if t.op("("):
        e = predicate(t, depth + 1)
        if not t.op(")"):
            raise QueryError("missing )")
        return e
    name = t.name("a field")
    if t.eat("IN"):
        if not t.op("("):
            raise QueryError("IN needs a list in parentheses")
        values = [t.value()]
        while t.op(","):
            values.append(t.value())
        if not t.op(")"):
            raise QueryError("missing ) after IN")
        return Expr("in", name=name, value=tuple(values))
    if t.eat("LIKE"):
        return Expr("like", name=name, value=t.quoted("a pattern"))
    if t.eat("MATCHES"):
        return Expr("matches", name=name, value=t.quoted("a text"))
    op = t.op(*COMPARISONS)
    if not op:
        raise QueryError(f"expected a comparison after {name}, got {t.shown()}")
    return Expr(op, name=name, value=t.value())


# ---- clauses ----
def _having(t: Tokens, q: Query) -> None:
    q.having = []
    while True:
        agg = t.name("an aggregate").lower()
        if agg not in AGGREGATES or agg == "listagg":
            raise QueryError(f"HAVING needs a numeric aggregate, got {agg!r}")
        if not t.op("("):
            raise QueryError("HAVING needs aggregate(field)")
        name = t.name("a field or *")
        op = t.op(*COMPARISONS) if t.op(")") else ""
        if not op:
            raise QueryError("HAVING needs a comparison")
        q.having.append(Having(agg, name, op, t.number("HAVING")))
        if not t.eat("AND"):
            return


def _as(t: Tokens, q: Query) -> None:
    if t.eat("OF"):
        q.as_of = t.when()
    elif t.eat("KNOWN"):
        t.need("AT")
        q.known_at = t.when()
    else:
        raise QueryError("after AS expected OF or KNOWN AT")


def _by(attr: str) -> Callable[[Tokens, Query], None]:
    def read(t: Tokens, q: Query) -> None:
        t.need("BY")
        setattr(q, attr, t.name("a key"))
        if attr == "order_by":
            q.desc = t.eat("DESC")
            if not q.desc:
                t.eat("ASC")

    return read


def _why(t: Tokens, q: Query) -> None:
    q.why = True
    if t.eat("DEPTH"):
        q.depth = t.count("DEPTH")


def _attr(name: str, kind: str = "name") -> Callable[[Tokens, Query], None]:
    def read(t: Tokens, q: Query) -> None:
        setattr(q, name, t.name(name) if kind == "name" else t.count(name.upper()))

    return read


def _option(name: str, kind: str = "name") -> Callable[[Tokens, Query], None]:
    def read(t: Tokens, q: Query) -> None:
        q.options[name] = {"name": lambda: t.name(name), "count": lambda: t.count(name.upper()), "number": lambda: t.number(name.upper()), "when": t.when}[kind]()

    return read


def _names(t: Tokens, q: Query) -> None:
    if t.eat("EMBEDDING", "EMBEDDINGS"):
        q.options["embedding"] = True
        return
    q.names.append(t.name("a field"))
    while t.op(","):
        q.names.append(t.name("a field"))


def _similar(t: Tokens, q: Query) -> None:
    t.need("TO")
    q.options["event"] = t.name("an event id")


def _sets(t: Tokens, q: Query) -> None:
    while True:
        k = t.name("a field")
        if not t.op("="):
            raise QueryError(f"expected = after {k}")
        q.sets[k] = t.value()
        if not t.op(","):
            return


def _where(t: Tokens, q: Query) -> None:
    q.where = predicate(t)


CLAUSES: dict[str, Callable[[Tokens, Query], None]] = {
    "FACET": _attr("facet"), "AS": _as, "WHERE": _where, "GROUP": _by("group_by"), "HAVING": _having, "ORDER": _by("order_by"),
    "LIMIT": _attr("limit", "count"), "OFFSET": _attr("offset", "count"), "WHY": _why, "DEPTH": _attr("depth", "count"),
    "ON": _names, "WINDOW": _option("window", "count"), "STRIDE": _option("stride", "count"), "METRIC": _option("metric"),
    "MAXDIM": _option("maxdim", "count"), "NORMALIZE": lambda t, q: q.options.update(normalize=True), "RAW": lambda t, q: q.options.update(normalize=False),
    "SCALE": _option("scale", "number"), "EPS": _option("eps", "number"), "BUCKETS": _option("buckets", "count"),
    "ACROSS": lambda t, q: t.eat("FACETS") and None, "OF": _attr("subject"), "SIMILAR": _similar, "ALPHA": _option("alpha", "number"),
    "TOP": _option("top", "count"), "MIN": _option("min", "number"), "VIA": lambda t, q: q.options.update(via=t.name("a link type").upper()),
    "TYPE": lambda t, q: q.options.update(type=t.name("an event type").upper()), "SET": _sets, "EFFECTIVE": _option("effective", "when"),
    "CONFIDENCE": _option("confidence", "number"), "SCHEMA": _option("schema"), "PROVENANCE": _option("provenance"), "REF": _option("ref"),
    "USING": _option("model"), "LIKE": _attr("subject"),
}
TAIL = ("FACET", "AS", "WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET", "WHY")
_PUT = ("FACET", "TYPE", "SET", "EFFECTIVE", "CONFIDENCE", "SCHEMA", "PROVENANCE", "REF")


def _clauses(t: Tokens, q: Query, *allowed: str) -> Query:
    while t.sees(*allowed):
        CLAUSES[t.name("a clause").upper()](t, q)
    return q


def _item(t: Tokens) -> Item:
    w = t.name("a field or aggregate")
    if w.lower() in AGGREGATES and t.op("("):
        distinct = t.eat("DISTINCT")
        inner = t.name("a field or *")
        if not t.op(")"):
            raise QueryError(f"missing ) after {w}({inner}")
        agg = w.lower()
        return Item(inner, "count_distinct" if agg == "count" and distinct else agg)
    return Item(w)


def _facts(t: Tokens) -> Query:
    q = Query("facts")
    if not t.sees("OF"):
        q.items.append(_item(t))
        while t.op(","):
            q.items.append(_item(t))
    t.need("OF")
    q.subject = t.name("a subject")
    return _clauses(t, q, *TAIL)


def _history(t: Tokens) -> Query:
    t.need("OF")
    q = _clauses(t, Query("history", t.name("a subject")), *TAIL)
    if q.as_of or q.known_at:
        raise QueryError("HISTORY shows all of time: AS OF and AS KNOWN AT go with FACTS")
    return q


def _write(kind: str) -> Callable[[Tokens], Query]:
    def read(t: Tokens) -> Query:
        q = _clauses(t, Query("put", t.name("a subject"), options={"type": "OBSERVED" if kind == "PUT" else "CORRECTION"}), *_PUT)
        if "*" in q.subject:
            raise QueryError(f"{kind} needs one subject, no wildcard")
        if kind == "RETIRE":
            q.sets["retired"] = True
        if not q.sets:
            raise QueryError(f"{kind} needs SET")
        return q

    return read


def _pending(t: Tokens) -> Query:
    q = Query("pending", facet=t.name("a facet"))
    if t.eat("OLDER"):
        t.need("THAN")
        q.options["older_days"] = t.count("OLDER THAN")
        t.eat("DAYS", "DAY", "D")
    return q


def _of(kind: str, *allowed: str, need: bool = True, **defaults: Any) -> Callable[[Tokens], Query]:
    def read(t: Tokens) -> Query:
        q = Query(kind, **{k: v() if callable(v) else v for k, v in defaults.items()})
        if need:
            t.need("OF")
            q.subject = t.name("a subject")
        return _clauses(t, q, *allowed)

    return read


def _trace(kind: str) -> Callable[[Tokens], Query]:
    return lambda t: _clauses(t, Query(kind, depth=6, options={"event": t.name("an event id")}), "DEPTH")


def _match(t: Tokens) -> Query:
    q = Query("match", t.name("a subject pattern"), depth=3)
    if t.eat("CAUSES"):
        q.options["direction"] = "causes"
    else:
        t.need("CAUSED", "BY")
        q.options["direction"] = "caused_by"
    q.options["to"] = t.name("a subject pattern")
    return _clauses(t, q, "VIA", "DEPTH", "LIMIT")


def _define(t: Tokens) -> Query:
    t.need("SCHEMA")
    q = Query("define_schema", options={"id": t.name("a schema id"), "fields": {}})
    if t.eat("TITLE"):
        q.options["title"] = t.name("a title")
    t.op("(")
    while True:
        name, kind = t.name("a field"), t.name("a type").lower()
        if kind not in ("number", "string", "bool", "any"):
            raise QueryError(f"no such type {kind!r}: number, string, bool or any")
        f: dict[str, Any] = {"type": kind, "required": False}
        while t.sees("REQUIRED", "MIN", "MAX", "UNIT"):
            w = t.name("a rule").upper()
            f[w.lower()] = True if w == "REQUIRED" else t.name("a unit") if w == "UNIT" else t.number(w)
        q.options["fields"][name] = f
        if not t.op(","):
            break
    t.op(")")
    if t.eat("TITLE"):
        q.options["title"] = t.name("a title")
    return q


def _enrich(t: Tokens) -> Query:
    q = _clauses(t, Query("enrich", t.name("a subject pattern"), limit=50), "FACET")
    t.need("USING")
    q.options["model"] = t.name("a model")
    while t.sees("ON", "AS", "LIMIT"):
        if t.eat("ON"):
            q.options["on"] = t.name("a field")
        elif t.eat("AS"):
            q.options["as"] = t.name("a kind")
        else:
            t.need("LIMIT")
            q.limit = t.count("LIMIT")
    return q


def _watch(t: Tokens) -> Query:
    q = Query("watch", "*" if t.eat("ALL") else t.name("a subject or ALL"))
    if "*" in q.subject and q.subject != "*":
        raise QueryError("WATCH takes ALL or one subject")
    return _clauses(t, q, "FACET", "TYPE")


def _rollback(t: Tokens) -> Query:
    q = _clauses(t, Query("rollback", "*"), "OF")
    if t.eat("TO"):
        if t.eat("SNAPSHOT"):
            q.options["snapshot"] = t.quoted("a snapshot's name")
        elif not t.eat("LAST"):
            q.as_of = t.when()
    return q


def _diff(t: Tokens) -> Query:
    q = _clauses(t, Query("diff", "*"), "OF")
    t.need("BETWEEN")
    q.options["from"] = t.when()
    t.need("AND")
    q.options["to"] = t.when()
    return q


def _run(t: Tokens) -> Query:
    q = Query("run", t.name("a procedure"))
    if t.eat("WITH"):
        _sets(t, q)
    return q


def _cycles(t: Tokens) -> Query:
    t.eat("IN")
    t.eat("CAUSES")
    return _clauses(t, Query("cycles"), "OF")


def _explain(t: Tokens) -> Query:
    return Query("explain", options={"analyze": t.eat("ANALYZE")}, inner=_statement(t))


STATEMENTS: dict[str, Callable[[Tokens], Query]] = {
    "FACTS": _facts, "HISTORY": _history, "PROFILE": _of("profile", *TAIL), "SUBJECTS": _of("subjects", "LIKE", "LIMIT", need=False),
    "PUT": _write("PUT"), "CORRECT": _write("CORRECT"), "RETIRE": _write("RETIRE"), "PENDING": _pending,
    "DISAGREE": lambda t: (t.need("ON"), Query("disagree", names=[t.name("a field")]))[1], "WHY": _trace("why"), "EFFECTS": _trace("effects"),
    "SIMILAR": lambda t: (t.need("TO"), _clauses(t, Query("similar", options={"event": t.name("an event id"), "top": 10}), "TOP", "MIN"))[1],
    "CONTEXT": lambda t: (t.need("FOR"), _clauses(t, Query("context", t.name("a subject"), limit=20), "AS", "LIMIT"))[1],
    "STATS": lambda t: Query("stats"), "SCHEMAS": lambda t: Query("schemas"), "SCHEMA": lambda t: Query("schema", options={"id": t.name("a schema id")}),
    "DEFINE": _define, "SHAPE": _of("shape", "ON", "WINDOW", "STRIDE", "METRIC", "MAXDIM", "NORMALIZE", "RAW", "FACET", "SCALE", "AS", "LIMIT"),
    "CONSISTENCY": _of("consistency", "ON", "ACROSS", "EPS", "AS"), "CYCLES": _cycles, "DRIFT": _of("drift", "ON", "FACET", "BUCKETS"),
    "SEARCH": lambda t: _clauses(t, Query("search", "*", limit=20, options={"text": t.quoted("a query")}), "OF", "FACET", "SIMILAR", "ALPHA", "AS", "LIMIT"),
    "ASK": lambda t: Query("ask", options={"text": t.quoted("a question")}), "MATCH": _match, "ENRICH": _enrich,
    "SNAPSHOT": lambda t: Query("snapshot", options={"name": t.quoted("a name")}), "ROLLBACK": _rollback, "DIFF": _diff, "WATCH": _watch,
    "RUN": _run, "EXPLAIN": _explain,
}


def _statement(t: Tokens) -> Query:
    if t.at > 200:
        raise QueryError("EXPLAIN is nested too deep")
    word = t.name("a statement").upper()
    if word not in STATEMENTS:
        raise QueryError(f"unknown statement {word!r}")
    return STATEMENTS[word](t)


def parse(text: str, now: int) -> Query:
    """The statement in ``text``; times are folded at ``now`` (microseconds)."""
    t = Tokens(text, now)
    q = _statement(t)
    if t.kind != "end":
        raise QueryError(f"unexpected {t.shown()} after the statement")
    return check(q)
