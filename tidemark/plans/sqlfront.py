"""Read-only SELECT, the lean SQL door: one table, no joins, no subqueries; it ends as the same ``Query``."""

from __future__ import annotations

import re
from typing import Any

from tidemark.functions import naturaltime
from tidemark.plans.ast import Expr, Having, Item, Query, QueryError, check

_LEX = re.compile(r"'((?:[^']|'')*)'|\"([^\"]*)\"|(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)(?![\w:/\-])|(!=|<>|<=|>=|[(),=<>*])|([\w][\w.:/*@-]*)|.", re.S)
_AGGS = ("count", "sum", "avg", "min", "max")


class _Reader:
    def __init__(self, text: str, now: int):
        self.now, self.at, self.toks = now, 0, []
        for m in _LEX.finditer(text.strip().rstrip(";")):
            if m[1] is not None:
                self.toks.append(("str", m[1].replace("''", "'")))
            elif m[2] is not None:
                self.toks.append(("word", m[2]))
            elif m[3]:
                self.toks.append(("num", float(m[3])))
            elif m[4]:
                self.toks.append(("op", "!=" if m[4] == "<>" else m[4]))
            elif m[5]:
                self.toks.append(("word", m[5]))

    def look(self, k: int = 0) -> tuple[str, Any]:
        return self.toks[self.at + k] if self.at + k < len(self.toks) else ("end", "the end")

    def sees(self, *words: str) -> bool:
        return self.look()[0] == "word" and self.look()[1].upper() in words

    def eat(self, *words: str) -> bool:
        got = self.sees(*words)
        self.at += got
        return got

    def op(self, *ops: str) -> str:
        if self.look()[0] == "op" and self.look()[1] in ops:
            self.at += 1
            return self.toks[self.at - 1][1]
        return ""

    def need(self, *words: str) -> None:
        for w in words:
            if not self.eat(w):
                raise QueryError(f"lean SQL: expected {w}, got {self.look()[1]!r}")

    def name(self) -> str:
        kind, v = self.look()
        if kind != "word":
            raise QueryError(f"lean SQL: expected a name, got {v!r}")
        self.at += 1
        return v

    def literal(self) -> Any:
        kind, v = self.look()
        if kind not in ("str", "num", "word"):
            raise QueryError(f"lean SQL: expected a value, got {v!r}")
        self.at += 1
        return {"true": True, "false": False, "null": None}.get(v.lower(), v) if kind == "word" else v

    def count(self) -> int:
        v = self.literal()
        if not isinstance(v, float) or v < 0:
            raise QueryError("lean SQL: expected a number")
        return int(v)

    def when(self) -> int:
        self.eat("TIMESTAMP")
        kind, v = self.look()
        self.at += 1
        try:
            return int(v) if kind == "num" else naturaltime.parse(str(v), self.now)
        except ValueError as e:
            raise QueryError(f"lean SQL: {e}") from e


def _item(r: _Reader) -> Item:
    if r.op("*"):
        return Item("*")
    name = r.name()
    item = Item(name)
    if name.lower() in _AGGS and r.op("("):
        if r.eat("DISTINCT"):
            raise QueryError("lean SQL: DISTINCT aggregates aren't supported")
        arg = "*" if r.op("*") else r.name()
        if not r.op(")"):
            raise QueryError(f"lean SQL: expected ) after {name}(")
        item = Item(arg, name.lower())
    if r.sees("AS") and r.look(1)[0] == "word" and r.look(1)[1].upper() not in ("OF", "KNOWN"):
        r.at += 2  # aliases are read and dropped
    return item


def _table(r: _Reader) -> str:
    kind, v = r.look()
    if kind not in ("str", "word"):
        raise QueryError(f"lean SQL: expected a table, got {v!r}")
    r.at += 1
    if kind == "str":
        return v
    if v.lower() in ("facts", "events"):
        return "*"
    return v if any(c in v for c in ":*/") else f"{v}:*"


def _or(r: _Reader, depth: int = 0) -> Expr:
    kids = [_and(r, depth)]
    while r.eat("OR"):
        kids.append(_and(r, depth))
    return kids[0] if len(kids) == 1 else Expr("or", tuple(kids))


def _and(r: _Reader, depth: int) -> Expr:
    kids = [_not(r, depth)]
    while r.eat("AND"):
        kids.append(_not(r, depth))
    return kids[0] if len(kids) == 1 else Expr("and", tuple(kids))


def _not(r: _Reader, depth: int) -> Expr:
    if depth > 100:
        raise QueryError("lean SQL: nested too deep")
    if r.eat("NOT"):
        return Expr("not", (_not(r, depth + 1),))
    if r.op("("):
        e = _or(r, depth + 1)
        if not r.op(")"):
            raise QueryError("lean SQL: missing )")
        return e
    name = r.name()
    negated = r.eat("NOT")
    if r.eat("IN"):
        if not r.op("("):
            raise QueryError("lean SQL: IN needs a list")
        values = [r.literal()]
        while r.op(","):
            values.append(r.literal())
        if not r.op(")"):
            raise QueryError("lean SQL: missing ) after IN")
        e = Expr("in", name=name, value=tuple(values))
    elif r.eat("LIKE"):
        e = Expr("like", name=name, value=str(r.literal()))
    elif not negated and r.eat("IS"):
        inverse = r.eat("NOT")
        r.need("NULL")
        e = Expr("exists", name=name)
        return e if inverse else Expr("not", (e,))
    else:
        op = "" if negated else r.op("=", "!=", "<", "<=", ">", ">=")
        if not op:
            raise QueryError(f"lean SQL: expected a comparison after {name}")
        return Expr(op, name=name, value=r.literal())
    return Expr("not", (e,)) if negated else e


def _lift(e: Expr, q: Query) -> Expr | None:
    """Top-level equalities on subject and facet become the statement's own."""
    left = []
    for k in e.kids if e.op == "and" else (e,):
        if k.op == "=" and k.name.lower() == "subject" and isinstance(k.value, str) and "*" not in k.value:
            q.subject = k.value
        elif k.op == "=" and k.name.lower() == "facet" and isinstance(k.value, str):
            q.facet = k.value
        else:
            left.append(k)
    return None if not left else left[0] if len(left) == 1 else Expr("and", tuple(left))


def parse_sql(text: str, now: int) -> Query:
    r = _Reader(text, now)
    if not r.eat("SELECT"):
        raise QueryError("lean SQL is SELECT only")
    items = [_item(r)]
    while r.op(","):
        items.append(_item(r))
    r.need("FROM")
    q = Query("facts", _table(r), items)
    if r.eat("WHERE"):
        q.where = _lift(_or(r), q)
    while r.look()[0] != "end":
        if r.eat("GROUP"):
            r.need("BY")
            q.group_by = r.name()
        elif r.eat("HAVING"):
            while True:
                agg = r.name().lower()
                if agg not in _AGGS or not r.op("("):
                    raise QueryError("lean SQL: HAVING needs an aggregate")
                arg = "*" if r.op("*") else r.name()
                op = r.op("=", "!=", "<", "<=", ">", ">=") if r.op(")") else ""
                value = r.literal()
                if not op or not isinstance(value, float):
                    raise QueryError("lean SQL: HAVING compares with a number")
                q.having.append(Having(agg, arg, op, value))
                if not r.eat("AND"):
                    break
        elif r.eat("ORDER"):
            r.need("BY")
            q.order_by = r.name()
            q.desc = r.eat("DESC")
            if not q.desc:
                r.eat("ASC")
        elif r.eat("LIMIT"):
            q.limit = r.count()
        elif r.eat("OFFSET"):
            q.offset = r.count()
        elif r.eat("AS"):
            if r.eat("OF"):
                q.as_of = r.when()
            else:
                r.need("KNOWN", "AT")
                q.known_at = r.when()
        elif r.eat("FOR"):
            r.need("SYSTEM_TIME", "AS", "OF")
            q.known_at = r.when()
        else:
            raise QueryError(f"lean SQL: unexpected {r.look()[1]!r}")
    return check(q)
