"""Statements and predicates as plain data; the text front doors and callers from Python make the same objects."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

AGGREGATES = ("count", "sum", "avg", "min", "max", "median", "stddev", "listagg", "approx_count_distinct")
COMPARISONS = ("=", "!=", ">", ">=", "<", "<=")
KINDS = frozenset(
    "facts history subjects put pending disagree why effects similar context stats schemas schema define_schema shape consistency "
    "cycles drift search ask match enrich snapshot rollback diff watch run explain profile".split()
)
MOST_DEPTH = 100


@dataclass(frozen=True)
class Item:
    """A projected name, or an aggregate of it."""

    name: str
    agg: str = ""

    @property
    def label(self) -> str:
        return f"{self.agg}({self.name})" if self.agg else self.name


@dataclass(frozen=True)
class Having:
    agg: str
    name: str
    op: str
    value: float


@dataclass(frozen=True)
class Expr:
    """op: and, or, not (over kids); exists, in, like, matches or a comparison (over name and value)."""

    op: str
    kids: tuple[Expr, ...] = ()
    name: str = ""
    value: Any = None


@dataclass
class Query:
    kind: str
    subject: str = ""
    items: list[Item] = field(default_factory=list)
    facet: str = ""
    as_of: int = 0
    known_at: int = 0
    where: Expr | None = None
    group_by: str = ""
    having: list[Having] = field(default_factory=list)
    order_by: str = ""
    desc: bool = False
    limit: int = 0
    offset: int = 0
    why: bool = False
    depth: int = 0
    names: list[str] = field(default_factory=list)
    sets: dict[str, Any] = field(default_factory=dict)
    options: dict[str, Any] = field(default_factory=dict)
    inner: Query | None = None


class QueryError(ValueError):
    pass


def check(q: Query) -> Query:
    """Refuses trees that no parser makes: unknown kinds and operators, wrong numbers of operands, too deep nesting."""
    if q.kind not in KINDS:
        raise QueryError(f"unknown statement {q.kind!r}")
    if q.kind == "explain":
        if q.inner is None:
            raise QueryError("EXPLAIN needs a statement")
        depth, inner = 0, q.inner
        while inner.kind == "explain" and inner.inner is not None:
            depth, inner = depth + 1, inner.inner
            if depth > MOST_DEPTH:
                raise QueryError("EXPLAIN is nested too deep")
        check(q.inner)
    for i in q.items:
        if i.agg and i.agg not in (*AGGREGATES, "count_distinct"):
            raise QueryError(f"unknown aggregate {i.agg!r}")
    for n in (q.limit, q.offset, q.depth):
        if n < 0:
            raise QueryError("counts must not be negative")
    work = [(q.where, 0)] if q.where is not None else []
    while work:
        e, depth = work.pop()
        if not isinstance(e, Expr):
            raise QueryError("a predicate is missing")
        if depth > MOST_DEPTH:
            raise QueryError("predicates are nested too deep")
        if e.op in ("and", "or"):
            if not e.kids:
                raise QueryError(f"{e.op} needs operands")
        elif e.op == "not":
            if len(e.kids) != 1:
                raise QueryError("not needs one operand")
        elif e.op not in (*COMPARISONS, "exists", "in", "like", "matches"):
            raise QueryError(f"unknown operator {e.op!r}")
        elif not e.name:
            raise QueryError(f"{e.op} needs a field")
        work += [(k, depth + 1) for k in e.kids]
    return q
