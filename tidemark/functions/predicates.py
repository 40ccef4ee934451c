"""Predicates to Spark columns: two-valued, with mixed types compared as numbers where both are, else by how they print."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.fields import Field, glob, resolve, text_columns
from tidemark.plans.ast import Expr, QueryError

_SQL = {"=": "__eq__", ">": "__gt__", ">=": "__ge__", "<": "__lt__", "<=": "__le__", "!=": "__ne__"}


def printed(v: Any) -> str:
    if v is None:
        return "<nil>"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        x = float(v)
        if x == int(x) and abs(x) < 1e21:
            return str(int(x))
        s = repr(x)
        if "e" in s:
            m, e = s.split("e")
            return f"{m.removesuffix('.0')}e{e[0] if e[0] in '+-' else '+'}{e.lstrip('+-').zfill(2)}"
        return s
    return str(v)


def compared(f: Field, op: str, v: Any) -> Column:
    """``f op v``; null or false where it doesn't hold. Missing values are below all others: only ``!=`` (and ``>=`` with a
    null literal) holds for them."""
    test = lambda a, b: getattr(a, _SQL[op])(b)
    if v is None:
        by_print = test(f.text, F.lit("<nil>"))
        if op in ("=", "<", ">"):
            return f.exists & by_print
        return f.exists & by_print if op == "<=" else ~f.exists | by_print
    numeric = isinstance(v, (bool, int, float))
    if f.kind == "none":
        return F.lit(op == "!=")
    if not numeric or f.kind == "string":
        out = test(f.text, F.lit(printed(v)))
    elif f.kind in ("number", "bool"):
        out = test(f.column if f.kind == "number" else f.number, F.lit(float(v)))
    else:
        out = F.when(f.is_number, test(f.number, F.lit(float(v)))).otherwise(test(f.text, F.lit(printed(v))))
    return F.coalesce(out, F.lit(True)) if op == "!=" else out


def predicate(facts: DataFrame, e: Expr, strict: bool = False) -> Column:
    """The filter. Where a null is as good as false the plain comparison is kept, so that it reaches the scan; under NOT
    (``strict``) it is made false."""
    if e.op in ("and", "or"):
        parts = [predicate(facts, k, strict) for k in e.kids]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if e.op == "and" else out | p
        return out
    if e.op == "not":
        return ~predicate(facts, e.kids[0], True)
    out = _leaf(facts, e)
    return F.coalesce(out, F.lit(False)) if strict else out


def _leaf(facts: DataFrame, e: Expr) -> Column:
    if e.op == "matches":
        needle = printed(e.value).lower()
        if e.name.lower() in ("any", "*", "text"):
            out = F.lower("subject").contains(needle)
            for strings in text_columns(facts):
                out = out | F.coalesce(F.exists(strings, lambda s: F.coalesce(F.lower(s).contains(needle), F.lit(False))), F.lit(False))
            return out
        return F.lower(resolve(facts, e.name).string).contains(needle)
    f = resolve(facts, e.name)
    if e.op == "exists":
        return f.exists
    if e.op == "like":
        return glob(F.coalesce(f.text, F.lit("<nil>")), printed(e.value))
    if e.op == "in":
        values = [v for v in e.value if v is not None]
        if values and f.kind == "string" and all(isinstance(v, str) for v in values):
            return f.column.isin(values)
        if values and f.kind == "number" and all(isinstance(v, (int, float)) for v in values):
            return f.number.isin([float(v) for v in values])
        out = F.lit(False)
        for v in e.value:
            out = out | F.coalesce(compared(f, "=", v), F.lit(False))
        return out
    if e.op in _SQL:
        return compared(f, e.op, e.value)
    raise QueryError(f"unknown operator {e.op!r}")
