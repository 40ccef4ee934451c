"""A small sandboxed template language, compiled to Python closures (operator 7).

Language: text, ``{{ expr }}``, ``{% if %} {% elif %} {% else %} {% endif %}``, ``{% for x in expr if test %} {% else %} {% endfor %}``
(``for k, v in`` unpacks; ``loop`` has index, index0, revindex, revindex0, first, last, length, previtem and nextitem;
``{% break %}`` and ``{% continue %}``), ``{% set x = expr %}``, ``{% set ns.x = expr %}`` on what ``namespace(...)`` made,
``{% set x %}text{% endset %}``, ``{% macro f(a, b=1) %} {% endmacro %}``, ``{% raw %} {% endraw %}``, ``{% generation %}
{% endgeneration %}`` (marks what a model is to produce), ``{# comment #}``. ``-`` at either end of a tag strips blanks;
with ``trim=True`` a statement also takes the line break after it and the indentation before it.

Expressions: literals, lists, tuples, mappings, names, ``a.b``, ``a['b']``, slices, ``+ ~ - * / // %``, comparisons (chained
too), ``in``, ``not in``, ``and or not``, ``a if c else b``, tests (``is defined``, ``is not none``, ...: TESTS), filters (FILTERS),
calls of ``range namespace dict raise_exception`` and of the template's macros, and the methods in METHODS.

Attribute access reaches only keys of mappings and of namespaces; methods are those of a fixed list, on strings, mappings and
lists only; there are no imports, and nothing outside the template's own names is assigned, so that a template can't reach
Python. Numbers of steps, lengths of ranges and of texts are bounded (``MOST_STEPS``, ``MOST_TEXT``): a template over them
fails, it doesn't hang. A name that stands for nothing is undefined: false, empty, printed as nothing. None prints as nothing,
true and false in lower case. What is set in a loop ends with its round, in a branch it stays. A generation block inside a
macro or a ``set`` block marks nothing, as its text has no place yet.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class TemplateError(ValueError):
    pass


MOST_STEPS, MOST_TEXT = 1_000_000, 1 << 28
_STRING = r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\""
_TAG = re.compile(r"\{\{[-+]?(?>" + _STRING + r"|(?![-+]?\}\}).)*+[-+]?\}\}|\{%[-+]?(?>" + _STRING + r"|(?![-+]?%\}).)*+[-+]?%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+\.\d+|\d+)|(" + _STRING + r")|([A-Za-z_]\w*)|(==|!=|<=|>=|//|[-+*/%~<>().,:=\[\]{}|]))", re.S)
_RAW = re.compile(r"\{%[-+]?\s*raw\s*[-+]?%\}(.*?)\{%[-+]?\s*endraw\s*[-+]?%\}", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"'}


class _Undefined:
    """What a name without a value stands for."""

    __slots__ = ()

    def __bool__(self) -> bool:
        return False

    def __iter__(self) -> Iterator:
        return iter(())

    def __len__(self) -> int:
        return 0


UNDEFINED = _Undefined()


class Namespace:
    """What ``namespace(...)`` makes: the one thing that can be changed from inside a loop."""

    __slots__ = ("values",)

    def __init__(self, values: dict[str, Any]):
        self.values = values


def _no(what: str) -> Any:
    raise TemplateError(what)


def _text(v: Any) -> str:
    if isinstance(v, str):
        return v
    return "" if v is None or v is UNDEFINED else "true" if v is True else "false" if v is False else _plain(v)


def _plain(v: Any) -> str:
    return str(v) if isinstance(v, (int, float)) else _json(v) if isinstance(v, (list, tuple, dict)) else _no("this has no text")


def _bounded(s: str) -> str:
    return s if len(s) <= MOST_TEXT else _no("text too long")


def _json(v: Any, indent: int | None = None) -> str:
    try:
        return json.dumps(v, ensure_ascii=False, indent=indent)
    except TypeError as e:
        raise TemplateError(f"no JSON: {e}") from None


def _items(v: Any) -> list:
    return list(v.items()) if isinstance(v, dict) else [] if v is UNDEFINED else _no("only mappings have items")


def _list(v: Any) -> list:
    if isinstance(v, (list, tuple, str, dict, range)):
        return list(v)
    return [] if v is UNDEFINED or v is None else _no("not a list")


def _default(v: Any, d: Any = "", falsy: bool = False) -> Any:
    return d if v is UNDEFINED or v is None or (falsy and not v) else v


def _path(v: Any, name: Any) -> Any:
    for part in str(name).split("."):
        v = _item(v, int(part) if part.isdigit() else part)
    return v


def _map(v: Any, f: str = "", *args: Any, attribute: Any = None, default: Any = UNDEFINED) -> list:
    if attribute is not None:
        return [default if (x := _path(e, attribute)) is UNDEFINED else x for e in _list(v)]
    return [FILTERS.get(f, lambda *_: _no(f"no filter {f!r}"))(e, *args) for e in _list(v)]


def _select(v: Any, wanted: bool, get: Callable[[Any], Any], test: str, args: tuple) -> list:
    f = TESTS.get(test) or _no(f"no test {test!r}")
    return [e for e in _list(v) if bool(f(get(e), *args)) == wanted]


def _unique(v: Any) -> list:
    out: list = []
    for x in _list(v):
        if x not in out:
            out.append(x)
    return out


def _joined(sep: Any, v: list) -> str:
    sep, texts = _text(sep), [_text(x) for x in v]
    return sep.join(texts) if sum(map(len, texts)) + len(sep) * len(texts) <= MOST_TEXT else _no("text too long")


def _replace(v: Any, a: Any, b: Any, n: int = -1) -> str:
    v, a, b = _text(v), _text(a), _text(b)
    return v.replace(a, b, n) if len(v) + (v.count(a) if n < 0 else min(n, v.count(a))) * len(b) <= MOST_TEXT else _no("text too long")


def _indent(v: Any, width: int = 4, first: bool = False) -> str:
    pad = " " * min(width, 100)
    lines = _text(v).split("\n")
    _ = len(lines) * len(pad) <= MOST_TEXT or _no("text too long")
    return "\n".join((pad if x and (i or first) else "") + x for i, x in enumerate(lines))


FILTERS: dict[str, Callable[..., Any]] = {
    "trim": lambda v, chars=None: _text(v).strip(chars),
    "upper": lambda v: _text(v).upper(),
    "lower": lambda v: _text(v).lower(),
    "title": lambda v: _text(v).title(),
    "capitalize": lambda v: _text(v).capitalize(),
    "string": _text,
    "safe": lambda v: v,
    "length": lambda v: len(v) if v is not None else 0,
    "count": lambda v: len(v) if v is not None else 0,
    "default": _default,
    "d": _default,
    "tojson": _json,
    "join": lambda v, sep="", attribute=None: _joined(sep, [x if attribute is None else _path(x, attribute) for x in _list(v)]),
    "first": lambda v: next(iter(_list(v)), UNDEFINED),
    "last": lambda v: (_list(v) or [UNDEFINED])[-1],
    "list": _list,
    "items": _items,
    "dictsort": lambda v: sorted(_items(v), key=lambda x: _text(x[0]).lower()),
    "reverse": lambda v: v[::-1] if isinstance(v, str) else _list(v)[::-1],
    "sort": lambda v, reverse=False, attribute=None: sorted(_list(v), key=lambda x: x if attribute is None else _path(x, attribute), reverse=bool(reverse)),
    "unique": _unique,
    "map": _map,
    "select": lambda v, test="true", *args: _select(v, True, lambda e: e, test, args),
    "reject": lambda v, test="true", *args: _select(v, False, lambda e: e, test, args),
    "selectattr": lambda v, name, test="true", *args: _select(v, True, lambda e: _path(e, name), test, args),
    "rejectattr": lambda v, name, test="true", *args: _select(v, False, lambda e: _path(e, name), test, args),
    "replace": _replace,
    "indent": _indent,
    "int": lambda v, d=0: _number(int, v, d),
    "float": lambda v, d=0.0: _number(float, v, d),
    "abs": lambda v: abs(v),
    "min": lambda v: min(_list(v), default=UNDEFINED),
    "max": lambda v: max(_list(v), default=UNDEFINED),
    "sum": lambda v: sum(_list(v)),
}


def _number(kind: type, v: Any, d: Any) -> Any:
    try:
        return kind(v)
    except (TypeError, ValueError):
        return d


_is_number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
TESTS: dict[str, Callable[..., Any]] = {
    "defined": lambda v: v is not UNDEFINED,
    "undefined": lambda v: v is UNDEFINED,
    "none": lambda v: v is None,
    "true": bool,
    "false": lambda v: not v,
    "boolean": lambda v: isinstance(v, bool),
    "string": lambda v: isinstance(v, str),
    "number": _is_number,
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool),
    "float": lambda v: isinstance(v, float),
    "mapping": lambda v: isinstance(v, dict),
    "sequence": lambda v: isinstance(v, (list, tuple, str, range)),
    "iterable": lambda v: isinstance(v, (list, tuple, str, dict, range)),
    "odd": lambda v: v % 2 == 1,
    "even": lambda v: v % 2 == 0,
    "divisibleby": lambda v, n: v % n == 0,
    "equalto": lambda v, x: v == x,
    "eq": lambda v, x: v == x,
    "ne": lambda v, x: v != x,
    "in": lambda v, x: v in x,
    "lower": lambda v: _text(v).islower(),
    "upper": lambda v: _text(v).isupper(),
}
_STR_METHODS = frozenset("strip lstrip rstrip split rsplit startswith endswith upper lower title capitalize find removeprefix removesuffix splitlines isdigit isspace isupper islower count".split())
METHODS: dict[type, dict[str, Callable[..., Any]]] = {
    str: {n: getattr(str, n) for n in _STR_METHODS} | {"replace": _replace, "join": lambda v, xs: _joined(v, _list(xs))},
    dict: {"items": _items, "keys": list, "values": lambda v: list(v.values()), "get": lambda v, k, d=None: v.get(k, d)},
    list: {"index": lambda v, x: v.index(x), "count": lambda v, x: v.count(x)},
}


def _range(*args: Any) -> range:
    r = range(*args)
    return r if len(r) <= MOST_STEPS else _no("range too long")


def _raise(message: Any = "") -> Any:
    raise TemplateError(_text(message))


FUNCTIONS: dict[str, Callable[..., Any]] = {"range": _range, "namespace": lambda **kw: Namespace(kw), "dict": lambda **kw: kw, "raise_exception": _raise}
#: These depend on when they run, or make something new each time.
_NOT_CONSTANT = frozenset(("namespace", "raise_exception"))


# ---- expressions: tuples are the syntax tree ----
def _lex(src: str) -> list[tuple[str, Any]]:
    out, at = [], 0
    src = src.strip()
    while at < len(src):
        m = _TOKEN.match(src, at)
        if not m:
            raise TemplateError(f"can't read {src[at : at + 20]!r}")
        at = m.end()
        num, string, name, op = m.groups()
        if num is not None:
            out.append(("const", float(num) if "." in num else int(num)))
        elif string is not None:
            out.append(("const", re.sub(r"\\(.)", lambda x: _ESCAPES.get(x[1], x[1]), string[1:-1], flags=re.S)))
        elif name is not None:
            out.append(("name", name))
        else:
            out.append(("op", op))
    return out


_COMPARE = ("==", "!=", "<", "<=", ">", ">=", "in", "not in")
_WORDS = frozenset("and or not in is if else".split())


class _Parser:
    def __init__(self, src: str):
        self.toks, self.i = _lex(src), 0

    def peek(self, *values: str) -> bool:
        return self.i < len(self.toks) and self.toks[self.i][0] in ("op", "name") and self.toks[self.i][1] in values

    def take(self, *values: str) -> str:
        if not self.peek(*values):
            raise TemplateError(f"expected {' or '.join(values)}")
        self.i += 1
        return self.toks[self.i - 1][1]

    def has(self, value: str) -> bool:
        """Takes ``value`` if it comes next."""
        if self.peek(value):
            self.i += 1
            return True
        return False

    def name(self) -> str:
        if self.i >= len(self.toks) or self.toks[self.i][0] != "name":
            raise TemplateError("expected a name")
        self.i += 1
        return self.toks[self.i - 1][1]

    def end(self) -> None:
        if self.i != len(self.toks):
            raise TemplateError(f"unexpected {self.toks[self.i][1]!r}")

    def expr(self):
        a = self.either()
        if self.has("if"):
            c = self.either()
            return ("cond", c, a, self.expr() if self.has("else") else ("const", UNDEFINED))
        return a

    def either(self):
        a = self.both()
        while self.has("or"):
            a = ("or", a, self.both())
        return a

    def both(self):
        a = self.negation()
        while self.has("and"):
            a = ("and", a, self.negation())
        return a

    def negation(self):
        return ("not", self.negation()) if self.has("not") else self.compared()

    def compared(self):
        a, steps = self.sum(), []
        while True:
            if self.peek("not") and self.i + 1 < len(self.toks) and self.toks[self.i + 1] == ("name", "in"):
                self.i += 2
                steps.append(("not in", self.sum()))
            elif self.peek(*_COMPARE):
                steps.append((self.take(*_COMPARE), self.sum()))
            else:
                break
        if len(steps) == 1:
            return (steps[0][0], a, steps[0][1])
        return ("chain", tuple(op for op, _ in steps), a, *[x for _, x in steps]) if steps else a

    def sum(self):
        a = self.product()
        while self.peek("+", "-", "~"):
            a = (self.take("+", "-", "~"), a, self.product())
        return a

    def product(self):
        a = self.unary()
        while self.peek("*", "/", "//", "%"):
            a = (self.take("*", "/", "//", "%"), a, self.unary())
        return a

    def unary(self):
        if self.has("-"):
            return ("-", ("const", 0), self.unary())
        return self.unary() if self.has("+") else self.postfix()

    def listed(self, end: str) -> list:
        out = []
        while not self.has(end):
            out.append(self.expr())
            if not self.peek(end):
                self.take(",")
        return out

    def arguments(self) -> tuple[list, list]:
        """What stands in brackets behind a name: values, and (name, value)."""
        args, named = [], []
        while not self.has(")"):
            if self.i + 1 < len(self.toks) and self.toks[self.i][0] == "name" and self.toks[self.i + 1] == ("op", "="):
                n = self.name()
                self.take("=")
                named.append((n, self.expr()))
            elif named:
                raise TemplateError("a value after a named one")
            else:
                args.append(self.expr())
            if not self.peek(")"):
                self.take(",")
        return args, named

    def atom(self):
        if self.has("("):
            if self.has(")"):
                return ("list",)
            a = self.expr()
            if self.has(","):
                return ("list", a, *self.listed(")"))
            self.take(")")
            return a
        if self.has("["):
            return ("list", *self.listed("]"))
        if self.has("{"):
            pairs = []
            while not self.has("}"):
                k = self.expr()
                self.take(":")
                pairs += [k, self.expr()]
                if not self.peek("}"):
                    self.take(",")
            return ("dict", *pairs)
        if self.i >= len(self.toks):
            raise TemplateError("unexpected end")
        kind, v = self.toks[self.i]
        self.i += 1
        if kind == "const":
            while self.i < len(self.toks) and isinstance(v, str) and self.toks[self.i][0] == "const" and isinstance(self.toks[self.i][1], str):
                v += self.toks[self.i][1]  # strings side by side are one
                self.i += 1
            return ("const", v)
        if kind == "name" and v not in _WORDS:
            return ("const", {"true": True, "false": False, "none": None}[v.lower()]) if v.lower() in ("true", "false", "none") else ("name", v)
        raise TemplateError(f"unexpected {v!r}")

    def postfix(self):
        a = self.atom()
        while self.peek(".", "[", "|", "(", "is"):
            op = self.take(".", "[", "|", "(", "is")
            if op == ".":
                n = str(self.toks[self.i][1]) if self.i < len(self.toks) and isinstance(self.toks[self.i][1], int) else self.name()
                if str(n).isdigit():
                    self.i += 1
                    a = ("item", a, ("const", int(n)))
                elif self.has("("):
                    args, named = self.arguments()
                    a = ("method", n, tuple(k for k, _ in named), a, *args, *[x for _, x in named])
                else:
                    a = ("item", a, ("const", n))
            elif op == "[":
                parts: list = [None]
                while not self.has("]"):
                    if self.has(":"):
                        parts.append(None)
                    elif parts[-1] is None:
                        parts[-1] = self.expr()
                    else:
                        raise TemplateError("expected ]")
                if len(parts) > 3 or parts == [None]:
                    raise TemplateError("bad index")
                a = ("item", a, parts[0]) if len(parts) == 1 else ("slice", a, *[x or ("const", None) for x in [*parts, None][:3]])
            elif op == "|":
                f = self.name()
                if f not in FILTERS:
                    raise TemplateError(f"no filter {f!r}")
                args, named = self.arguments() if self.has("(") else ([], [])
                a = ("filter", f, tuple(k for k, _ in named), a, *args, *[x for _, x in named])
            elif op == "is":
                no = self.has("not")
                t = self.name()
                if t.lower() not in TESTS:
                    raise TemplateError(f"no test {t!r}")
                args = self.arguments()[0] if self.has("(") else [self.postfix()] if t.lower() in ("divisibleby", "equalto", "eq", "ne", "in") else []
                a = ("test", t.lower(), (), a, *args)
                a = ("not", a) if no else a
            else:
                if a[0] != "name":
                    raise TemplateError("only functions and macros can be called")
                args, named = self.arguments()
                a = ("call", a[1], tuple(k for k, _ in named), *args, *[x for _, x in named])
        return a


def _add(a: Any, b: Any) -> Any:
    if _is_number(a) and _is_number(b):
        return a + b
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        return [*a, *b] if len(a) + len(b) <= MOST_STEPS else _no("list too long")
    return _bounded(_text(a) + _text(b))


def _numbers(f: Callable[[Any, Any], Any]) -> Callable[[Any, Any], Any]:
    return lambda a, b: f(a, b) if isinstance(a, (int, float)) and isinstance(b, (int, float)) else _no("not numbers")


def _within(a: Any, b: Any) -> bool:
    return b is not None and b is not UNDEFINED and a in b


_BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "+": _add,
    "~": lambda a, b: _bounded(_text(a) + _text(b)),
    "-": _numbers(lambda a, b: a - b),
    "*": _numbers(lambda a, b: a * b if not (isinstance(a, int) and isinstance(b, int)) or a.bit_length() + b.bit_length() < 4096 else _no("number too large")),
    "/": _numbers(lambda a, b: a / b),
    "//": _numbers(lambda a, b: a // b),
    "%": _numbers(lambda a, b: a % b),
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "in": _within,
    "not in": lambda a, b: not _within(a, b),
}
#: Kinds whose second entry is a name, and whose third are names of arguments.
_NAMED = frozenset(("filter", "test", "method", "call"))
_FAILS = (TypeError, ValueError, ArithmeticError, LookupError, AttributeError, RecursionError)


def fold(e: tuple) -> tuple:
    """The expression with all constant parts computed. What fails is left for the time it is run, if it is."""
    kind = e[0]
    if kind in ("const", "name"):
        return e
    head = e[: 3 if kind in _NAMED else 2 if kind == "chain" else 1]
    args = [fold(x) for x in e[len(head) :]]
    if kind in ("and", "or", "cond") and args[0][0] == "const":
        v = args[0][1]
        if kind == "cond":
            return args[1] if v else args[2]
        return args[1] if bool(v) == (kind == "and") else args[0]
    new = (*head, *args)
    if all(x[0] == "const" for x in args) and kind not in ("list", "dict") and not (kind == "call" and (e[1] in _NOT_CONSTANT or e[1] not in FUNCTIONS)):
        try:
            v = _closure(new)({})
        except _FAILS:
            return new
        if not isinstance(v, (list, dict)):  # these are made anew each time
            return ("const", v)
    return new


def _item(v: Any, k: Any) -> Any:
    if isinstance(v, dict):
        return v.get(k, UNDEFINED) if isinstance(k, (str, int, float, bool)) or k is None else UNDEFINED
    if isinstance(v, Namespace):
        return v.values.get(k, UNDEFINED)
    if isinstance(v, (list, tuple, str, range)) and isinstance(k, int) and not isinstance(k, bool):
        return v[k] if -len(v) <= k < len(v) else UNDEFINED
    return UNDEFINED


def _method(v: Any, name: str) -> Callable[..., Any]:
    """A method of the list, or what a mapping holds under the name, never called: that isn't code."""
    for kind, known in METHODS.items():
        if isinstance(v, kind) and name in known:
            return known[name]
    return _no(f"no method {name!r}")


def _called(f: Callable[..., Any], args: list, names: tuple[str, ...], env: dict) -> Any:
    values = [a(env) for a in args]
    n = len(values) - len(names)
    return f(*values[:n], **dict(zip(names, values[n:])))


def _closure(e: tuple) -> Callable[[dict], Any]:
    kind = e[0]
    if kind == "const":
        v = e[1]
        return lambda env: v
    if kind == "name":
        n = e[1]
        return lambda env: env.get(n, UNDEFINED)
    if kind in _NAMED:
        name, names, args = e[1], e[2], [_closure(x) for x in e[3:]]
        if kind == "method":
            own = args.pop(0)

            def call(env: dict) -> Any:
                v = own(env)
                return _called(lambda *a, **k: _method(v, name)(v, *a, **k), args, names, env)

            return call
        if kind == "call":
            return lambda env: _called(env.get(_MACRO + name) or FUNCTIONS.get(name) or _no(f"no function {name!r}"), args, names, env)
        f = (FILTERS if kind == "filter" else TESTS)[name]
        if len(args) == 1:
            a = args[0]
            return lambda env: f(a(env))
        return lambda env: _called(f, args, names, env)
    if kind == "chain":
        ops, args = [_BINARY[x] for x in e[1]], [_closure(x) for x in e[2:]]

        def chain(env: dict) -> bool:
            a = args[0](env)
            for op, x in zip(ops, args[1:]):
                b = x(env)
                if not op(a, b):
                    return False
                a = b
            return True

        return chain
    args = [_closure(x) for x in e[1:]]
    if kind == "list":
        return lambda env: [x(env) for x in args]
    if kind == "dict":
        return lambda env: {k(env): v(env) for k, v in zip(args[::2], args[1::2])}
    a = args[0]
    if kind == "not":
        return lambda env: not a(env)
    b = args[1]
    if kind == "item":
        return lambda env: _item(a(env), b(env))
    if kind == "slice":
        lo, hi, step = args[1:]
        return lambda env: v[lo(env) : hi(env) : step(env)] if isinstance(v := a(env), (list, tuple, str, range)) else []
    if kind == "and":
        return lambda env: a(env) and b(env)
    if kind == "or":
        return lambda env: a(env) or b(env)
    if kind == "cond":
        c = args[2]
        return lambda env: b(env) if a(env) else c(env)
    op = _BINARY[kind]
    return lambda env: op(a(env), b(env))


# ---- statements ----
_MACRO, _STEPS = "macro ", "steps "  # with a blank, as no variable has


def _count(env: dict) -> None:
    env[_STEPS][0] += 1
    if env[_STEPS][0] > MOST_STEPS:
        raise TemplateError("too many steps")


def _parts(src: str, trim: bool) -> list[tuple[str, str]]:
    """Text, ``{{`` and ``{%`` in turn, blanks stripped where the tags say so."""
    out: list[tuple[str, str]] = []
    at, strip = 0, ""

    def text(s: str, left: str, right: str) -> None:
        fresh = not out
        if left == "-":
            s = s.lstrip()
        elif left == "line" and s.startswith("\n"):
            s, fresh = s[1:], True
        if right == "-":
            s = s.rstrip()
        elif right == "line" and not (rest := s[s.rfind("\n") + 1 :]).strip(" \t") and (len(rest) < len(s) or fresh):
            s = s[: len(s) - len(rest)]
        out.append(("text", s))

    while True:
        m = _TAG.search(src, at)
        if m is None:
            break
        tag = m[0]
        block = tag[1] in "%#"
        text(src[at : m.start()], strip, "-" if tag[2] == "-" else "line" if trim and block and tag[2] != "+" else "")
        strip = "-" if tag[-3] == "-" and len(tag) > 4 else "line" if trim and block and tag[-3] != "+" else ""
        at = m.end()
        body = tag[3 if tag[2] in "-+" and len(tag) > 4 else 2 : -3 if tag[-3] in "-+" and len(tag) > 5 else -2].strip()
        if tag[1] == "%" and body == "raw":
            raw = _RAW.match(src, m.start())
            if raw is None:
                raise TemplateError("missing endraw")
            out.append(("text", raw[1]))
            at, strip = raw.end(), "line" if trim else ""
        elif tag[1] != "#":
            out.append(("{" + tag[1], body))
    text(src[at:], strip, "")
    return out


def parse(src: str, trim: bool = False) -> list[tuple]:
    """Syntax tree of a template."""
    try:
        return _parse(_parts(src, trim))
    except RecursionError:
        raise TemplateError("nested too deep") from None


def _parse(parts: list[tuple[str, str]]) -> list[tuple]:
    pos = 0

    def block(ends: tuple[str, ...], loops: int) -> tuple[list[tuple], str]:
        nonlocal pos
        out: list[tuple] = []
        while pos < len(parts):
            kind, body = parts[pos]
            pos += 1
            if kind == "text":
                if body:
                    out.append(("text", body))
                continue
            p = _Parser(body)
            if kind == "{{":
                e = p.expr()
                p.end()
                out.append(("out", e))
                continue
            word = p.name()
            if word in ends:
                return out, body
            if word == "if":
                branches = []
                cond = p.expr()
                p.end()
                while True:
                    inner, end = block(("elif", "else", "endif"), loops)
                    branches.append((cond, inner))
                    q = _Parser(end)
                    closing = q.name()
                    if closing == "endif":
                        break
                    cond = q.expr() if closing == "elif" else ("const", True)
                    q.end()
                out.append(("if", branches))
            elif word == "for":
                names = [p.name()]
                while p.has(","):
                    names.append(p.name())
                p.take("in")
                seq = p.either()  # a condition here is the loop's own, never the expression's
                test = p.either() if p.has("if") else None
                p.end()
                inner, end = block(("else", "endfor"), loops + 1)
                other = block(("endfor",), loops)[0] if end.split()[0] == "else" else []
                out.append(("for", names, seq, test, inner, other))
            elif word in ("break", "continue"):
                p.end()
                out.append((word,) if loops else _no(f"{word} outside a loop"))
            elif word == "set":
                target = [p.name()]
                if p.has("."):
                    target.append(p.name())
                if p.has("="):
                    e = p.expr()
                    p.end()
                    out.append(("set", target, e))
                else:
                    p.end()
                    out.append(("capture", target, block(("endset",), loops)[0]))
            elif word == "macro":
                name, params = p.name(), []
                p.take("(")
                while not p.has(")"):
                    n = p.name()
                    params.append((n, p.expr() if p.has("=") else None))
                    if not p.peek(")"):
                        p.take(",")
                p.end()
                out.append(("macro", name, params, block(("endmacro",), 0)[0]))
            elif word == "generation":
                p.end()
                out.append(("generation", block(("endgeneration",), loops)[0]))
            else:
                raise TemplateError(f"unknown tag {word!r}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return out, ""

    return block((), 0)[0]


def simplify(nodes: list[tuple]) -> list[tuple]:
    """Constants folded: printed constants become text, neighbouring texts one, branches that can't be taken none."""
    out: list[tuple] = []

    def add(n: tuple) -> None:
        if n[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + n[1])
        else:
            out.append(n)

    for n in nodes:
        if n[0] == "out":
            e = fold(n[1])
            add(("text", _text(e[1])) if e[0] == "const" else ("out", e))
        elif n[0] == "if":
            left = []
            for c, body in n[1]:
                c = fold(c)
                if c[0] == "const" and not c[1]:
                    continue
                left.append((c, simplify(body)))
                if c[0] == "const":
                    break
            if left and left[0][0][0] == "const":
                for x in left[0][1]:
                    add(x)
            elif left:
                add(("if", left))
        elif n[0] == "for":
            add(("for", n[1], fold(n[2]), n[3] and fold(n[3]), simplify(n[4]), simplify(n[5])))
        elif n[0] == "set":
            add(("set", n[1], fold(n[2])))
        elif n[0] == "capture":
            add(("capture", n[1], simplify(n[2])))
        elif n[0] == "macro":
            add(("macro", n[1], [(a, d and fold(d)) for a, d in n[2]], simplify(n[3])))
        elif n[0] == "generation":
            add(("generation", simplify(n[1])))
        elif n[0] != "text" or n[1]:
            add(n)
    return out


class _Out:
    __slots__ = ("n", "parts", "spans")

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.n, self.spans = 0, []

    def put(self, s: str) -> None:
        self.parts.append(s)
        self.n += len(s)
        if self.n > MOST_TEXT:
            raise TemplateError("text too long")


_BREAK, _CONTINUE = "break", "continue"
_Step = Callable[[dict, _Out], str | None]


def _body(nodes: list[tuple]) -> _Step:
    """Runs the nodes; gives the ``break`` or ``continue`` that ended them."""
    steps = [_step(n) for n in nodes]

    def run(env: dict, out: _Out) -> str | None:
        for s in steps:
            if (ended := s(env, out)) is not None:
                return ended
        return None

    return steps[0] if len(steps) == 1 else run


def _assign(env: dict, target: list[str], v: Any) -> None:
    if len(target) == 1:
        env[target[0]] = v
    elif isinstance(ns := env.get(target[0]), Namespace):
        ns.values[target[1]] = v
    else:
        raise TemplateError(f"{target[0]} is no namespace")


def _step(n: tuple) -> _Step:
    kind = n[0]
    if kind == "text":
        s = n[1]
        return lambda env, out: out.put(s)
    if kind == "out":
        f = _closure(n[1])
        return lambda env, out: out.put(_text(f(env)))
    if kind in (_BREAK, _CONTINUE):
        return lambda env, out: kind
    if kind == "set":
        target, f = n[1], _closure(n[2])
        return lambda env, out: _assign(env, target, f(env))
    if kind == "capture":
        target, inner = n[1], _body(n[2])

        def capture(env: dict, out: _Out) -> str | None:
            own = _Out()
            ended = inner(env, own)
            _assign(env, target, "".join(own.parts))
            return ended

        return capture
    if kind == "macro":
        name, params, inner = n[1], [(a, d and _closure(d)) for a, d in n[2]], _body(n[3])
        names = [a for a, _ in params]

        def define(env: dict, out: _Out) -> None:
            def macro(*args: Any, **named: Any) -> str:
                if len(args) > len(names) or not set(named) <= set(names):
                    raise TemplateError(f"arguments of {name}")
                _count(env)
                given = dict(zip(names, args)) | named
                scope, own = dict(env), _Out()
                for a, d in params:
                    scope[a] = given[a] if a in given else d(scope) if d else UNDEFINED
                inner(scope, own)
                return "".join(own.parts)

            env[_MACRO + name] = macro

        return define
    if kind == "if":
        branches = [(_closure(c), _body(b)) for c, b in n[1]]

        def choose(env: dict, out: _Out) -> str | None:
            for c, b in branches:
                if c(env):
                    return b(env, out)
            return None

        return choose
    if kind == "generation":
        inner = _body(n[1])

        def mark(env: dict, out: _Out) -> str | None:
            begin = out.n
            ended = inner(env, out)
            out.spans.append((begin, out.n))
            return ended

        return mark
    names, seq, test, body, other = n[1], _closure(n[2]), n[3] and _closure(n[3]), _body(n[4]), _body(n[5])

    def bind(env: dict, x: Any) -> dict:
        inner = dict(env)
        if len(names) == 1:
            inner[names[0]] = x
        elif isinstance(x, (list, tuple)) and len(x) == len(names):
            inner.update(zip(names, x))
        else:
            raise TemplateError(f"can't unpack to {', '.join(names)}")
        return inner

    def loop(env: dict, out: _Out) -> str | None:
        items = _list(seq(env))
        if test:
            items = [x for x in items if test(bind(env, x))]
        if not items:
            return other(env, out)
        last = len(items) - 1
        for i, x in enumerate(items):
            _count(env)
            inner = bind(env, x)
            inner["loop"] = {
                "index0": i, "index": i + 1, "revindex": last - i + 1, "revindex0": last - i, "first": i == 0, "last": i == last, "length": last + 1,
                "previtem": items[i - 1] if i else UNDEFINED, "nextitem": items[i + 1] if i < last else UNDEFINED,
            }
            if body(inner, out) == _BREAK:
                break
        return None

    return loop


def compile_template(src: str, trim: bool = False) -> Callable[..., tuple[str, list[tuple[int, int]]]]:
    """A function of the template's variables that gives the text and the character spans of its generation blocks. Whatever goes
    wrong in a template, it raises ``TemplateError``."""
    body = _body(simplify(parse(src, trim)))

    def render(**env: Any) -> tuple[str, list[tuple[int, int]]]:
        out = _Out()
        try:
            body(env | {_STEPS: [0]}, out)
        except TemplateError:
            raise
        except _FAILS as e:
            raise TemplateError(f"{type(e).__name__}: {e}") from None
        return "".join(out.parts), out.spans

    return render


CHAT = (
    "{{ '<s>' }}{%- for m in messages -%}{{ '<|' + m.role + '|>\\n' }}"
    "{%- if m.role == 'assistant' -%}{%- generation -%}{{ m.content }}{{ '<|end|>\\n' }}{%- endgeneration -%}"
    "{%- else -%}{{ m.content }}{{ '<|end|>\\n' }}{%- endif -%}{%- endfor -%}{%- if add_generation_prompt -%}{{ '<|assistant|>\\n' }}{%- endif -%}"
)

SCHEMA = "conv_id bigint, n_messages int, text string, generated string, error string"


def format_conversations(turns: DataFrame, template: str = CHAT, add_generation_prompt: bool = False, trim: bool = False) -> DataFrame:
    """One row a conversation: conv_id, n_messages, text, generated (spans ``begin-end`` in characters, with commas), error.

    Messages go in order of turn, then role, then text (ties; nulls first); repeated rows are repeated messages. A null role
    is ``user``, a null text is empty, a null conv_id is one conversation of its own. A conversation that the template refuses
    (``raise_exception``), or fails on, has null text and spans and says why in ``error``. Texts of any length are rendered, up
    to ``MOST_TEXT`` characters a conversation; beyond, that is an error. An empty table gives none. Only conv_id, turn, role and
    text are read, whatever else the table has. One conversation becomes one text, so it is put together in one task.
    """
    compile_template(template, trim)  # an error here rather than in a task
    message = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role"), F.col("text"))
    grouped = turns.select("conv_id", "turn", "role", "text").groupBy("conv_id").agg(F.sort_array(F.collect_list(message)).alias("messages"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, trim)
        for batch in batches:
            counts, texts, spans, errors = [], [], [], []
            for ms in batch.column(1).to_pylist():
                messages = [{"role": m["role"] or "user", "content": m["text"] or ""} for m in ms]
                try:
                    t, s = render(messages=messages, add_generation_prompt=add_generation_prompt)
                    marked, error = ",".join(f"{a}-{b}" for a, b in s), None
                except TemplateError as e:
                    t, marked, error = None, None, str(e)
                counts.append(len(messages))
                texts.append(t)
                spans.append(marked)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(counts, pa.int32()), *(pa.array(c, pa.string()) for c in (texts, spans, errors))], ["conv_id", "n_messages", "text", "generated", "error"])

    return grouped.mapInArrow(run, SCHEMA)


ORACLE = r"""
WITH m AS (
  SELECT conv_id, turn, coalesce(nullif(role, ''), 'user') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i FROM conversations),
p AS (SELECT *, '<|' || role || '|>' || chr(10) AS head, text || '<|end|>' || chr(10) AS body FROM m),
q AS (SELECT *, 3 + sum(length(head) + length(body)) OVER (PARTITION BY conv_id ORDER BY i) AS stop FROM p)
SELECT conv_id, count(*)::INT AS n_messages, '<s>' || string_agg(head || body, '' ORDER BY i) AS text,
       coalesce(string_agg(CASE WHEN role = 'assistant' THEN (stop - length(body))::BIGINT::VARCHAR || '-' || stop::BIGINT::VARCHAR END, ',' ORDER BY i), '') AS generated, NULL::VARCHAR AS error
FROM q GROUP BY conv_id
"""
