"""FACTS and HISTORY: choose the view, filter, then aggregate, or order, page and project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.fields import resolve, subject_filter
from tidemark.functions.predicates import predicate
from tidemark.operators import temporal
from tidemark.plans.ast import Having, Item, Query, QueryError
from tidemark.session import cut


RSD = 0.0081  # of approximate counts


def names_of(q: Query) -> set[str]:
    """All field names a statement reads, in lower case."""
    out = {i.name.lower() for i in q.items} | {q.group_by.lower(), q.order_by.lower()} | {h.name.lower() for h in q.having}
    work = [q.where] if q.where else []
    while work:
        e = work.pop()
        out.add(e.name.lower())
        work += e.kids
    return out


def gather(facts: DataFrame, q: Query) -> DataFrame:
    """The facts a statement is about. Tests on subject and facet go below the choice of version, where Spark pushes them to
    the scan; tests on the payload stay above it."""
    used = names_of(q)
    if "pending" in used:
        facts = temporal.activated(facts)
    subject = subject_filter(q.subject)
    facts = facts.where(subject) if subject is not None else facts
    if q.facet:
        facts = facts.where(F.col("facet") == q.facet)
    if "superseded" in used:
        facts = temporal.superseded(facts)
    if q.kind == "history":
        view = facts
    elif q.as_of or q.known_at:
        view = temporal.as_of(facts, q.as_of, q.known_at)
    else:
        view = temporal.current(facts)
    return view.where(predicate(view, q.where)) if q.where else view


def order(q: Query, df: DataFrame) -> list[Column]:
    """A total order: the key, then subject and facet (for HISTORY subject and time), then append order."""
    base = [F.col("subject"), F.col("effective_time") if q.kind == "history" else F.col("facet"), F.col("log_seq")]
    if not q.order_by:
        return base
    f = resolve(df, q.order_by)
    if f.kind == "any":  # mixed values: missing first, then numbers by size, all others by how they print
        keys = [f.exists, f.is_number.cast("int") * -1, f.number, f.text]
    else:
        keys = [f.column]
    return [*[k.desc_nulls_last() if q.desc else k.asc_nulls_first() for k in keys], *base]


def _rank(df: DataFrame, keys: list[Column]) -> DataFrame:
    """``_rank`` from 1 in a total order of the whole table: sorted in ranges, each range's start is the sum of those before."""
    ordered = cut(df.orderBy(*keys).withColumns({"_part": F.spark_partition_id(), "_i": F.monotonically_increasing_id()}))
    sizes = sorted(map(tuple, ordered.groupBy("_part").agg(F.count(F.lit(1)), F.min("_i")).collect()))  # a row a partition
    starts, n = [], 0
    for part, size, first in sizes:
        starts.append((part, n - first + 1))
        n += size
    table = df.sparkSession.createDataFrame(starts, "_part int, _start bigint")
    return ordered.join(F.broadcast(table), "_part").withColumn("_rank", F.col("_i") + F.col("_start")).drop("_part", "_i", "_start")  # a row a partition


def read(facts: DataFrame, q: Query, strict_sql: bool = False) -> DataFrame:
    """The statement's rows, ordered. Aggregates take no ORDER BY, LIMIT and OFFSET unless ``strict_sql``."""
    view = gather(facts, q)
    if any(i.agg for i in q.items):
        out = aggregate(view, q)
        if strict_sql:
            if q.order_by and q.order_by in out.columns:
                c = F.col(f"`{q.order_by}`")
                out = out.orderBy(c.desc_nulls_last() if q.desc else c.asc_nulls_first())
            out = out.offset(q.offset) if q.offset else out
            out = out.limit(q.limit) if q.limit else out
        return out
    keys = order(q, view)
    star = not q.items or [i.name for i in q.items] == ["*"]
    ranked = not star and any(i.name.lower() == "rank" for i in q.items)
    if not star:  # only what is asked for, and what orders it, is carried through the sort
        cols = {f"_c{n}": resolve(view, i.name).shown for n, i in enumerate(q.items) if i.name.lower() != "rank"}
        view = view.select(*[c.alias(a) for a, c in cols.items()], *[_key(k, n) for n, k in enumerate(_bare(q, view))])
        keys = [F.col(f"_k{n}").desc_nulls_last() if q.order_by and q.desc and n < len(keys) - 3 else F.col(f"_k{n}").asc_nulls_first() for n in range(len(keys))]
    if ranked:
        if q.limit:  # few rows: the top ones alone are numbered
            view = view.orderBy(*keys).limit(q.offset + q.limit)
        view = _rank(view, keys)
        view = view.where(F.col("_rank") > q.offset) if q.offset else view
        view = view.orderBy("_rank")
        view = view.limit(q.limit) if q.limit else view
    else:
        view = view.orderBy(*keys)
        view = view.offset(q.offset) if q.offset else view
        view = view.limit(q.limit) if q.limit else view
    if star:
        return view
    return view.select(*[(F.col("_rank") if i.name.lower() == "rank" else F.col(f"_c{n}")).alias(i.name) for n, i in enumerate(q.items)])


def _bare(q: Query, df: DataFrame) -> list[Column]:
    base = [F.col("subject"), F.col("effective_time") if q.kind == "history" else F.col("facet"), F.col("log_seq")]
    if not q.order_by:
        return base
    f = resolve(df, q.order_by)
    return [*([f.exists, f.is_number.cast("int") * -1, f.number, f.text] if f.kind == "any" else [f.column]), *base]


def _key(c: Column, n: int) -> Column:
    return c.alias(f"_k{n}")


def agg_column(df: DataFrame, agg: str, name: str) -> Column:
    """One aggregate. Numbers are numbers and booleans; others are passed over; without any the result is null."""
    if agg == "count" and name == "*":
        return F.count(F.lit(1))
    if agg == "count_distinct" and name == "*":
        return F.count_distinct("subject")
    f = resolve(df, name)
    if agg == "count":
        return F.count(F.when(f.exists, 1))
    if agg == "count_distinct":
        return F.count_distinct(f.text)
    if agg == "approx_count_distinct":
        return F.approx_count_distinct(F.col("subject") if name == "*" else f.text, RSD)
    if agg == "listagg":
        return F.array_join(F.array_sort(F.collect_set(f.text)), ", ")
    return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "median": F.median, "stddev": F.stddev_pop}[agg](f.number)


def _beside_distinct(view: DataFrame, aggs: list[Item | Having]) -> tuple[DataFrame, dict[tuple[str, str], Column]]:
    """Exact and approximate counts of distinct values that stand beside each other, by kind and name, and the view with their columns.
    Spark groups by the exact count's values and keeps each other aggregate's buffer, here of 26 KB, with every one of them; so
    approximate counts are over distinct values, too, which gives the same number with one buffer a task."""
    if not {"count_distinct", "approx_count_distinct"} <= {a.agg for a in aggs}:
        return view, {}
    names = list(dict.fromkeys(a.name for a in aggs if a.agg.endswith("count_distinct")))
    view = view.withColumns({f"_distinct{n}": F.col("subject") if x == "*" else resolve(view, x).text for n, x in enumerate(names)})
    exact = {("count_distinct", x): F.count_distinct(f"_distinct{n}") for n, x in enumerate(names)}
    return view, exact | {("approx_count_distinct", x): F.expr(f"approx_count_distinct(DISTINCT _distinct{n}, {RSD})") for n, x in enumerate(names)}


def aggregate(view: DataFrame, q: Query) -> DataFrame:
    """Groups by one key's printed form (``<nil>`` where it is missing), sorted by it. No rows, no groups, not even without a key."""
    for i in q.items:
        if not i.agg and i.name != q.group_by:
            raise QueryError(f"{i.name!r} must be aggregated or be the GROUP BY key")
    items = [i for i in q.items if i.agg]
    view, beside = _beside_distinct(view, [*items, *q.having])
    cols = [beside.get((i.agg, i.name), agg_column(view, i.agg, i.name)).alias(i.label) for i in items]
    tests = [beside.get((h.agg, h.name), agg_column(view, h.agg, h.name)).alias(f"_h{n}") for n, h in enumerate(q.having)]
    if q.group_by:
        key = F.coalesce(resolve(view, q.group_by).text, F.lit("<nil>")).alias("_key")
        out = view.groupBy(key).agg(*cols, *tests)
    else:
        out = view.agg(*cols, *tests, F.count(F.lit(1)).alias("_n")).where("_n > 0")
    for n, h in enumerate(q.having):
        out = out.where(_holds(F.col(f"_h{n}"), h))
    if q.group_by:
        out = out.orderBy("_key")
    keep = [F.col(f"`{i.label}`") for i in items]
    return out.select(*([F.col("_key").alias(q.group_by)] if q.group_by else []), *keep)


def _holds(c: Column, h: Having) -> Column:
    return {"=": c == h.value, "!=": c != h.value, ">": c > h.value, ">=": c >= h.value, "<": c < h.value, "<=": c <= h.value}[h.op]


def items(*names: str) -> list[Item]:
    """``count(x)`` and plain names to projected items."""
    out = []
    for n in names:
        agg, _, rest = n.partition("(")
        out.append(Item(rest[:-1], agg.lower()) if rest.endswith(")") else Item(n))
    return out


def is_variant(df: DataFrame) -> bool:
    return isinstance(df.schema["value"].dataType, T.VariantType)
