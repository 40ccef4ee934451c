"""Agreement, drift and shape of numbers."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.fields import resolve
from tidemark.model import Facts
from tidemark.operators import vector
from tidemark.operators.read import _rank
from tidemark.plans.ast import QueryError

MOST_POINTS, NEIGHBOURS, MOST_SIMPLICES, SHOWN = 80, 24, 60_000, 12


def consistency(view: DataFrame, name: str, eps: float = 0.0) -> DataFrame:
    """One row a subject: components, score, consistent, outlier. Facets whose values lie within ``eps`` of each other, directly
    or through others, are one component (in one dimension: a gap over ``eps`` parts them). score is the sum of squared
    differences of all pairs; the outlier of an inconsistent subject is the facet farthest from the rest (first by name)."""
    rows = view.select("subject", "facet", resolve(view, name).number.alias("x")).where("x is not null")
    by = Window.partitionBy("subject")
    line = by.orderBy("x", "facet")
    rows = rows.withColumns({"gap": F.coalesce((F.col("x") - F.lag("x").over(line) > eps).cast("int"), F.lit(0)), "m": F.avg("x").over(by)})
    off = F.round(F.abs(F.col("x") - F.col("m")), 9)
    out = rows.groupBy("subject").agg(
        (F.sum("gap") + 1).cast("int").alias("components"),
        (F.count(F.lit(1)) * F.sum((F.col("x") - F.col("m")) * (F.col("x") - F.col("m")))).alias("score"),
        F.min(F.struct((-off).alias("d"), "facet")).alias("worst"),
    )
    return out.select("subject", "components", "score", (F.col("components") == 1).alias("consistent"), F.when(F.col("components") > 1, F.col("worst.facet")).alias("outlier")).orderBy("subject")


def drift(view: DataFrame, name: str, buckets: int = 4) -> DataFrame:
    """(bucket, drift, points): events in order of recorded time are cut into buckets of equal count (the last takes the rest);
    drift is the greatest distance of sorted values, place by place, to the next bucket; a shorter bucket repeats its greatest.

    Two distributed sorts give every value its place; the compared buckets meet by place. No bucket is gathered anywhere."""
    buckets = buckets if buckets > 1 else 4
    rows = view.select("recorded_time", "log_seq", "event_id", resolve(view, name).number.alias("x")).where("x is not null")
    placed = _rank(rows, [F.col("recorded_time"), F.col("log_seq"), F.col("event_id")])
    n = placed.count()
    if n < buckets + 1:
        raise QueryError(f"DRIFT needs more than {buckets} points, got {n}")
    per = n // buckets
    bucket = F.least(F.floor((F.col("_rank") - 1) / per), F.lit(buckets - 1)).cast("int")
    inside = _rank(placed.select(bucket.alias("bucket"), "x"), [F.col("bucket"), F.col("x")]).select("bucket", "x", (F.col("_rank") - F.col("bucket") * per).alias("place"))
    top = inside.groupBy("bucket").agg(F.max("x").alias("top"))
    a = inside.where(F.col("bucket") < buckets - 1)
    b = inside.where("bucket > 0").select((F.col("bucket") - 1).alias("bucket"), F.col("x").alias("y"), "place")
    both = a.join(b, ["bucket", "place"], "full_outer")
    ta, tb = top.select("bucket", F.col("top").alias("ta")), top.select((F.col("bucket") - 1).alias("bucket"), F.col("top").alias("tb"))
    both = both.join(F.broadcast(ta), "bucket").join(F.broadcast(tb), "bucket")  # a row a bucket
    gap = F.abs(F.coalesce("x", "ta") - F.coalesce("y", "tb"))
    return both.groupBy("bucket").agg(F.max(gap).alias("drift")).select("bucket", "drift", F.lit(n).alias("points")).orderBy("bucket")


# ---- persistent homology of a small cloud ----
def euclidean(p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((p[:, None] - p[None]) ** 2).sum(-1), 0))


def cosine(p: np.ndarray) -> np.ndarray:
    """1 - cosine; 1 where a vector has no length."""
    n = np.linalg.norm(p, axis=1)
    safe = np.where(n > 0, n, 1)
    c = (p / safe[:, None]) @ (p / safe[:, None]).T
    return np.where((n[:, None] > 0) & (n[None] > 0), 1 - np.clip(c, -1, 1), 1.0) * (1 - np.eye(len(p)))


METRICS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"euclidean": euclidean, "cosine": cosine}


def zscore(p: np.ndarray) -> np.ndarray:
    s = p.std(0)
    return (p - p.mean(0)) / np.where(s > 0, s, 1)


def connectivity(d: np.ndarray) -> float:
    """The longest edge of a minimum spanning tree."""
    n = len(d)
    far, inside, longest = d[0].copy(), np.zeros(n, bool), 0.0
    inside[0] = True
    for _ in range(n - 1):
        i = int(np.argmin(np.where(inside, np.inf, far)))
        longest = max(longest, float(far[i]))
        inside[i] = True
        far = np.minimum(far, d[i])
    return longest


def _distinct(p: np.ndarray) -> np.ndarray:
    tol = 1e-9 * (1 + float(np.abs(p).max(initial=0)))
    keep: list[int] = []
    for i in range(len(p)):
        if not keep or np.sqrt(((p[keep] - p[i]) ** 2).sum(1)).min() > tol:
            keep.append(i)
    return p[keep]


def homology(points: np.ndarray, scale: float, maxdim: int = 1, metric: str = "euclidean") -> tuple[list[int], list[tuple[int, float, float]]]:
    """(Betti numbers, (dimension, birth, death) longest first) of a sparse Rips complex: each point keeps its 24 nearest
    neighbours within ``scale``. Boundary columns are sets reduced over Z/2; death is infinite for what lasts."""
    p = _distinct(points)
    n = len(p)
    if not n:
        return [0] * (maxdim + 1), []
    d = METRICS[metric](p)
    near: list[set[int]] = [set() for _ in range(n)]
    for i in range(n):
        for j in [int(j) for j in np.argsort(d[i], kind="stable") if j != i and d[i, j] <= scale][:NEIGHBOURS]:
            near[i].add(j)
            near[j].add(i)
    simplices: list[tuple[float, int, tuple[int, ...]]] = [(0.0, 0, (i,)) for i in range(n)]
    layer = [((i,), 0.0, {j for j in near[i] if j > i}) for i in range(n)]
    for dim in range(1, maxdim + 2):
        grown = []
        for s, birth, common in layer:
            for v in sorted(common):
                b = max(birth, float(max(d[v, u] for u in s)))
                grown.append(((*s, v), b, {w for w in common & near[v] if w > v}))
                simplices.append((b, dim, (*s, v)))
                if len(simplices) > MOST_SIMPLICES:
                    raise QueryError(f"SHAPE: over {MOST_SIMPLICES} simplices; use a smaller SCALE")
        layer = grown
    simplices.sort()
    index = {s: i for i, (_, _, s) in enumerate(simplices)}
    low: dict[int, set[int]] = {}
    paired: dict[int, int] = {}
    for j, (_, dim, s) in enumerate(simplices):
        column = {index[s[:k] + s[k + 1 :]] for k in range(dim + 1)} if dim else set()
        while column and (m := max(column)) in low:
            column ^= low[m]
        if column:
            m = max(column)
            low[m] = column
            paired[m] = j
    negative = set(paired.values())
    betti, pairs = [0] * (maxdim + 1), []
    for i, (birth, dim, _) in enumerate(simplices):
        if dim > maxdim or i in negative:
            continue
        if i in paired:
            death = simplices[paired[i]][0]
            if death > birth:
                pairs.append((dim, birth, death))
        else:
            betti[dim] += 1
            pairs.append((dim, birth, math.inf))
    pairs.sort(key=lambda x: (-(x[2] - x[1]), x))
    return betti, pairs


def time_delay(series: np.ndarray, window: int, stride: int = 1) -> np.ndarray:
    stride = max(1, stride)
    if window < 2 or len(series) < window:
        return np.zeros((0, max(window, 1)))
    return np.lib.stride_tricks.sliding_window_view(series, window)[::stride].copy()


def even_places(n: int, most: int = MOST_POINTS) -> list[int]:
    """Places of an even sample of at most ``most`` of ``n``."""
    return list(range(n)) if n <= most else [int(i * n / most) for i in range(most)]


def _sampled(rows: DataFrame, keys: list, cols: list[str], shift=None) -> np.ndarray:
    """At most ``MOST_POINTS`` rows, evenly through the order: the cluster ranks, the driver gets the sample alone."""
    ranked = _rank(rows, keys)
    n = ranked.count()
    places = [i + 1 for i in even_places(n)]
    got = ranked.where(F.col("_rank").isin(places)).orderBy("_rank").select(*cols).collect()
    return np.array([[float(x) for x in (r[0] if len(cols) == 1 and isinstance(r[0], list) else r)] for r in got])


def shape(base: Facts, view: DataFrame, names: list[str], *, embedding: bool = False, window: int = 0, stride: int = 1, metric: str = "", maxdim: int = 1, normalize: bool | None = None, scale: float = 0.0) -> dict[str, object]:
    """{betti, pairs, points, scale, metric, maxdim} of the cloud that ``view``'s facts make: of numeric fields, of vectors, or of a
    series' windows (``view`` is then the subject's history). The cloud is sampled evenly to 80 points."""
    maxdim = max(1, maxdim)
    if maxdim > 2:
        raise QueryError("SHAPE: MAXDIM is 1 or 2")
    metric = metric.lower() or ("cosine" if embedding else "euclidean")
    if metric not in METRICS:
        raise QueryError(f"SHAPE: no metric {metric!r}")
    order = [F.col("subject"), F.col("facet"), F.col("log_seq")]
    if embedding:
        v = vector.latest(base.enrichments).select(F.col("target_event").alias("_e"), "vector")
        rows = view.join(v, view["event_id"] == v["_e"]).where(F.size("vector") > 0).select("subject", "facet", "log_seq", "vector")
        finite = ~F.exists("vector", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
        points = _sampled(rows.where(finite), order, ["vector"])
    elif window:
        if len(names) != 1:
            raise QueryError("SHAPE: WINDOW needs one field")
        x = resolve(view, names[0]).number
        rows = view.select("subject", "facet", "log_seq", "effective_time", x.alias("x")).where("x is not null")
        w = Window.partitionBy("subject").orderBy("facet", "effective_time", "log_seq")
        lagged = rows.select("subject", "facet", "log_seq", "effective_time", *[F.lead("x", i).over(w).alias(f"x{i}") for i in range(window)], F.row_number().over(w).alias("n"))
        lagged = lagged.where(F.col(f"x{window - 1}").isNotNull() & ((F.col("n") - 1) % max(1, stride) == 0))
        points = _sampled(lagged, [F.col("subject"), F.col("n")], [f"x{i}" for i in range(window)])
    else:
        if not names:
            raise QueryError("SHAPE needs ON fields, ON EMBEDDING or ON a field with WINDOW")
        cols = {f"x{i}": resolve(view, f).number for i, f in enumerate(names)}
        rows = view.select("subject", "facet", "log_seq", *[c.alias(a) for a, c in cols.items()])
        for a in cols:
            rows = rows.where(F.col(a).isNotNull())
        if normalize if normalize is not None else len(names) > 1:  # by all points, not by the sample
            moments = rows.agg(*[f(a).alias(f"{p}{a}") for a in cols for p, f in (("m", F.avg), ("s", F.stddev_pop))])
            rows = rows.crossJoin(F.broadcast(moments))  # one row
            rows = rows.withColumns({a: (F.col(a) - F.col(f"m{a}")) / F.when(F.col(f"s{a}") > 0, F.col(f"s{a}")).otherwise(1.0) for a in cols})
        for a in cols:
            rows = rows.where(~F.isnan(a) & (F.abs(F.col(a)) != float("inf")))
        points = _sampled(rows.select("subject", "facet", "log_seq", *cols), order, list(cols))
    if len(points) < 3:
        raise QueryError(f"SHAPE needs at least 3 points, got {len(points)}")
    if scale <= 0:
        scale = connectivity(METRICS[metric](points)) * 2.2 or 1.0
    betti, pairs = homology(points, scale, maxdim, metric)
    return {"betti": betti, "pairs": pairs[:SHOWN], "points": len(points), "scale": scale, "metric": metric, "maxdim": maxdim}
