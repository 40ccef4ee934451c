"""Causes: traces, effects, pattern matches over links, cycles, degrees. Frontiers grow by joins, a round a step."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.fields import subject_filter
from tidemark.model import Facts
from tidemark.session import cut, drop, unsized

TRACE = "depth int, position int, event_id string"
LISTED = 5_000
ON_DRIVER = 200_000


def neighbourhood(links: DataFrame, origin: str, depth: int, forward: bool) -> list[tuple[str, str]]:
    """(node, next) of all links within ``depth`` steps of one event, in append order. A round is one filtered scan; the ids that it
    filters by reach the scan while they are few, and meet it in a join beyond ``LISTED``."""
    here, there = ("from_id", "to_id") if forward else ("to_id", "from_id")
    frontier, seen, rows = [origin], {origin}, []
    for _ in range(depth):
        if len(frontier) <= LISTED:
            step = links.where(F.col(here).isin(frontier))
        else:
            ids = links.sparkSession.createDataFrame([(x,) for x in frontier], "_id string")
            step = links.join(ids, links[here] == ids["_id"], "left_semi")
        got = [tuple(r) for r in step.select(here, there, "log_seq").toLocalIterator()]
        rows += got
        frontier = list(dict.fromkeys(b for _, b, _ in got if b not in seen))
        seen.update(frontier)
        if not frontier:
            break
    return [(a, b) for _, a, b in sorted({(n, a, b) for a, b, n in rows})]


def walk(edges: Iterable[tuple[str, str]], origin: str, depth: int) -> list[tuple[str, int]]:
    """Depth-first order from ``origin``, each node when first met; a node met deep down isn't opened again from nearer."""
    out: dict[str, list[str]] = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    order, seen = [(origin, 0)], {origin}
    stack = [iter(out.get(origin, []))] if depth > 0 else []
    while stack:
        node = next(stack[-1], None)
        if node is None:
            stack.pop()
        elif node not in seen:
            seen.add(node)
            order.append((node, len(stack)))
            stack.append(iter(out.get(node, []) if len(stack) < depth else []))
    return order


def trace(base: Facts, event_id: str, depth: int = 6, effects: bool = False) -> DataFrame:
    """The event and what caused it (or what it caused), in depth-first order: position, depth, then the event's columns.

    The links around one event are few and are walked on the driver; nodes that are no events are walked through."""
    spark = base.spark
    order = walk(neighbourhood(base.links, event_id, depth, effects), event_id, depth)
    found = spark.createDataFrame([(d, i, e) for i, (e, d) in enumerate(order)], TRACE)
    return base.facts.join(F.broadcast(found), "event_id").orderBy("position").select("position", "depth", *base.facts.columns)  # one event's neighbourhood


def chains(base: Facts, view: DataFrame, depth: int = 3) -> DataFrame:
    """``view`` with ``causes`` and ``effects``: ids met within ``depth`` steps, nearest first, by the fewest steps."""
    depth = depth or 3
    out = view
    for name, forward in (("causes", False), ("effects", True)):
        reached = reach(base.links, view.select(F.col("event_id").alias("seed")), depth, forward)
        events = reached.join(base.facts.select("event_id"), reached["node"] == F.col("event_id"), "left_semi")
        lists = events.groupBy("seed").agg(F.transform(F.array_sort(F.collect_list(F.struct("hops", "node"))), lambda x: x["node"]).alias(name))
        out = out.join(lists, out["event_id"] == lists["seed"], "left").drop("seed")
        out = out.withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out


def reach(links: DataFrame, seeds: DataFrame, depth: int, forward: bool = True, via: str = "") -> DataFrame:
    """(seed, node, hops, via): every node within ``depth`` links of each seed, the seed itself not, with the fewest hops and the
    type of the last link (the least among equals)."""
    here, there = ("from_id", "to_id") if forward else ("to_id", "from_id")
    edges = links.where(F.col("type") == via) if via and via != "*" else links
    edges = edges.select(F.col(here).alias("_a"), F.col(there).alias("_b"), F.col("type").alias("_t"))
    frontier = seeds.select("seed", F.col("seed").alias("node")).distinct()
    seen = frontier
    found = None
    for hop in range(1, depth + 1):
        step = frontier.join(edges, frontier["node"] == edges["_a"]).groupBy("seed", F.col("_b").alias("node")).agg(F.min("_t").alias("via"))
        step = cut(step.join(seen, ["seed", "node"], "left_anti").withColumn("hops", F.lit(hop)))
        found = step if found is None else found.unionByName(step)
        frontier = step.select("seed", "node")
        if hop < depth:
            if frontier.isEmpty():
                break
            seen = seen.unionByName(frontier)
    return found.select("seed", "node", "hops", "via") if found is not None else seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hops"), F.lit("").alias("via")).limit(0)


def match(base: Facts, pattern: str, to: str, direction: str = "causes", via: str = "", depth: int = 3, limit: int = 0) -> DataFrame:
    """Pairs (from_event, from_subject, to_event, to_subject, hops, via): any event of the first pattern's subjects and what it
    leads to (or stems from) among the second's."""
    events = base.facts.select("event_id", "subject")
    a, b = subject_filter(pattern), subject_filter(to)
    start = events.where(a) if a is not None else events
    ends = events.where(b) if b is not None else events
    found = reach(base.links, start.select(F.col("event_id").alias("seed")), depth or 3, direction == "causes", via)
    out = (
        found.join(start.select(F.col("event_id").alias("seed"), F.col("subject").alias("from_subject")), "seed")
        .join(ends.select(F.col("event_id").alias("node"), F.col("subject").alias("to_subject")), "node")
        .select(F.col("seed").alias("from_event"), "from_subject", F.col("node").alias("to_event"), "to_subject", "hops", "via")
        .orderBy("from_subject", "to_subject", "hops", "from_event", "to_event")
    )
    return out.limit(limit) if limit else out


def shrunk(links: DataFrame, most: int) -> DataFrame:
    """(from_id, to_id, path): links shrunk until there are ``most`` at most, or no more can be done, with all cycles kept. A round is
    one shuffle of each link to both its ends. Nodes have a random order; a link is dealt with by its earlier end, which drops it
    if it lacks an inbound or an outbound link itself. A node with one of each that comes before both its neighbours makes them
    one link, with itself on the path. Every second round has the order of the one before turned round, so that no link stays
    with one end for long and two rounds take away about two thirds of a chain. A loop at one node is a cycle; then that alone is
    left."""
    edges = cut(links.select("from_id", "to_id").distinct().withColumn("path", F.array().cast("array<string>")))
    n, turn, idle = edges.count(), 0, 0
    while n > most and idle < 4:
        loop = edges.where("from_id = to_id").limit(1)
        if not loop.isEmpty():
            return loop
        a, b = (F.struct(F.xxhash64(c, F.lit(turn // 2)), F.col(c)) for c in ("from_id", "to_id"))
        first = a < b if turn % 2 == 0 else a > b  # whether the link is dealt with by the end it leaves
        out = F.struct(F.col("from_id").alias("node"), F.col("to_id").alias("other"), F.lit(True).alias("out"), first.alias("own"), F.when(first, F.col("path")).alias("path"))
        into = F.struct(F.col("to_id").alias("node"), F.col("from_id").alias("other"), F.lit(False).alias("out"), (~first).alias("own"), F.when(~first, F.col("path")).alias("path"))
        ends = edges.select(F.inline(F.array(out, into))).withColumn("_k", F.xxhash64("node"))
        at = Window.partitionBy("_k", "node")
        ends = ends.withColumn("_last", F.lag(F.struct("out", "other")).over(at.orderBy("out", "other", "path")))
        ends = ends.where("_last is null or _last != struct(out, other)")  # of links side by side the one with the least path stays
        whole = {"_own": F.min("own")}
        for name, side in (("_i", ~F.col("out")), ("_o", F.col("out"))):
            whole |= {name: F.min(F.when(side, F.col("other"))), name + "z": F.max(F.when(side, F.col("other"))), name + "p": F.min(F.when(side, F.col("path")))}
        ends = ends.withColumns({k: v.over(at) for k, v in whole.items()}).where("own and _i is not null and _o is not null")
        ends = ends.withColumn("_one", F.expr("_own and _i = _iz and _o = _oz")).where("not (_one and out)")
        new = {"from_id": F.when(F.col("_one"), F.col("_i")).when(F.col("out"), F.col("node")).otherwise(F.col("other"))}
        new |= {"to_id": F.when(F.col("_one"), F.col("_o")).when(F.col("out"), F.col("other")).otherwise(F.col("node"))}
        new |= {"path": F.when(F.col("_one"), F.concat("_ip", F.array("node"), "_op")).otherwise(F.col("path"))}
        old = edges
        edges = unsized(cut(ends.select(*[v.alias(k) for k, v in new.items()])))
        drop(old)
        before, n = n, edges.count()
        turn, idle = turn + 1, idle + 1 if n == before else 0
    return edges


def cycles(base: Facts, subject: str = "", exclude_types: tuple[str, ...] = ()) -> dict[str, object]:
    """{cyclic, cycle}: a cycle of links, met depth-first from sorted roots. Up to ``ON_DRIVER`` links are walked on the driver; more
    are shrunk on the cluster first."""
    links = base.links.where(~F.col("type").isin(list(exclude_types))) if exclude_types else base.links
    if subject:
        own = base.facts.where(F.col("subject") == subject).select(F.col("event_id").alias("_e"))
        out, into = (links.join(own, links[c] == own["_e"], "left_semi") for c in ("from_id", "to_id"))
        links = out.unionByName(into).distinct()
    small = shrunk(links, ON_DRIVER)
    edges: dict[str, list[str]] = {}
    for a, b in small.select("from_id", "to_id").toLocalIterator():
        edges.setdefault(a, []).append(b)
    state: dict[str, int] = {}
    for root in sorted(edges):
        if root in state:
            continue
        path, stack = [root], [iter(sorted(edges[root]))]
        state[root] = 1
        while stack:
            node = next(stack[-1], None)
            if node is None:
                state[path.pop()] = 2
                stack.pop()
            elif state.get(node) == 1:
                ring = [*path[path.index(node) :], node]
                steps = small.sparkSession.createDataFrame(list(zip(ring, ring[1:])), "from_id string, to_id string")
                paths: dict[tuple[str, str], list[str]] = {}  # the ring's own; others stay on the cluster
                for a, b, between in small.where(F.size("path") > 0).join(steps, ["from_id", "to_id"], "left_semi").toLocalIterator():
                    paths[a, b] = min(between, paths.get((a, b), between))
                whole = [ring[0]]
                for a, b in zip(ring, ring[1:]):
                    whole += [*paths.get((a, b), []), b]
                return {"cyclic": True, "cycle": whole}
            elif node not in state:
                state[node] = 1
                path.append(node)
                stack.append(iter(sorted(edges.get(node, []))))
    return {"cyclic": False, "cycle": []}


def degree(links: DataFrame) -> DataFrame:
    """(event_id, degree): links in and out of each event."""
    ends = links.select(F.explode(F.array("from_id", "to_id")).alias("event_id"))
    return ends.groupBy("event_id").agg(F.count(F.lit(1)).alias("degree"))
