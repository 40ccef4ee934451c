"""One object to ask: statements as text, as trees or by method. Tables come back as DataFrames, not computed until used."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import assist, procedures
from tidemark.functions.fields import resolve, subject_filter
from tidemark.model import Facts
from tidemark.operators import context, graph, profile, read, retention, search, temporal, topology, txn, vector
from tidemark.plans.ast import Query, QueryError, check
from tidemark.plans.parser import parse
from tidemark.plans.sqlfront import parse_sql
from tidemark.sources.store import FactStore
from tidemark.streaming import feeds

WRITES = frozenset("put define_schema snapshot rollback enrich ask run".split())


@dataclass
class Result:
    """kind, the main table if there is one, and whatever else the statement gives."""

    kind: str
    table: DataFrame | None = None
    info: Any = None


class Engine:
    """Over a ``FactStore`` (reads and writes) or over ``Facts`` made of any tables (reads)."""

    def __init__(self, source: FactStore | Facts, *, strict_sql: bool = False, models: dict[str, Callable[..., Any]] | None = None, answer: Callable[[str, list[dict[str, Any]]], str] | None = None, embed: Callable[[str], list[float]] | None = None):
        self.source, self.strict_sql, self.models, self.answer, self.embed = source, strict_sql, models or {}, answer, embed

    @property
    def base(self) -> Facts:
        return self.source.base() if isinstance(self.source, FactStore) else self.source

    @property
    def store(self) -> FactStore:
        if not isinstance(self.source, FactStore):
            raise QueryError("this fact base is read-only")
        return self.source

    # ---- front doors ----
    def query(self, q: str | Query, now: int | None = None) -> Result:
        now = now or time.time_ns() // 1000
        return self._run(parse(q, now) if isinstance(q, str) else check(q), now)

    def sql(self, text: str, now: int | None = None) -> Result:
        now = now or time.time_ns() // 1000
        return self._run(parse_sql(text, now), now)

    def _run(self, q: Query, now: int) -> Result:
        return getattr(self, "_procedure" if q.kind == "run" else f"_{q.kind}")(q, now)

    # ---- reads ----
    def _facts(self, q: Query, now: int) -> Result:
        base = self.base
        table = read.read(base.facts, q, self.strict_sql)
        if q.why and not any(i.agg for i in q.items):
            seeds = read.read(base.facts, Query(**{**q.__dict__, "items": []}))
            return Result("facts", table, graph.chains(base, seeds, q.depth))
        return Result("facts", table)

    _history = _facts

    def _subjects(self, q: Query, now: int) -> Result:
        own = subject_filter(q.subject)
        facts = self.base.facts
        out = temporal.subjects(facts.where(own) if own is not None else facts)
        return Result("subjects", out.limit(q.limit) if q.limit else out)

    def _pending(self, q: Query, now: int) -> Result:
        return Result("pending", temporal.pending(self.base.facts, q.facet, q.options.get("older_days", 0), now))

    def _disagree(self, q: Query, now: int) -> Result:
        return Result("disagree", temporal.disagree(self.base.facts, q.names[0]))

    def _why(self, q: Query, now: int) -> Result:
        return Result(q.kind, graph.trace(self.base, q.options["event"], q.depth, q.kind == "effects"))

    _effects = _why

    def _similar(self, q: Query, now: int) -> Result:
        return Result("similar", vector.similar(self.base, q.options["event"], q.options.get("top", 10), q.options.get("min", -1.0)))

    def _context(self, q: Query, now: int) -> Result:
        c = context.context(self.base, q.subject, q.known_at, q.limit)
        return Result("context", c.facts, c)

    def _stats(self, q: Query, now: int) -> Result:
        return Result("stats", temporal.stats(self.base))

    def _schemas(self, q: Query, now: int) -> Result:
        latest = {s["schema_id"]: s for s in sorted(self.base.schemas, key=lambda s: s["version"])}
        return Result("schemas", None, [latest[k] for k in sorted(latest)])

    def _schema(self, q: Query, now: int) -> Result:
        return Result("schema", None, sorted((s for s in self.base.schemas if s["schema_id"] == q.options["id"]), key=lambda s: s["version"]))

    def _profile(self, q: Query, now: int) -> Result:
        view = read.gather(self.base.facts, q)
        return Result("profile", profile.fields(view), profile.summary(view))

    def _match(self, q: Query, now: int) -> Result:
        return Result("match", graph.match(self.base, q.subject, q.options["to"], q.options["direction"], q.options.get("via", ""), q.depth, q.limit))

    def _cycles(self, q: Query, now: int) -> Result:
        return Result("cycles", None, graph.cycles(self.base, q.subject))

    def _consistency(self, q: Query, now: int) -> Result:
        if "*" in q.subject or not q.names:
            raise QueryError("CONSISTENCY needs one subject and ON field")
        view = read.gather(self.base.facts, Query("facts", q.subject, as_of=q.as_of, known_at=q.known_at))
        return Result("consistency", topology.consistency(view, q.names[0], q.options.get("eps", 0.0)))

    def _drift(self, q: Query, now: int) -> Result:
        if not q.names:
            raise QueryError("DRIFT needs ON field")
        view = read.gather(self.base.facts, Query("history", q.subject, facet=q.facet))
        return Result("drift", topology.drift(view, q.names[0], q.options.get("buckets", 4)))

    def _shape(self, q: Query, now: int) -> Result:
        o = q.options
        if o.get("window") and "*" in q.subject:
            raise QueryError("SHAPE: WINDOW needs one subject")
        base = self.base
        view = read.gather(base.facts, Query("history" if o.get("window") else "facts", q.subject, facet=q.facet, as_of=q.as_of, known_at=q.known_at))
        info = topology.shape(base, view, q.names, embedding=o.get("embedding", False), window=o.get("window", 0), stride=o.get("stride", 1), metric=o.get("metric", ""), maxdim=o.get("maxdim", 1), normalize=o.get("normalize"), scale=o.get("scale", 0.0))
        return Result("shape", None, info)

    def _search(self, q: Query, now: int) -> Result:
        base, o = self.base, q.options
        view = read.gather(base.facts, Query("facts", q.subject, facet=q.facet, as_of=q.as_of, known_at=q.known_at))
        v, every = None, False
        if "event" in o:
            row = vector.latest(base.enrichments.where(F.col("target_event") == o["event"])).select("vector").first()
            v = row[0] if row else None
        elif self.embed:
            v, every = self.embed(o["text"]), True
        return Result("search", search.search(base, view, o["text"], q.limit, v, o.get("alpha", 0.5), every))

    def _diff(self, q: Query, now: int) -> Result:
        return Result("diff", txn.diff(self.base.facts, q.options["from"], q.options["to"], q.subject, q.facet))

    def _watch(self, q: Query, now: int) -> Result:
        return Result("watch", feeds.watch(self.store, "" if q.subject == "*" else q.subject, q.facet, q.options.get("type", "")))

    def _explain(self, q: Query, now: int) -> Result:
        inner = q.inner
        steps = explain_steps(inner)
        if inner.kind in WRITES:
            return Result("explain", None, {"steps": steps, "ran": False})
        r = self._run(inner, now)
        info: dict[str, Any] = {"steps": steps, "ran": bool(q.options.get("analyze"))}
        if r.table is not None:
            info["plan"] = r.table._jdf.queryExecution().explainString(r.table.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
            if q.options.get("analyze"):
                began = time.perf_counter()
                info["rows"] = r.table.count()
                info["ms"] = (time.perf_counter() - began) * 1000
        return Result("explain", None, info)

    # ---- writes ----
    def _put(self, q: Query, now: int) -> Result:
        o = q.options
        event = {"event_id": uuid.uuid4().hex, "subject": q.subject, "facet": q.facet or "source", "type": o["type"], "value": q.sets, "schema_id": o.get("schema"), "effective_time": o.get("effective", 0), "provenance": o.get("provenance", "HUMAN_ENTRY"), "confidence": o.get("confidence", 1.0), "source_system": "query", "source_ref": o.get("ref")}
        return Result("put", self.store.append([event], now), event["event_id"])

    def _define_schema(self, q: Query, now: int) -> Result:
        return Result("define_schema", None, self.store.define_schema(q.options["id"], q.options["fields"], now, q.options.get("title", "")))

    def _snapshot(self, q: Query, now: int) -> Result:
        name = q.options["name"].strip()
        if not name:
            raise QueryError("SNAPSHOT needs a name")
        return Result("snapshot", self.store.append([{"subject": f"snapshot:{name}", "facet": "meta", "value": {"at": now, "name": name}}], now), {"at": now})

    def _rollback(self, q: Query, now: int) -> Result:
        facts, at = self.store.facts(), q.as_of
        if "snapshot" in q.options:
            marker = temporal.current(facts.where((F.col("subject") == f"snapshot:{q.options['snapshot']}") & (F.col("facet") == "meta")))
            row = marker.select(resolve(marker, "at").number).first()
            if row is None or row[0] is None:
                raise QueryError(f"no snapshot {q.options['snapshot']!r}")
            at = int(row[0])
        at = at or txn.last_commit(facts)
        if not at:
            return Result("rollback", None, {"reverted": 0})
        plan = txn.rollback_plan(facts, at, q.subject)
        n = plan.count()
        if not n:
            return Result("rollback", plan, {"reverted": 0, "to": at})
        marker_id = uuid.uuid4().hex
        marker = plan.sparkSession.createDataFrame([(marker_id, f"rollback:{now}", "meta", "OBSERVED", f'{{"to": {at}, "count": {n}}}')], "event_id string, subject string, facet string, type string, value string")
        payload = F.when(F.col("change") == "retired", F.lit('{"retired": true}')).otherwise(F.to_json("value"))
        reverts = plan.select(F.concat(F.lit(f"{marker_id}:"), F.sha2(F.concat_ws("\x1f", "subject", "facet"), 256)).alias("event_id"), "subject", "facet", F.lit("CORRECTION").alias("type"), payload.alias("value"))
        links = reverts.select(F.lit(self.store.tip()).cast("bigint").alias("log_seq"), F.lit(marker_id).alias("from_id"), F.col("event_id").alias("to_id"), F.lit("TRIGGERED").alias("type"))
        written = self.store.append(marker.unionByName(reverts), now, links)
        return Result("rollback", written, {"reverted": n, "to": at, "marker": marker_id})

    def _enrich(self, q: Query, now: int) -> Result:
        return assist.enrich(self, q, now)

    def _ask(self, q: Query, now: int) -> Result:
        return assist.ask(self, q.options["text"], now)

    def _procedure(self, q: Query, now: int) -> Result:
        return Result("run", None, procedures.run(self, q.subject, q.sets, now))

    # ---- methods ----
    def current(self, subject: str = "*", facet: str = "") -> DataFrame:
        return read.read(self.base.facts, Query("facts", subject, facet=facet))

    def as_of(self, subject: str, at: int, known_at: int = 0, facet: str = "") -> DataFrame:
        return read.read(self.base.facts, Query("facts", subject, facet=facet, as_of=at, known_at=known_at))

    def history(self, subject: str, facet: str = "", limit: int = 0) -> DataFrame:
        return temporal.history_last(self.base.facts, subject, limit, facet)

    def by_ref(self, ref: str) -> DataFrame:
        return temporal.by_ref(self.base.facts, ref)

    def append(self, events: DataFrame | Iterable[dict[str, Any]], now: int, links: Iterable[tuple[str, str, str]] = ()) -> DataFrame:
        return self.store.append(events, now, links)

    def activate(self, ids: Iterable[str], now: int) -> DataFrame:
        return self.store.activate(ids, now)

    def retain(self, pattern: str, days: int, now: int, dry_run: bool = True) -> DataFrame:
        """What retention would retire; retired indeed unless ``dry_run``."""
        plan = retention.plan(self.store.facts(), pattern, now - days * 86_400_000_000)
        if not dry_run and not plan.isEmpty():
            self.store.append(plan.select("subject", "facet", F.lit("CORRECTION").alias("type"), F.lit('{"retired": true}').alias("value"), F.lit("SYSTEM_FEED").alias("provenance")), now)
        return plan

    def define_procedure(self, source: str, now: int) -> str:
        name = procedures.parse(source).name
        self.store.append([{"subject": f"proc:{name}", "facet": "source", "value": {"source": source}, "provenance": "HUMAN_ENTRY"}], now)
        return name


def explain_steps(q: Query) -> list[str]:
    """How a statement is answered, in words."""
    view = "all events" if q.kind == "history" else f"as of {q.as_of or q.known_at}" + (f", known at {q.known_at}" if q.known_at else "") if q.as_of or q.known_at else "open facts"
    steps = [f"{q.kind}: {view} of {q.subject or '*'}"]
    if q.subject and "*" not in q.subject:
        steps.append("subject is an equality of the scan")
    elif q.subject.endswith("*") and q.subject != "*" and "*" not in q.subject[:-1]:
        steps.append("subject is a prefix test of the scan")
    for what, name in ((q.facet, "facet is an equality of the scan"), (q.where, "payload tests above the choice of version"), (q.group_by, f"partial and final aggregate by {q.group_by}"), (q.order_by, f"sort by {q.order_by}"), (q.limit, f"top {q.limit}")):
        if what:
            steps.append(name)
    return steps
