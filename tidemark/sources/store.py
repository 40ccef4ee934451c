"""A fact base on disk: commits are Parquet folders, and a commit counts once its manifest is there, which is one rename.

One writer at a time. Readers list the manifests, so that they never see half a commit, and lost tasks leave nothing behind
that counts. Payloads are VARIANT.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import model, schemas
from tidemark.functions.fields import resolve
from tidemark.model import EVENT_TYPES, Facts
from tidemark.operators import retention, temporal
from tidemark.session import cut

FACTS = f"{model.ENVELOPE}, value variant"


class Rejected(ValueError):
    """A batch that is refused as a whole."""


class FactStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._p("manifests"))

    def _p(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    # ---- reading ----
    def manifests(self) -> list[dict[str, Any]]:
        """Commits in order, without those that a later one took the place of."""
        ms = self._listed()
        gone = {c for m in ms for c in m.get("replaces", ())}
        return [m for m in ms if m["commit"] not in gone]

    def _listed(self) -> list[dict[str, Any]]:
        names = sorted(s.getPath().toString() for s in self._fs.listStatus(self._p("manifests")) if s.getPath().getName().endswith(".json"))
        if not names:
            return []
        rows = self.spark.read.option("wholetext", True).text(names).collect()  # one small file a commit
        return sorted((json.loads(r[0]) for r in rows), key=lambda m: m["commit"])

    def _read(self, part: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/data/{m['folder']}/{part}" for m in self.manifests() if part in m["parts"]]
        if not paths:
            return self.spark.createDataFrame([], schema) if "variant" not in schema else self.spark.createDataFrame([], model.ENVELOPE).withColumn("value", F.parse_json(F.lit("{}")))
        return self.spark.read.schema(schema).parquet(*paths)

    def facts(self) -> DataFrame:
        return self._read("facts", FACTS)

    def base(self, supersedes: bool = True) -> Facts:
        """All that is committed. Links that supersession implies, new to old, are derived, not stored."""
        facts = self.facts()
        links = self._read("links", model.LINKS)
        if supersedes:
            links = links.unionByName(supersede_links(facts))
        return Facts.of(facts, links, self._read("enrichments", model.ENRICHMENTS), self.schemas())

    def schemas(self) -> list[dict[str, Any]]:
        return [s for m in self.manifests() for s in m.get("schemas", [])]

    def tip(self) -> int:
        """The last append's number."""
        return max((m["tip"] for m in self.manifests()), default=0)

    # ---- writing ----
    def _commit(self, parts: dict[str, DataFrame], tip: int, **more: Any) -> dict[str, Any]:
        ms = self.manifests()
        n, folder = (ms[-1]["commit"] + 1 if ms else 1), uuid.uuid4().hex
        for name, df in parts.items():
            df.write.parquet(f"{self.path}/data/{folder}/{name}")
        return self._publish({"commit": n, "folder": folder, "parts": sorted(parts), "tip": tip} | more)

    def _publish(self, m: dict[str, Any]) -> dict[str, Any]:
        """A manifest is there as a whole or not at all; the first writer of a number wins."""
        staged, final = self._p("manifests", f".{m['folder']}"), self._p("manifests", f"{m['commit']:012d}.json")
        out = self._fs.create(staged, False)
        out.write(json.dumps(m).encode())
        out.close()
        if self._fs.exists(final) or not self._fs.rename(staged, final):
            self._fs.delete(staged, False)
            self._fs.delete(self._p("data", m["folder"]), True)
            raise Rejected("another writer was faster")
        return m

    def append(self, events: DataFrame | Iterable[dict[str, Any]], now: int, links: Iterable[tuple[str, str, str]] | DataFrame = ()) -> DataFrame:
        """All events or none. Given are event_id (made if missing), subject, facet, type, value (dict, struct, VARIANT or JSON text),
        schema_id, effective_time (``now`` if not positive), provenance, confidence, source_system, source_ref; recorded_time is
        ``now`` whatever is given. Gives back what was written."""
        if now <= 0:
            raise Rejected("now must be positive")
        df = events if isinstance(events, DataFrame) else self._frame(list(events))
        has = set(df.columns)
        col = lambda c, t, d=None: (F.coalesce(F.col(c).cast(t), F.lit(d)) if c in has else F.lit(d).cast(t))
        value = self._payload(df)
        # The order of the rows given is the append order; partitions are numbered one after the other.
        ids = df.select(
            F.monotonically_increasing_id().alias("_i"), F.spark_partition_id().alias("_p"), F.coalesce(col("event_id", "string"), F.expr("uuid()")).alias("event_id"), col("subject", "string", "").alias("subject"),
            col("facet", "string", "source").alias("facet"), col("type", "string", "OBSERVED").alias("type"), col("schema_id", "string").alias("schema_id"), col("effective_time", "bigint", 0).alias("effective_time"),
            col("provenance", "string", "SYSTEM_FEED").alias("provenance"), col("confidence", "double", 1.0).alias("confidence"), col("source_system", "string", "").alias("source_system"), col("source_ref", "string").alias("source_ref"), value.alias("value"),
        )
        ids = cut(ids.withColumn("value", F.to_json("value"))).withColumn("value", F.parse_json("value"))
        starts, n = [], self.tip()
        for p, size, first in sorted(map(tuple, ids.groupBy("_p").agg(F.count(F.lit(1)), F.min("_i")).collect())):  # a row a partition
            starts.append((p, n + 1 - first))
            n += size
        if not starts:
            return ids.drop("_p", "_i")
        table = self.spark.createDataFrame(starts, "_p int, _s bigint")
        batch = ids.join(F.broadcast(table), "_p").select(  # a row a partition
            (F.col("_i") + F.col("_s")).alias("log_seq"), "event_id", "subject", "facet", "type", "schema_id", F.when(F.col("effective_time") > 0, F.col("effective_time")).otherwise(now).alias("effective_time"),
            F.lit(now).cast("bigint").alias("recorded_time"), "provenance", "confidence", "source_system", "source_ref", "value",
        )
        self._check(batch)
        link_rows = links if isinstance(links, DataFrame) else self.spark.createDataFrame([(n, a, b, t) for a, b, t in links], model.LINKS)
        bad = link_rows.where("coalesce(from_id, '') = '' or coalesce(to_id, '') = '' or coalesce(type, '') = ''")
        if not bad.isEmpty():
            raise Rejected("a link needs both ends and a type")
        parts = {"facts": batch}
        if isinstance(links, DataFrame) or link_rows.count():
            parts["links"] = link_rows.select("log_seq", "from_id", "to_id", "type")
        self._commit(parts, n)
        return batch

    def _frame(self, rows: list[dict[str, Any]]) -> DataFrame:
        cols = ["event_id", "subject", "facet", "type", "schema_id", "effective_time", "provenance", "confidence", "source_system", "source_ref", "value"]
        kinds = {"effective_time": "bigint", "confidence": "double"}
        data = [tuple(json.dumps(r.get(c) or {}) if c == "value" else float(r[c]) if c == "confidence" and r.get(c) is not None else r.get(c) for c in cols) for r in rows]
        return self.spark.createDataFrame(data, ", ".join(f"{c} {kinds.get(c, 'string')}" for c in cols)).coalesce(1)

    @staticmethod
    def _payload(df: DataFrame) -> Column:
        if "value" not in df.columns:
            return F.parse_json(F.lit("{}"))
        kind = df.schema["value"].dataType.typeName()
        return F.col("value") if kind == "variant" else F.parse_json(F.col("value") if kind == "string" else F.to_json("value"))

    def _check(self, batch: DataFrame) -> None:
        """Refuses the batch at the first rule broken: shape, doubles, schemas, holds."""
        why = (
            F.when(F.coalesce("subject", F.lit("")) == "", "a fact needs a subject")
            .when(F.coalesce("facet", F.lit("")) == "", "a fact needs a facet")
            .when(~F.col("type").isin(*EVENT_TYPES), F.concat(F.lit("unknown type "), "type"))
            .when(F.isnan("confidence") | ~F.col("confidence").between(0, 1), "confidence must lie between 0 and 1")
        )
        for problem in (batch.select(why.alias("w")).where("w is not null"), schemas.violations(batch, self.schemas()).select(F.col("problem").alias("w"))):
            if (row := problem.first()) is not None:
                raise Rejected(row[0])
        known = self.facts().select("event_id")
        doubled = batch.groupBy("event_id").count().where("count > 1").select("event_id").unionByName(batch.select("event_id").join(known, "event_id", "left_semi"))
        if (row := doubled.first()) is not None:
            raise Rejected(f"event {row[0]} is there already")
        closing = batch.where(resolve(batch, "retired").number == 1).select("subject").distinct()
        if (row := retention.held(self.facts(), closing).first()) is not None:
            raise Rejected(f"{row[0]} is on hold")

    def activate(self, event_ids: Iterable[str], now: int) -> DataFrame:
        """Distributed facts have landed: a marker each, and a link to it. Refused if one isn't distributed or has landed before."""
        wanted = self.spark.createDataFrame([(e,) for e in event_ids], "event_id string")
        facts = self.facts()
        found = temporal.activated(facts.join(wanted, "event_id", "left_semi").unionByName(facts.where("type = 'ACTIVATED'"))).where("type != 'ACTIVATED'")
        rows = found.select("event_id", "subject", "facet", "type", "activation_time").collect()  # as many as were asked for
        missing = {r[0] for r in wanted.collect()} - {r[0] for r in rows}
        if missing:
            raise Rejected(f"no event {min(missing)}")
        for r in rows:
            if r["type"] != "DISTRIBUTED" or r["activation_time"]:
                raise Rejected(f"{r['event_id']} can't be activated")
        markers = [{"event_id": f"act:{r['event_id']}", "subject": r["subject"], "facet": r["facet"], "type": "ACTIVATED", "value": {"activates": r["event_id"]}, "effective_time": now} for r in rows]
        return self.append(markers, now, [(r["event_id"], f"act:{r['event_id']}", "ACTIVATED_BY") for r in rows])

    def add_enrichments(self, rows: Iterable[dict[str, Any]] | DataFrame, now: int) -> None:
        """target_event, kind, model_id, text or vector, confidence. The last of a kind holds."""
        tip = self.tip()
        if not isinstance(rows, DataFrame):
            rows = self.spark.createDataFrame([(tip + i + 1, uuid.uuid4().hex, r["target_event"], r["kind"], r.get("model_id"), r.get("text"), [float(x) for x in r["vector"]] if r.get("vector") is not None else None, float(r.get("confidence", 1.0)), now) for i, r in enumerate(rows)], model.ENRICHMENTS)
        kept = cut(rows)
        if not kept.select("target_event").distinct().join(self.facts().select(F.col("event_id").alias("target_event")), "target_event", "left_anti").isEmpty():
            raise Rejected("an enrichment needs an event that is there")
        self._commit({"enrichments": kept}, max(tip, kept.agg(F.max("log_seq")).first()[0] or 0))

    def define_schema(self, schema_id: str, fields: dict[str, dict[str, Any]], now: int, title: str = "") -> dict[str, Any]:
        """The next version of a schema."""
        schemas.check_definition(fields)
        version = 1 + max((s["version"] for s in self.schemas() if s["schema_id"] == schema_id), default=0)
        s = {"schema_id": schema_id, "version": version, "title": title, "fields": fields, "created_at": now}
        self._commit({}, self.tip(), schemas=[s])
        return s

    def compact(self, partitions: int | None = None) -> dict[str, Any]:
        """All commits as one, facts of a stream together and in order, so that scans of a subject or namespace skip row groups.
        One manifest takes the place of all old ones at once; whatever is left of those, here or after a crash, is hidden and
        goes then or with the next compaction. Run it without readers."""
        old, tip, all_schemas = self.manifests(), self.tip(), self.schemas()
        parts = {}
        for name, schema, keys in (("facts", FACTS, ["subject", "facet", "log_seq"]), ("links", model.LINKS, ["from_id", "log_seq"]), ("enrichments", model.ENRICHMENTS, ["target_event", "log_seq"])):
            if any(name in m["parts"] for m in old):
                df = self._read(name, schema)
                parts[name] = (df.repartitionByRange(partitions, keys[0]) if partitions else df.repartitionByRange(keys[0])).sortWithinPartitions(*keys)
        folder = uuid.uuid4().hex
        for name, df in parts.items():
            df.write.parquet(f"{self.path}/data/{folder}/{name}")
        listed = self._listed()
        kept = {m["commit"] for m in old}
        dead = [m for m in listed if m["commit"] in kept or any(m["commit"] in x.get("replaces", ()) for x in listed)]
        n = max((m["commit"] for m in old), default=0)
        new = self._publish({"commit": n + 1, "folder": folder, "parts": sorted(parts), "tip": tip, "schemas": all_schemas, "replaces": sorted(m["commit"] for m in dead)})
        for m in dead:
            self._fs.delete(self._p("manifests", f"{m['commit']:012d}.json"), False)
        for m in dead:
            self._fs.delete(self._p("data", m["folder"]), True)
        return new


def supersede_links(facts: DataFrame) -> DataFrame:
    """(log_seq, from_id, to_id, type): each claim supersedes the stream's claim before it."""
    w = Window.partitionBy("subject", "facet").orderBy("log_seq")
    claims = facts.where("type != 'ACTIVATED'").select("log_seq", F.col("event_id").alias("from_id"), F.lag("event_id").over(w).alias("to_id"), F.lit("SUPERSEDES").alias("type"))
    return claims.where("to_id is not null")
