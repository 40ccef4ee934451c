"""Everything about one subject, now or as it was known at a moment."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.fields import resolve
from tidemark.model import PROVENANCE_RANK, Facts
from tidemark.operators import graph, temporal
from tidemark.operators.profile import long_form


@dataclass
class Context:
    subject: str
    facts: DataFrame
    history: DataFrame
    disagreements: DataFrame
    pending: DataFrame
    enrichments: DataFrame
    causes: DataFrame
    schemas: list[dict[str, Any]]
    confidence: DataFrame


def rank_of():
    out = F.lit(0)
    for name, r in PROVENANCE_RANK.items():
        out = F.when(F.col("provenance") == name, r).otherwise(out)
    return out


def disagreements(view: DataFrame) -> DataFrame:
    """(subject, field, claims, resolved_facet, resolved_value): fields on which a subject's facts differ, and the claim to believe:
    by provenance, then confidence, then the later recorded, then append order. For all subjects of ``view`` at once."""
    claims = long_form(view, ["subject", "facet", "event_id", "recorded_time", "confidence", "log_seq"], rank_of().alias("trust")).where("text is not null")
    w = Window.partitionBy("subject", "name")
    differ = claims.withColumns({"_lo": F.min("text").over(w), "_hi": F.max("text").over(w)}).where("_lo != _hi")
    claim = F.struct("facet", "text", "event_id", "confidence", "recorded_time")
    best = F.struct("trust", "confidence", "recorded_time", (-F.col("log_seq")).alias("first"))
    return (
        differ.groupBy("subject", F.col("name").alias("field"))
        .agg(F.array_sort(F.collect_list(claim)).alias("claims"), F.max_by("facet", best).alias("resolved_facet"), F.max_by("text", best).alias("resolved_value"))
        .orderBy("subject", "field")
    )


def pending_as_known(facts: DataFrame, known_at: int = 0) -> DataFrame:
    """Distributed facts that, as far as was known at ``known_at`` (0: today), had neither landed nor been superseded."""
    target = resolve(facts, "activates")
    seen = facts.where(F.col("recorded_time") <= known_at) if known_at else facts
    w = Window.partitionBy("subject", "facet").orderBy("log_seq")
    claims = seen.where(F.col("type") != "ACTIVATED").withColumn("_next", F.lead("event_id").over(w)).where("_next is null").drop("_next")
    open_ = claims.where(F.col("type") == "DISTRIBUTED")
    if target.kind != "none":
        landed = seen.where(F.col("type") == "ACTIVATED").select(target.text.alias("_t"))
        open_ = open_.join(landed, open_["event_id"] == landed["_t"], "left_anti")
    return open_


def context(base: Facts, subject: str, known_at: int = 0, limit: int = 20, least: float = 0.0) -> Context:
    """Facts of at least ``least`` confidence, the latest ``limit`` of the timeline, disagreements, pending facts, enrichments,
    causes (three steps, the facts themselves not), schemas, and the least and mean confidence."""
    limit = limit or 20
    own = base.facts.where(F.col("subject") == subject)
    facts = (temporal.as_of(own, known_at, known_at) if known_at else temporal.current(own)).where(F.col("confidence") >= least)
    seen = own.where(F.col("recorded_time") <= known_at) if known_at else own
    ids = facts.select(F.col("event_id").alias("_e"))
    enr = base.enrichments.join(ids, base.enrichments["target_event"] == ids["_e"], "left_semi").orderBy("target_event", "log_seq")
    found = graph.reach(base.links, facts.select(F.col("event_id").alias("seed")), 3, forward=False)
    causes = found.join(base.facts, found["node"] == base.facts["event_id"]).select(F.col("seed").alias("fact"), "hops", "via", *base.facts.columns).orderBy("fact", "hops", "event_id")
    used = {r[0] for r in facts.select("schema_id").where("schema_id is not null and schema_id != ''").distinct().collect()}  # one subject's facts
    latest = {s["schema_id"]: s for s in sorted(base.schemas, key=lambda s: s["version"])}
    return Context(
        subject, facts.orderBy("facet"), seen.orderBy(F.desc("effective_time"), F.desc("log_seq")).limit(limit), disagreements(facts), pending_as_known(own, known_at).orderBy(F.desc("effective_time")),
        enr, causes, [latest[u] for u in sorted(used) if u in latest], facts.agg(F.min("confidence").alias("least"), F.avg("confidence").alias("mean")),
    )
