"""Which version of a fact holds: current, as of a moment, as known at a moment, pending, in disagreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.fields import resolve
from tidemark.model import DAY, Facts

STREAM = ("subject", "facet")


def _claims(facts: DataFrame) -> DataFrame:
    """All but the markers that say a distributed fact has landed."""
    return facts.where(F.col("type") != "ACTIVATED")


def current(facts: DataFrame) -> DataFrame:
    """The open fact of each stream. One writer's appends leave only the last open; where facts of other writers stand beside
    it, the greatest (effective, recorded, event_id) wins. The stream is the only shuffle key."""
    claims = _claims(facts)
    if "foreign" in facts.columns:
        own = Window.partitionBy(*STREAM, "foreign").orderBy(F.desc("log_seq"))
        claims = claims.withColumn("_nth", F.row_number().over(own)).where("foreign or _nth = 1").drop("_nth")
        order = [F.desc("effective_time"), F.desc("recorded_time"), F.desc("event_id")]
    else:
        order = [F.desc("log_seq")]
    w = Window.partitionBy(*STREAM).orderBy(*order)
    return claims.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def as_of(facts: DataFrame, at: int, known_at: int = 0) -> DataFrame:
    """What held at ``at``, as far as it was known at ``known_at`` (0: today): per stream the greatest effective time up to
    it, the last appended of equal ones. Supersession plays no part. Both bounds are filters of the scan."""
    at = at or known_at
    claims = _claims(facts).where(F.col("effective_time") <= at)
    if known_at:
        claims = claims.where(F.col("recorded_time") <= known_at)
    w = Window.partitionBy(*STREAM).orderBy(F.desc("effective_time"), F.desc("log_seq"))
    return claims.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def as_of_each(facts: DataFrame, probes: DataFrame) -> DataFrame:
    """As-of join: for each row of ``probes`` (subject, facet, at, any others) the fact that held then, null where none did.

    Facts and probes meet once in one sort by stream and time; the last fact seen is carried to the probes after it."""
    others = [c for c in probes.columns if c not in (*STREAM, "at")]
    fact = F.struct(*[F.col(c) for c in facts.columns])
    left = _claims(facts).select(*STREAM, F.col("effective_time").alias("_t"), F.lit(0).alias("_k"), F.col("log_seq").alias("_s"), fact.alias("fact"), *[F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in others])
    kind = left.schema["fact"].dataType
    right = probes.select(*STREAM, F.col("at").alias("_t"), F.lit(1).alias("_k"), F.lit(None).cast("bigint").alias("_s"), F.lit(None).cast(kind).alias("fact"), *others)
    w = Window.partitionBy(*STREAM).orderBy("_t", "_k", "_s").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("fact", F.last("fact", ignorenulls=True).over(w))
    return both.where("_k = 1").select(*STREAM, F.col("_t").alias("at"), *others, "fact")


def history(facts: DataFrame) -> DataFrame:
    return facts.orderBy("subject", "effective_time", "log_seq")


def history_last(facts: DataFrame, subject: str, limit: int = 0, facet: str = "") -> DataFrame:
    """The most recent ``limit`` events of one subject (0: all), oldest first."""
    own = facts.where(F.col("subject") == subject)
    own = own.where(F.col("facet") == facet) if facet else own
    if limit:
        own = own.orderBy(F.desc("effective_time"), F.desc("log_seq")).limit(limit)
    return own.orderBy("effective_time", "log_seq")


def superseded(facts: DataFrame) -> DataFrame:
    """``facts`` with superseded_by and effective_end: the next claim of the stream, by append order."""
    skip = F.col("type") == "ACTIVATED"
    if "foreign" in facts.columns:
        skip = skip | F.col("foreign")
    w = Window.partitionBy(*STREAM, skip).orderBy("log_seq")
    after = lambda c: F.when(~skip, F.lead(c).over(w))
    return facts.withColumns({"superseded_by": after("event_id"), "effective_end": after("effective_time")})


def activated(facts: DataFrame) -> DataFrame:
    """``facts`` with activation_time: when a marker says that a distributed fact landed; 0 if none does."""
    target = resolve(facts, "activates")
    if target.kind == "none":
        return facts.withColumn("activation_time", F.lit(0).cast("bigint"))
    markers = facts.where(F.col("type") == "ACTIVATED").groupBy(target.text.alias("_target")).agg(F.min("recorded_time").alias("_landed"))
    out = facts.join(markers, F.col("event_id") == F.col("_target"), "left")
    return out.withColumn("activation_time", F.coalesce("_landed", F.lit(0))).drop("_target", "_landed")


def resolved(facts: DataFrame) -> DataFrame:
    """Every event with all that later events say of it."""
    return activated(superseded(facts))


def pending(facts: DataFrame, facet: str, older_days: int = 0, now: int = 0) -> DataFrame:
    """Distributed, never landed, still open; by recorded time."""
    target = resolve(facts, "activates")
    # Facet and subject are the stream's key: the filter goes below the window.
    open_ = current(facts.where(F.col("facet") == facet)).where(F.col("type") == "DISTRIBUTED")
    if older_days:
        open_ = open_.where(F.col("recorded_time") < now - older_days * DAY)
    if target.kind != "none":
        landed = facts.where(F.col("type") == "ACTIVATED").select(target.text.alias("_target"))
        open_ = open_.join(landed, open_["event_id"] == landed["_target"], "left_anti")
    return open_.orderBy("recorded_time", "log_seq")


def disagree(facts: DataFrame, name: str) -> DataFrame:
    """All current facts of the subjects whose facets show more than one value of the field."""
    now = current(facts)
    if "." in name:
        return now.limit(0)  # top-level fields only
    w = Window.partitionBy("subject")
    printed = resolve(now, name).text
    marked = now.withColumns({"_lo": F.min(printed).over(w), "_hi": F.max(printed).over(w)})
    return marked.where("_lo != _hi").drop("_lo", "_hi").orderBy("subject", "facet")


def subjects(facts: DataFrame) -> DataFrame:
    return facts.select("subject").distinct().orderBy("subject")


def by_ref(facts: DataFrame, ref: str) -> DataFrame:
    return facts.where(F.col("source_ref") == ref).orderBy("log_seq")


def stats(base: Facts) -> DataFrame:
    """One row: events, subjects, open_streams, pending, links."""
    f = base.facts
    counts = f.agg(F.count(F.lit(1)).alias("events"), F.count_distinct("subject").alias("subjects"), F.count_distinct(F.when(F.col("type") != "ACTIVATED", F.struct("subject", "facet"))).alias("open_streams"))
    landed = resolve(f, "activates")
    waiting = current(f).where(F.col("type") == "DISTRIBUTED")
    if landed.kind != "none":
        done = f.where(F.col("type") == "ACTIVATED").select(landed.text.alias("_target"))
        waiting = waiting.join(done, waiting["event_id"] == done["_target"], "left_anti")
    return counts.crossJoin(waiting.agg(F.count(F.lit(1)).alias("pending"))).crossJoin(base.links.agg(F.count(F.lit(1)).alias("links")))  # one row each
