"""Differences between moments, snapshots and rollbacks: full outer joins of two views by stream, written forward as new facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.fields import subject_filter
from tidemark.operators import temporal


def _keeping_books(subject: Column) -> Column:
    return subject.startswith("snapshot:") | subject.startswith("rollback:")


def same_payload(a: Column, b: Column, kind: T.DataType) -> Column:
    """Equal payloads. Fields of a struct that are null are missing on both sides and equal; in a VARIANT, a null that is there
    equals nothing, itself not either."""
    if isinstance(kind, T.VariantType):
        null_inside = F.coalesce(F.to_json(a).rlike(r'":null[,}]'), F.lit(False))
        canon = lambda v: F.array_sort(F.map_entries(F.from_json(F.to_json(v), "map<string,string>")))
        return canon(a).eqNullSafe(canon(b)) & ~null_inside
    return a.eqNullSafe(b)


def _pairs(before: DataFrame, after: DataFrame) -> DataFrame:
    a = before.select("subject", "facet", F.col("value").alias("before"), F.lit(True).alias("_a"))
    b = after.select("subject", "facet", F.col("value").alias("after"), F.lit(True).alias("_b"))
    return a.join(b, ["subject", "facet"], "full_outer")


def diff(facts: DataFrame, t1: int, t2: int, pattern: str = "*", facet: str = "") -> DataFrame:
    """(subject, facet, change, before, after) between what held, as then known, at two moments: added, removed or changed."""
    own = subject_filter(pattern)
    facts = facts.where(own) if own is not None else facts
    facts = facts.where(F.col("facet") == facet) if facet else facts
    facts = facts.where(~_keeping_books(F.col("subject")))
    both = _pairs(temporal.as_of(facts, t1, t1), temporal.as_of(facts, t2, t2))
    same = same_payload(F.col("before"), F.col("after"), facts.schema["value"].dataType)
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~same, "changed")
    return both.withColumn("change", change).where("change is not null").select("subject", "facet", "change", "before", "after").orderBy("subject", "facet")


def last_commit(facts: DataFrame) -> int:
    """The moment just before the last commit; 0 if there is none."""
    last = facts.agg(F.max("recorded_time")).first()[0]
    return 0 if last is None else last - 1


def rollback_plan(facts: DataFrame, at: int, pattern: str = "*") -> DataFrame:
    """(subject, facet, change, value): what must be written so that each stream is as it was at ``at``, as then known. ``restored``
    carries the payload of then; ``retired`` closes a stream that wasn't there. Facts with a later effective time count as absent."""
    own = subject_filter(pattern)
    facts = facts.where(own) if own is not None else facts
    facts = facts.where(~_keeping_books(F.col("subject")))
    kind = facts.schema["value"].dataType
    both = _pairs(temporal.as_of(facts, at, at), temporal.current(facts))
    if isinstance(kind, T.VariantType):
        gone = F.coalesce(F.try_variant_get("after", "$.retired", "boolean"), F.lit(False))
    else:
        gone = F.coalesce(F.col("after.retired").cast("boolean"), F.lit(False)) if "retired" in kind.names else F.lit(False)
    same = same_payload(F.col("before"), F.col("after"), kind)
    change = F.when(F.col("_a").isNull(), F.when(~gone, "retired")).when(F.col("_b").isNull() | ~same, "restored")
    return both.withColumn("change", change).where("change is not null").select("subject", "facet", "change", F.col("before").alias("value")).orderBy("subject", "facet")
