"""Retention: subjects nobody has touched for long, unless a hold covers them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.fields import resolve, subject_filter
from tidemark.operators import temporal


def _pattern(c: Column) -> Column:
    """A glob in a column as a regular expression."""
    parts = F.transform(F.split(c, r"\*"), lambda p: F.concat(F.lit(r"\Q"), F.replace(p, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    return F.concat(F.lit(r"\A"), F.array_join(parts, ".*"), F.lit(r"\z"))


def holds(facts: DataFrame) -> DataFrame:
    """(pattern): globs of the current facts on ``hold:*`` that aren't retired or released."""
    own = temporal.current(facts.where(F.col("subject").startswith("hold:")))
    pattern, retired = resolve(own, "pattern").text, resolve(own, "retired")
    live = own.where(~F.coalesce(retired.number == 1, F.lit(False))) if retired.kind != "none" else own
    return live.select(pattern.alias("pattern")).where("pattern is not null and pattern != ''").distinct()


def held(facts: DataFrame, subjects: DataFrame) -> DataFrame:
    """The subjects that a hold covers. Holds are a legal act each, so few; the theta join broadcasts them."""
    h = holds(facts)
    return subjects.join(F.broadcast(h), F.rlike(subjects["subject"], _pattern(h["pattern"])), "left_semi")


def plan(facts: DataFrame, pattern: str, before: int) -> DataFrame:
    """(subject, facet, event_id): open facts to retire: all of a subject that matches, whose newest fact was recorded before
    ``before`` and that no hold covers."""
    own = subject_filter(pattern)
    mine = facts.where(own) if own is not None else facts
    open_ = temporal.current(mine.where(~F.col("subject").startswith("hold:")))
    retired = resolve(open_, "retired")
    if retired.kind != "none":
        open_ = open_.where(~F.coalesce(retired.number == 1, F.lit(False)))
    old = open_.groupBy("subject").agg(F.max("recorded_time").alias("_last")).where(F.col("_last") < before).select("subject")
    h = holds(facts)
    free = old.join(F.broadcast(h), F.rlike(old["subject"], _pattern(h["pattern"])), "left_anti")  # holds are few
    return open_.join(free, "subject", "left_semi").select("subject", "facet", "event_id").orderBy("subject", "facet")
