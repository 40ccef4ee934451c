"""Similarity of vectors: exact cosine over all rows, best first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.model import Facts


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for different lengths and for vectors without length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / F.when(norm > 0, norm)).otherwise(0.0)


def latest(enrichments: DataFrame, kind: str = "embedding") -> DataFrame:
    """The last enrichment of the kind for each event."""
    w = Window.partitionBy("target_event").orderBy(F.desc("log_seq"))
    return enrichments.where(F.col("kind") == kind).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def similar_to_vector(base: Facts, vector: Sequence[float], top: int | None = 10, least: float = -1.0, but: str = "") -> DataFrame:
    """(event_id, subject, score): the ``top`` events with the most similar vectors, all of them compared; without ``top`` all from ``least``. The query goes as a
    literal; only the best rows of each partition travel."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    norm = sum(float(x) ** 2 for x in vector) ** 0.5
    found = latest(base.enrichments).where(F.size("vector") == len(vector))
    found = found.where(F.col("target_event") != but) if but else found
    own = F.sqrt(dot(F.col("vector"), F.col("vector")))
    scored = found.select(F.col("target_event").alias("event_id"), F.when((own > 0) & F.lit(norm > 0), dot(F.col("vector"), q) / F.when(own > 0, own * norm)).alias("score"))
    best = scored.where(F.col("score").isNotNull() & (F.col("score") >= least)).orderBy(F.desc("score"), "event_id")
    if top is not None:
        best = best.limit(top or 10)
    return best.join(base.facts.select("event_id", "subject"), "event_id").select("event_id", "subject", "score").orderBy(F.desc("score"), "event_id")


def similar(base: Facts, event_id: str, top: int | None = 10, least: float = -1.0) -> DataFrame:
    """As ``similar_to_vector``, from the event's own vector; empty if it has none."""
    row = latest(base.enrichments.where(F.col("target_event") == event_id)).select("vector").first()
    if row is None or row[0] is None:
        return base.facts.select("event_id", "subject", F.lit(0.0).alias("score")).limit(0)
    return similar_to_vector(base, row[0], top, least, event_id)
