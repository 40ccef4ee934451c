"""What a fact is: an envelope with two clocks and a total append order, around a payload."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

ENVELOPE = "log_seq bigint, event_id string, subject string, facet string, type string, schema_id string, effective_time bigint, recorded_time bigint, provenance string, confidence double, source_system string, source_ref string"
LINKS = "log_seq bigint, from_id string, to_id string, type string"
ENRICHMENTS = "log_seq bigint, enrichment_id string, target_event string, kind string, model_id string, text string, vector array<float>, confidence double, created_at bigint"
EVENT_TYPES = ("INTENT", "DISTRIBUTED", "ACTIVATED", "OBSERVED", "CORRECTION")
#: How far a claim is believed: rank for disagreements, weight for search.
PROVENANCE_RANK = {"SCAN_VERIFIED": 4, "SYSTEM_FEED": 3, "HUMAN_ENTRY": 2, "AI_INFERRED": 1}
PROVENANCE_WEIGHT = {"SCAN_VERIFIED": 1.0, "SYSTEM_FEED": 0.85, "HUMAN_ENTRY": 0.7, "AI_INFERRED": 0.5}
OTHER_WEIGHT = 0.6
DAY = 86_400_000_000


@dataclass
class Facts:
    """A fact base. ``facts`` has the envelope and ``value``, a struct or VARIANT; the rest may be empty. A boolean column
    ``foreign`` marks facts of other writers, which supersede nothing and are superseded by nothing."""

    facts: DataFrame
    links: DataFrame
    enrichments: DataFrame
    schemas: list[dict[str, Any]] = field(default_factory=list)

    @classmethod
    def of(cls, facts: DataFrame, links: DataFrame | None = None, enrichments: DataFrame | None = None, schemas: list[dict[str, Any]] | None = None) -> Facts:
        s = facts.sparkSession
        return cls(facts, links if links is not None else s.createDataFrame([], LINKS), enrichments if enrichments is not None else s.createDataFrame([], ENRICHMENTS), schemas or [])

    @property
    def spark(self) -> SparkSession:
        return self.facts.sparkSession

    def with_(self, **parts: Any) -> Facts:
        return Facts(**({"facts": self.facts, "links": self.links, "enrichments": self.enrichments, "schemas": self.schemas} | parts))


def value_type(facts: DataFrame) -> T.DataType:
    return facts.schema["value"].dataType
