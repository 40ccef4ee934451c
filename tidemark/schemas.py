"""Schemas of payloads: versions of field rules, checked when facts are written."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.fields import Field, _kind

TYPES = ("number", "string", "bool", "any")


def check_definition(fields: dict[str, dict[str, Any]]) -> None:
    if not fields:
        raise ValueError("a schema needs fields")
    for name, f in fields.items():
        if f.get("type") not in TYPES:
            raise ValueError(f"{name}: no type {f.get('type')!r}")
        if f["type"] != "number" and (f.get("min") is not None or f.get("max") is not None):
            raise ValueError(f"{name}: only numbers have bounds")


def latest(schemas: list[dict[str, Any]], schema_id: str) -> dict[str, Any] | None:
    own = [s for s in schemas if s["schema_id"] == schema_id]
    return max(own, key=lambda s: s["version"]) if own else None


def violations(facts: DataFrame, schemas: list[dict[str, Any]]) -> DataFrame:
    """(event_id, problem) of facts that name a schema and break its latest version, or name one that isn't there. Fields that
    the schema doesn't know pass; a null that is there breaks every type."""
    ids = sorted({s["schema_id"] for s in schemas})
    # the reference text may carry a version, as in name@v2; the latest holds
    named = F.regexp_replace(F.coalesce("schema_id", F.lit("")), r"@v\d+$", "")
    problem = F.when((named != "") & ~named.isin(ids), F.concat(F.lit("no schema "), "schema_id")) if ids else F.when(named != "", F.concat(F.lit("no schema "), "schema_id"))
    for sid in ids:
        for name, rule in latest(schemas, sid)["fields"].items():
            f = resolve_payload(facts, name)
            mine = named == sid
            there = f.column.isNotNull()
            right = {"any": F.lit(True), "string": f.string.isNotNull(), "number": f.is_number & f.number.isNotNull(), "bool": F.lit(f.kind == "bool")}[rule["type"]]
            if f.kind == "any":
                shape = F.coalesce(F.schema_of_variant(f.column), F.lit(""))
                right = {"any": F.lit(True), "string": shape == "STRING", "bool": shape == "BOOLEAN", "number": f.is_number & (shape != "BOOLEAN")}[rule["type"]]
            if rule.get("required"):
                problem = problem.when(mine & ~f.exists, f"{name} is required")
            problem = problem.when(mine & there & ~right, f"{name} must be a {rule['type']}")
            if rule.get("min") is not None:
                problem = problem.when(mine & (f.number < rule["min"]), f"{name} is below {rule['min']}")
            if rule.get("max") is not None:
                problem = problem.when(mine & (f.number > rule["max"]), f"{name} is above {rule['max']}")
    return facts.select("event_id", problem.alias("problem")).where("problem is not null")


def resolve_payload(facts: DataFrame, name: str) -> Field:
    """A payload field, even where the envelope has its name."""
    kind = facts.schema["value"].dataType
    if isinstance(kind, T.VariantType):
        return Field(F.try_variant_get("value", "$['" + name.replace("'", "\\'") + "']", "variant"), "any")
    found = next((f for f in kind.fields if f.name == name), None)
    return Field(F.col("value").getField(name), _kind(found.dataType)) if found else Field(F.lit(None).cast("string"), "none")
