"""Names in statements to columns: metadata first, without regard to case, then the payload, with it.

A payload is a struct, whose fields are plain columns that Spark prunes and pushes down, or a VARIANT for facts of any shape.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_META = {
    "subject": "subject", "facet": "facet", "type": "type", "provenance": "provenance", "trust": "confidence", "confidence": "confidence",
    "effective": "effective_time", "effective_time": "effective_time", "recorded": "recorded_time", "recorded_time": "recorded_time",
    "event_id": "event_id", "id": "event_id", "schema": "schema_id", "schema_id": "schema_id", "ref": "source_ref", "source_ref": "source_ref",
    "source": "source_system", "source_system": "source_system",
}
_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def go_str(x: Column) -> Column:
    """How a double prints: no fraction where it is whole, shortest digits, an exponent below 1e-4 and from 1e21."""
    x = x.cast("double")
    plain = F.regexp_replace(x.cast("decimal(38,20)").cast("string"), r"\.?0+$", "")
    java = x.cast("string")  # beyond the plain range Java has an exponent, too
    mantissa = F.regexp_replace(F.regexp_extract(java, r"^([-0-9.]+)E", 1), r"\.0$", "")
    power = F.regexp_extract(java, r"E(-?[0-9]+)$", 1).try_cast("int")
    exponent = F.concat(mantissa, F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    size = F.abs(x)
    whole = (x == F.floor(x)) & (size < 9e15)
    return (
        F.when(x.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(x), "NaN")
        .when(size == float("inf"), F.when(x > 0, "+Inf").otherwise("-Inf"))
        .when(whole, F.when(size < 9e15, x).cast("bigint").cast("string"))
        .when((size >= 1e-4) & (size < 1e17), F.when(size < 1e17, plain))
        .when(power.isNotNull() & ((size < 1e-4) | (size >= 1e21)), exponent)
        .otherwise(F.when(size < 1e21, x).try_cast("decimal(38,0)").cast("string"))
    )


@dataclass(frozen=True)
class Field:
    """A resolved name. kind: number, bool, string, any (VARIANT) or none (no such field, always null)."""

    column: Column
    kind: str

    @property
    def exists(self) -> Column:
        return F.lit(False) if self.kind == "none" else self.column.isNotNull() if self.kind != "any" else self.column.isNotNull() & ~F.is_variant_null(self.column)

    @property
    def _shape(self) -> Column:
        return F.schema_of_variant(self.column)

    @property
    def is_number(self) -> Column:
        """Whether the value counts as a number: numbers and booleans do."""
        if self.kind == "any":
            return F.coalesce(self._shape.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|BOOLEAN)"), F.lit(False))
        return F.lit(self.kind in ("number", "bool"))

    @property
    def number(self) -> Column:
        """The value as a double, booleans as 1 and 0; null for anything else."""
        if self.kind == "number":
            return self.column.cast("double")
        if self.kind == "bool":
            return self.column.cast("int").cast("double")
        if self.kind == "any":
            boolean = self._shape == "BOOLEAN"
            return F.when(boolean, F.try_variant_get(self.column, "$", "boolean").cast("int").cast("double")).when(self.is_number, F.try_variant_get(self.column, "$", "double"))
        return F.lit(None).cast("double")

    @property
    def text(self) -> Column:
        """How the value prints; null where there is none."""
        if self.kind == "string":
            return self.column
        if self.kind == "bool":
            return self.column.cast("string")
        if self.kind == "number":
            return go_str(self.column)
        if self.kind == "any":
            number = self.is_number & (self._shape != "BOOLEAN")
            return F.when(~self.exists, F.lit(None).cast("string")).when(number, go_str(F.try_variant_get(self.column, "$", "double"))).otherwise(F.try_variant_get(self.column, "$", "string"))
        return F.lit(None).cast("string")

    @property
    def string(self) -> Column:
        """The value if it is a string."""
        if self.kind == "any":
            return F.when(self._shape == "STRING", F.try_variant_get(self.column, "$", "string"))
        return self.column if self.kind == "string" else F.lit(None).cast("string")

    @property
    def shown(self) -> Column:
        return self.text if self.kind == "any" else self.column


def _kind(t: T.DataType) -> str:
    return "number" if isinstance(t, _NUMBERS) else "bool" if isinstance(t, T.BooleanType) else "string" if isinstance(t, T.StringType) else "any" if isinstance(t, T.VariantType) else "other"


def namespace(subject: Column) -> Column:
    """What stands before the first colon; a subject without one, or with one in front, is its own."""
    return F.when(F.instr(subject, ":") > 1, F.substring_index(subject, ":", 1)).otherwise(subject)


def resolve(facts: DataFrame, name: str) -> Field:
    """The field that ``name`` means among ``facts``; unknown names are null."""
    low = name.lower()
    if low == "namespace":
        return Field(namespace(F.col("subject")), "string")
    if low == "pending":
        active = F.col("activation_time") if "activation_time" in facts.columns else F.lit(0)
        return Field((F.col("type") == "DISTRIBUTED") & (F.coalesce(active, F.lit(0)) == 0), "bool")
    if low == "superseded":
        return Field(F.col("superseded_by").isNotNull() if "superseded_by" in facts.columns else F.lit(False), "bool")
    if low in _META:
        c = _META[low]
        return Field(F.col(c), _kind(facts.schema[c].dataType)) if c in facts.columns else Field(F.lit(None).cast("string"), "none")
    kind: T.DataType = facts.schema["value"].dataType
    column = F.col("value")
    for i, part in enumerate(parts := name.split(".")):
        if isinstance(kind, T.VariantType):
            path = "$" + "".join("['" + p.replace("\\", "\\\\").replace("'", "\\'") + "']" for p in parts[i:])
            return Field(F.try_variant_get(column, path, "variant"), "any")
        found = next((f for f in kind.fields if f.name == part), None) if isinstance(kind, T.StructType) else None
        if found is None:
            return Field(F.lit(None).cast("string"), "none")
        column, kind = column.getField(part), found.dataType
    k = _kind(kind)
    if k == "other":  # objects and lists print as JSON and compare with nothing
        return Field(F.to_json(column) if isinstance(kind, (T.StructType, T.MapType, T.ArrayType)) else column.cast("string"), "string")
    return Field(column, k)


def text_columns(facts: DataFrame) -> list[Column]:
    """All top-level strings of a payload, as one array column each."""
    kind = facts.schema["value"].dataType
    if isinstance(kind, T.StructType):
        return [F.array(F.col("value").getField(f.name)) for f in kind.fields if isinstance(f.dataType, T.StringType)]
    m = F.from_json(F.to_json(F.col("value")), "map<string,string>")
    kinds = F.expr("try_variant_get(value, '$', 'map<string,variant>')")
    return [F.map_values(F.map_filter(m, lambda k, v: F.coalesce(F.schema_of_variant(kinds[k]) == "STRING", F.lit(False))))]


def glob(column: Column, pattern: str) -> Column:
    """``*`` is anything but a line break, all else itself, over the whole value; plain prefixes reach the scan."""
    if "*" not in pattern:
        return column == pattern
    if pattern == "*":
        return ~column.contains("\n")
    return column.rlike(r"\A" + ".*".join(re.escape(p).replace("\\/", "/") for p in pattern.split("*")) + r"\z")


def subject_filter(pattern: str) -> Column | None:
    """A filter over ``subject``; None where all pass. A pattern with one star at its end is a prefix test."""
    if pattern in ("", "*"):
        return None
    if pattern.endswith("*") and "*" not in pattern[:-1]:
        return F.col("subject").startswith(pattern[:-1])
    return glob(F.col("subject"), pattern)
