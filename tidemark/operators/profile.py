"""What the data look like: coverage, types, ranges and frequent values of every payload field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.fields import Field, _kind, namespace

MOST_DISTINCT = 1000
FIELD = "field string, type string, coverage double, distinct_values bigint, min double, max double, avg double, top array<struct<value:string,count:bigint>>"


def long_form(view: DataFrame, envelope: list[str] | None = None, *more: Column) -> DataFrame:
    """(name, kind, text, number) and the envelope columns asked for: a row for each payload field that a fact has; one scan, no
    join."""
    kept = envelope or []
    view = view.select(*kept, *more, "value")
    kept = view.columns[:-1]
    kind = view.schema["value"].dataType
    cells = []
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            k = _kind(f.dataType)
            r = Field(F.col("value").getField(f.name), k if k != "other" else "string")
            text = F.to_json(F.struct(r.column)) if k == "other" else r.text
            cells.append(F.struct(F.lit(f.name).alias("name"), F.when(r.column.isNotNull(), k).alias("kind"), text.alias("text"), (r.number if k == "number" else F.lit(None).cast("double")).alias("number")))
        rows = view.select(*kept, F.explode(F.array(*cells)).alias("c")).select(*kept, "c.*").where("kind is not null")
        return rows
    pairs = view.select(*kept, F.explode(F.expr("try_variant_get(value, '$', 'map<string,variant>')")).alias("name", "v"))
    r = Field(F.col("v"), "any")
    shape = F.schema_of_variant("v")
    k = F.when(shape == "BOOLEAN", "bool").when(shape == "STRING", "string").when(r.is_number, "number").otherwise("other")
    return pairs.select(*kept, "name", k.alias("kind"), r.text.alias("text"), F.when(k == "number", r.number).alias("number"))


def fields(view: DataFrame, top: int = 5) -> DataFrame:
    """One row a field: field, type, coverage, distinct_values (1000 at most), min, max, avg, top; widest coverage first."""
    rows = long_form(view)
    total = view.agg(F.count(F.lit(1)).alias("_all"))
    by_value = rows.groupBy("name", "kind", "text").agg(F.count(F.lit(1)).alias("n"), F.min("number").alias("lo"), F.max("number").alias("hi"), F.sum("number").alias("s"))
    w = Window.partitionBy("name").orderBy(F.col("kind").isin("number", "other"), F.desc("n"), "text")  # WindowGroupLimit keeps few rows a task
    best = by_value.where(F.col("kind").isin("string", "bool")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= top)
    best = best.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "text", "n"))), lambda x: F.struct(x["text"].alias("value"), x["n"].alias("count"))).alias("top"))
    kinds = by_value.groupBy("name", "kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("s").alias("s"))
    out = kinds.groupBy(F.col("name").alias("field")).agg(
        F.max_by("kind", F.struct("n", "kind")).alias("main"), F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("present"), F.least(F.sum("d"), F.lit(MOST_DISTINCT)).alias("distinct_values"),
        F.min("lo").alias("min"), F.max("hi").alias("max"), F.sum("s").alias("s"), F.sum(F.when(F.col("kind") == "number", F.col("n"))).alias("numbers"),
    )
    out = out.crossJoin(F.broadcast(total)).join(best, out["field"] == best["name"], "left")  # one row
    return out.select(
        "field", F.when(F.col("kinds") > 1, F.concat(F.lit("mixed ("), "main", F.lit(")"))).otherwise(F.col("main")).alias("type"), (F.col("present") / F.col("_all")).alias("coverage"),
        "distinct_values", "min", "max", (F.col("s") / F.col("numbers")).alias("avg"), "top",
    ).orderBy(F.desc("coverage"), "field")


def summary(view: DataFrame) -> DataFrame:
    """One row: events, subjects, and facts by facet and by namespace."""
    by = lambda c, name: view.groupBy(c.alias("k")).agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name))
    return view.agg(F.count(F.lit(1)).alias("events"), F.count_distinct("subject").alias("subjects")).crossJoin(by(F.col("facet"), "facets")).crossJoin(by(namespace(F.col("subject")), "namespaces"))  # one row each
