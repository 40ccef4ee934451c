"""Bulk loads, logs and exports."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import model

#: A log line is one of: an event, a link, an enrichment, a schema.
RECORD = f"kind string, event struct<{model.ENVELOPE.replace(' bigint', ': bigint').replace(' string', ': string').replace(' double', ': double')}, value: variant>, link struct<from_id: string, to_id: string, type: string>, enrichment struct<enrichment_id: string, target_event: string, kind: string, model_id: string, text: string, vector: array<float>, confidence: double, created_at: bigint>"


def smart(c: Column) -> Column:
    """What a CSV cell holds, as JSON: a number, true or false, or a string; null where it is empty."""
    number = c.rlike(r"\A-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?\z")
    flag = F.lower(c).isin("true", "false")
    quoted = F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)
    return F.when(c.isNull() | (c == ""), F.lit(None).cast("string")).when(number, c).when(flag, F.lower(c)).otherwise(quoted)


def to_facts(rows: DataFrame, subject: str, facet: str = "source", *, fields: Iterable[str] = (), effective: str = "", ref: str = "", source: str = "", typed: bool = True, transform: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """A table's rows as facts to append: ``subject`` is a pattern with column names in braces, such as ``item:{sku}/store:{id}``;
    the payload is all columns or ``fields``. ``typed`` keeps the columns' types, else text cells are read smartly."""
    rows = transform(rows) if transform else rows
    parts, rest = [], subject
    while "{" in rest:
        before, _, after = rest.partition("{")
        name, _, rest = after.partition("}")
        parts += [F.lit(before), F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))]
    names = list(fields) or rows.columns
    if typed:
        value = F.to_json(F.struct(*[F.col(f"`{c}`").alias(c) for c in names]))
    else:
        cells = [F.concat(F.lit(json.dumps(c) + ":"), smart(F.col(f"`{c}`").cast("string"))) for c in names]
        value = F.concat(F.lit("{"), F.concat_ws(",", *cells), F.lit("}"))
    out = {"subject": F.concat(*parts, F.lit(rest)), "facet": F.lit(facet), "value": value, "source_system": F.lit(source)}
    if effective:
        c = F.col(f"`{effective}`")
        out["effective_time"] = c.cast("bigint") if rows.schema[effective].dataType.typeName() in ("long", "integer") else F.unix_micros(c.cast("timestamp"))
    if ref:
        out["source_ref"] = F.col(f"`{ref}`").cast("string")
    return rows.select(*[c.alias(k) for k, c in out.items()])


def load(spark: SparkSession, path: str, format: str, subject: str, **more: Any) -> DataFrame:
    """CSV (header, smart types), JSON lines, JSON or Parquet files as facts to append."""
    if format == "csv":
        return to_facts(spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path), subject, typed=False, **more)
    if format in ("json", "jsonl"):
        return to_facts(spark.read.option("multiLine", format == "json").json(path), subject, **more)
    return to_facts(spark.read.format(format).load(path), subject, **more)


def read_log(spark: SparkSession, path: str) -> model.Facts:
    """A log of JSON lines. A torn last line, one that doesn't end as JSON does, is dropped; any other bad line fails the read.

    Append order is file by file and line by line, from the position that Spark gives each line within its file's split."""
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.monotonically_increasing_id().alias("_at")).where("value != ''")
    parsed = lines.select("_at", "value", F.from_json(F.to_json(F.try_parse_json("value")), RECORD).alias("r"), F.try_parse_json("value").isNotNull().alias("ok"))
    last = lines.agg(F.max("_at")).first()[0]
    good = parsed.where(F.col("ok") | (F.col("_at") != F.lit(last)))
    good = good.withColumn("r", F.when(F.col("ok"), F.col("r")).otherwise(F.raise_error(F.concat(F.lit("bad line in the log: "), F.substring("value", 1, 80))).cast(parsed.schema["r"].dataType)))
    seq = F.coalesce(F.col("r.event.log_seq"), F.col("_at"))
    facts = good.where("r.kind = 'event'").select(seq.alias("log_seq"), *[F.col(f"r.event.{c.split()[0]}") for c in model.ENVELOPE.split(", ")[1:]], F.col("r.event.value"))
    links = good.where("r.kind = 'link'").select(F.col("_at").alias("log_seq"), "r.link.*")
    enr = good.where("r.kind = 'enrichment'").select(F.col("_at").alias("log_seq"), "r.enrichment.*")
    return model.Facts.of(facts, links, enr)


def write_log(base: model.Facts, path: str) -> None:
    """Facts and links as a log of JSON lines, events by append order."""
    events = base.facts.orderBy("log_seq").select(F.to_json(F.struct(F.lit("event").alias("kind"), F.struct(*[F.col(c) for c in base.facts.columns]).alias("event"))).alias("value"))
    links = base.links.orderBy("log_seq").select(F.to_json(F.struct(F.lit("link").alias("kind"), F.struct("from_id", "to_id", "type").alias("link"))).alias("value"))
    events.unionByName(links).write.text(path)


def merge_logs(*facts: DataFrame) -> DataFrame:
    """The union of logs: records that are the same in all but position collapse; the first log's order comes first."""
    key = [c for c in facts[0].columns if c not in ("log_seq", "value")]
    out = None
    for i, f in enumerate(facts):
        f = f.withColumns({"_log": F.lit(i), "_json": F.to_json("value")})
        out = f if out is None else out.unionByName(f)
    by = out.groupBy(*key, "_json").agg(F.min(F.struct("_log", "log_seq")).alias("_at"))
    kind = facts[0].schema["value"].dataType
    value = F.parse_json("_json") if kind.typeName() == "variant" else F.from_json("_json", kind)
    # Positions of the logs one after the other, without a sort of all records.
    tops = dict(map(tuple, out.groupBy("_log").agg(F.max("log_seq")).collect()))  # a row a log
    shift, at = F.lit(0), 0
    for i in range(len(facts)):
        shift = F.when(F.col("_at._log") == i, F.lit(at)).otherwise(shift)
        at += (tops.get(i) or 0) + 1
    return by.select((F.col("_at.log_seq") + shift).alias("log_seq"), *key, value.alias("value")).select(*facts[0].columns)


def export(df: DataFrame, path: str, format: str) -> None:
    """csv, json (an array in one file a partition isn't asked of a cluster: lines), jsonl or parquet."""
    flat = df.select(*[F.to_json(F.col(f"`{c}`")).alias(c) if t.startswith(("struct", "array", "map", "variant")) and format == "csv" else F.col(f"`{c}`") for c, t in df.dtypes])
    {"csv": lambda w: w.option("header", True).csv(path), "json": lambda w: w.json(path), "jsonl": lambda w: w.json(path), "parquet": lambda w: w.parquet(path)}[format](flat.write)


def _cell(v: Any) -> str:
    from tidemark.functions.predicates import printed

    return json.dumps(v.asDict(True), default=str) if hasattr(v, "asDict") else json.dumps(v, default=str) if isinstance(v, (list, dict)) else "" if v is None else printed(v)


def lines(df: DataFrame, format: str = "table") -> Iterator[str]:
    """The rows as text, one line after the other: table, plain, yaml, csv or jsonl. Rows stream through the driver; for a table
    the first thousand set the widths."""
    cols, rows = df.columns, df.toLocalIterator()
    if format == "jsonl":
        for r in rows:
            yield json.dumps(r.asDict(True), default=str, ensure_ascii=False)
    elif format == "yaml":
        for r in rows:
            for i, c in enumerate(cols):
                yield f"{'- ' if i == 0 else '  '}{c}: {json.dumps(_cell(r[i]), ensure_ascii=False)}"
    elif format == "csv":
        import csv
        import io

        for r in [cols]:
            yield ",".join(r)
        for r in rows:
            buf = io.StringIO()
            csv.writer(buf, lineterminator="").writerow([_cell(v) for v in r])
            yield buf.getvalue()
    elif format == "plain":
        for r in rows:
            yield "\t".join(_cell(v) for v in r)
    else:
        head = []
        for r in rows:
            head.append([_cell(v) for v in r])
            if len(head) == 1000:
                break
        width = [max(len(c), *(len(r[i]) for r in head)) if head else len(c) for i, c in enumerate(cols)]
        fmt = lambda r: "  ".join(x.ljust(w) for x, w in zip(r, width)).rstrip()
        yield fmt(cols)
        yield fmt(["-" * w for w in width])
        for r in head:
            yield fmt(r)
        for r in rows:
            yield fmt([_cell(v) for v in r])
