"""The star-schema tables as facts. Payloads are structs: fields prune and push down like any column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.model import DAY, Facts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    """Microseconds of a time without a zone, read as UTC."""
    return F.unix_micros(F.to_utc_timestamp(F.col(ts).cast("timestamp"), F.current_timezone()))


def _s(c: str) -> Column:
    return F.col(c).cast("string")


def facts_of(df: DataFrame, *, log_seq: Column, event_id: Column, subject: Column, facet: Column, effective: Column, value: Column, recorded: Column | None = None, type_: Column | None = None, confidence: Column | None = None, provenance: Column | None = None, source: str = "", ref: Column | None = None) -> DataFrame:
    """Rows to facts; what isn't given has the writer's defaults."""
    effective = effective.cast("bigint")
    return df.select(
        log_seq.cast("bigint").alias("log_seq"), event_id.alias("event_id"), subject.alias("subject"), facet.alias("facet"),
        (type_ if type_ is not None else F.lit("OBSERVED")).alias("type"), F.lit(None).cast("string").alias("schema_id"),
        effective.alias("effective_time"), (recorded if recorded is not None else effective).cast("bigint").alias("recorded_time"),
        (provenance if provenance is not None else F.lit("SYSTEM_FEED")).alias("provenance"),
        (confidence if confidence is not None else F.lit(1.0)).cast("double").alias("confidence"),
        F.lit(source).alias("source_system"), (ref if ref is not None else F.lit(None).cast("string")).alias("source_ref"), value.alias("value"),
    )


def _packed(time: Column) -> Column:
    """An append order that takes no sort: whole days, then order (to a billion), supplier (to 10,000) and line in digits of
    their own. Unique within a part."""
    return F.floor(time / F.lit(DAY)).cast("bigint") * 100_000_000_000_000 + F.col("l_orderkey") * 100_000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")


def line_facts(spark: SparkSession, d: str) -> DataFrame:
    """lineitem: a part's price as three systems saw it."""
    t = table(spark, d, "lineitem")
    eff = micros("l_shipdate")
    rec = eff + F.col("l_linenumber").cast("bigint") * DAY
    seq = _packed(rec)
    return facts_of(
        t, log_seq=seq, event_id=F.concat(F.lit("line:"), F.concat_ws("/", _s("l_orderkey"), _s("l_partkey"), _s("l_suppkey"), _s("l_linenumber"))),
        subject=F.concat(F.lit("part:"), _s("l_partkey")), facet=F.col("l_returnflag"), effective=eff, recorded=rec,
        value=F.struct(F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("qty"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("l_linestatus").alias("status"), (F.col("l_quantity") >= 25).alias("bulk")),
        confidence=1 - F.col("l_tax"), provenance=F.when(F.col("l_linestatus") == "F", "SYSTEM_FEED").otherwise("HUMAN_ENTRY"),
        source="ledger", ref=F.concat(F.lit("order:"), _s("l_orderkey")),
    )


def user_facts(spark: SparkSession, d: str) -> DataFrame:
    """events: what users did."""
    t = table(spark, d, "events")
    return facts_of(
        t, log_seq=F.col("event_id"), event_id=F.concat(F.lit("evt:"), _s("event_id")), subject=F.concat(F.lit("user:"), _s("user_id")), facet=F.col("event_type"), effective=micros("ts"),
        value=F.struct(F.col("value").alias("value"), F.get_json_object("props", "$.k").try_cast("bigint").alias("k")), source="web",
    )


def order_facts(spark: SparkSession, d: str) -> DataFrame:
    """orders: distributed when ordered, landed a day later if filled."""
    t = table(spark, d, "orders")
    subject = F.concat(F.lit("customer:"), _s("o_custkey"), F.lit("/order:"), _s("o_orderkey"))
    key, eff = F.concat(F.lit("order:"), _s("o_orderkey")), micros("o_orderdate")
    none = lambda t: F.lit(None).cast(t)
    value = lambda a, b, c: F.struct(a.alias("total"), b.alias("priority"), c.alias("activates"))
    sent = facts_of(t, log_seq=F.col("o_orderkey") + 1, event_id=key, subject=subject, facet=F.lit("fulfilment"), effective=eff, type_=F.lit("DISTRIBUTED"), value=value(F.col("o_totalprice"), F.col("o_orderpriority"), none("string")), source="shop")
    landed = facts_of(t.where("o_orderstatus = 'F'"), log_seq=F.col("o_orderkey") + 1_000_000_000, event_id=F.concat(F.lit("act:"), _s("o_orderkey")), subject=subject, facet=F.lit("fulfilment"), effective=eff + DAY, type_=F.lit("ACTIVATED"), value=value(none("double"), none("string"), key), source="shop")
    return sent.unionByName(landed)


def doc_facts(spark: SparkSession, d: str) -> DataFrame:
    """documents, trusted by their labels."""
    t = table(spark, d, "documents").join(table(spark, d, "labels").select(F.col("doc_id").alias("l_id"), "quality"), F.col("doc_id") == F.col("l_id"), "left")
    return facts_of(
        t, log_seq=F.col("doc_id"), event_id=F.concat(F.lit("doc:"), _s("doc_id")), subject=F.concat(F.lit("doc:"), F.col("lang"), F.lit("/"), _s("doc_id")), facet=F.lit("text"), effective=(F.col("doc_id") + 1) * 1_000_000,
        value=F.struct("text", "lang", "source", "n_chars"), confidence=F.coalesce(F.col("quality").cast("double"), F.lit(0.5)), provenance=F.when(F.col("quality").isNotNull(), "SCAN_VERIFIED").otherwise("SYSTEM_FEED"),
    )


def price_facts(spark: SparkSession, d: str) -> DataFrame:
    """A part's price in the catalog, and in the ledger as last sold."""
    p, l = table(spark, d, "part"), table(spark, d, "lineitem")
    value = lambda c: F.struct(c.alias("price"))
    cat = facts_of(p, log_seq=F.col("p_partkey"), event_id=F.concat(F.lit("cat:"), _s("p_partkey")), subject=F.concat(F.lit("part:"), _s("p_partkey")), facet=F.lit("catalog"), effective=F.lit(DAY), value=value(F.col("p_retailprice")), provenance=F.lit("SCAN_VERIFIED"))
    eff = micros("l_shipdate")
    seq = _packed(eff)
    led = facts_of(l, log_seq=seq, event_id=F.concat(F.lit("line:"), F.concat_ws("/", _s("l_orderkey"), _s("l_partkey"), _s("l_suppkey"), _s("l_linenumber"))), subject=F.concat(F.lit("part:"), _s("l_partkey")), facet=F.lit("ledger"), effective=eff, value=value(F.col("l_extendedprice") / F.col("l_quantity")), confidence=F.lit(0.9), provenance=F.lit("HUMAN_ENTRY"))
    return cat.unionByName(led)


def vector_facts(spark: SparkSession, d: str) -> Facts:
    """embeddings: an event each, enriched with its vector."""
    t = table(spark, d, "embeddings")
    facts = facts_of(t, log_seq=F.col("vec_id"), event_id=F.concat(F.lit("vec:"), _s("vec_id")), subject=F.concat(F.lit("vec:"), _s("label"), F.lit("/"), _s("vec_id")), facet=F.lit("embedding"), effective=(F.col("vec_id") + 1) * 1_000_000, value=F.struct("label"))
    enr = t.select(F.col("vec_id").alias("log_seq"), F.concat(F.lit("enr:"), _s("vec_id")).alias("enrichment_id"), F.concat(F.lit("vec:"), _s("vec_id")).alias("target_event"), F.lit("embedding").alias("kind"), F.lit("given").alias("model_id"), F.lit(None).cast("string").alias("text"), F.col("embedding").alias("vector"), F.lit(1.0).alias("confidence"), F.col("vec_id").alias("created_at"))
    return Facts.of(facts, enrichments=enr)


def line_links(spark: SparkSession, d: str) -> DataFrame:
    """An order caused its lines."""
    t = table(spark, d, "lineitem")
    to = F.concat(F.lit("line:"), F.concat_ws("/", _s("l_orderkey"), _s("l_partkey"), _s("l_suppkey"), _s("l_linenumber")))
    return t.select(_packed(micros("l_shipdate")).alias("log_seq"), F.concat(F.lit("order:"), _s("l_orderkey")).alias("from_id"), to.alias("to_id"), F.lit("DISTRIBUTED_AS").alias("type"))


def user_links(spark: SparkSession, d: str) -> DataFrame:
    """Each event of a user triggered the user's next."""
    t = table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = t.select(F.col("event_id").alias("log_seq"), F.concat(F.lit("evt:"), F.lag("event_id").over(w).cast("string")).alias("from_id"), F.concat(F.lit("evt:"), _s("event_id")).alias("to_id"), F.lit("TRIGGERED").alias("type"))
    return e.where("from_id is not null")
