"""A made-up retailer: prices are sent to four systems, and some of what is sent never lands. Generated on the cluster from
row numbers, so of any size and the same each time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.model import DAY, ENVELOPE, Facts

SYSTEMS = ("register", "handheld", "shelf", "central")
STUCK = 12  # per cent of handheld changes that never land


def price_changes(spark: SparkSession, items: int, stores: int, changes: int = 4, start: int = 1_735_689_600_000_000) -> Facts:
    n = items * stores * changes
    i = F.col("id")
    draw = lambda salt, most: F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(most))
    base = spark.range(n).select(
        i, F.concat(F.lit("item:"), F.lpad((F.floor(i / (stores * changes)) + 100_001).cast("string"), 6, "0"), F.lit("/store:"), (F.pmod(F.floor(i / changes), F.lit(stores)) + 4001).cast("string")).alias("subject"),
        (F.lit(start) + (F.pmod(i, F.lit(changes)) * 45 + draw(1, 10)) * DAY).alias("eff"), (200 + draw(2, 800)).alias("price"), F.when(draw(3, 40) == 0, "PENNY").otherwise("REGULAR").alias("kind"),
        draw(4, 33).alias("fails"), draw(5, 100).alias("stuck"), draw(6, 28).alias("lag"),
    )
    value = lambda activates: F.struct(F.when(F.lit(activates is None), F.col("price")).alias("price_cents"), F.when(F.lit(activates is None), F.col("kind")).alias("kind"), (activates if activates is not None else F.lit(None).cast("string")).alias("activates"))

    def event(rows: DataFrame, nth: int, facet: str, type_: str, at, recorded, activates=None) -> DataFrame:
        cols = {
            "log_seq": i * 16 + nth, "event_id": F.concat(F.lit(f"{type_[0].lower()}:{facet}:"), i.cast("string")), "subject": F.col("subject"), "facet": F.lit(facet), "type": F.lit(type_), "schema_id": F.lit(None).cast("string"),
            "effective_time": at, "recorded_time": recorded, "provenance": F.lit("SYSTEM_FEED"), "confidence": F.lit(1.0), "source_system": F.lit(facet), "source_ref": F.concat(F.lit("batch:"), F.floor(i / 100).cast("string")),
        }
        return rows.select(*[cols[c.split()[0]].cast(c.split()[1]).alias(c.split()[0]) for c in ENVELOPE.split(", ")], value(activates).alias("value"))

    eff = F.col("eff")
    out = event(base, 0, "source", "INTENT", eff, eff - DAY)
    links = None
    for k, s in enumerate(SYSTEMS):
        rows = base.where("fails != 0") if s == "shelf" else base
        sent_id = F.concat(F.lit(f"d:{s}:"), i.cast("string"))
        out = out.unionByName(event(rows, 1 + k, s, "DISTRIBUTED", eff, eff - DAY))
        landed = rows.where(F.col("stuck") >= STUCK) if s == "handheld" else rows
        at = eff if s == "register" else eff + F.col("lag") * DAY
        out = out.unionByName(event(landed, 6 + k, s, "ACTIVATED", at, at, sent_id))
        link = rows.select((i * 16 + 1 + k).alias("log_seq"), F.concat(F.lit("i:source:"), i.cast("string")).alias("from_id"), sent_id.alias("to_id"), F.lit("DISTRIBUTED_AS").alias("type"))
        links = link if links is None else links.unionByName(link)
    return Facts.of(out, links)
