"""Feeds of new facts over a store's folder, as Structured Streaming: nothing is dropped, redelivery is harmless."""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

if TYPE_CHECKING:
    from tidemark.sources.store import FactStore


def stream(spark: SparkSession, path: str, schema: str, files: int = 0) -> DataFrame:
    """A Parquet folder's files as they come, ``files`` at most a batch (0: all there are)."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def watch(store: FactStore, subject: str = "", facet: str = "", type_: str = "", files: int = 0) -> DataFrame:
    """A streaming DataFrame of facts as they are committed, with exact tests on subject, facet and type. Late facts are facts like
    any other: there is no watermark that would lose them."""
    from tidemark.sources.store import FACTS

    out = stream(store.spark, f"{store.path}/data/*/facts", FACTS, files)
    for c, v in (("subject", subject), ("facet", facet), ("type", type_)):
        out = out.where(F.col(c) == v) if v else out
    return out


def changes(store: FactStore, checkpoint: str, sink: Callable[[DataFrame, int], None], files: int = 0) -> StreamingQuery:
    """All that is new since the checkpoint's last run goes to ``sink`` in batches, then the query ends: the checkpoint is the
    cursor. A batch can come twice after a failure, with the same number."""
    return watch(store, files=files).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def apply_once(spark: SparkSession, target: str) -> Callable[[DataFrame, int], None]:
    """A sink that follows another log: each event is written once, whichever batch or peer brings it."""

    def sink(batch: DataFrame, number: int) -> None:
        fresh = batch.withColumn("value", F.to_json("value")).dropDuplicates(["event_id"])
        jvm = spark._jvm.org.apache.hadoop.fs.Path(target)
        if jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm):
            fresh = fresh.join(spark.read.parquet(target).where(F.col("_batch") != number).select("event_id"), "event_id", "left_anti")
        # one folder a batch: a batch that comes again replaces itself
        fresh.write.mode("overwrite").parquet(f"{target}/_batch={number}")

    return sink


def keep_current(spark: SparkSession, target: str) -> Callable[[DataFrame, int], None]:
    """A sink that keeps the open fact of each stream: a batch is folded into the last table, which stays until the new one is
    whole. Only the greatest append number of a stream matters, so that repeated batches change nothing."""

    def sink(batch: DataFrame, number: int) -> None:
        from pyspark.sql import Window

        rows = batch.where("type != 'ACTIVATED'").withColumn("value", F.to_json("value"))
        fs = spark._jvm.org.apache.hadoop.fs.Path(target).getFileSystem(spark._jsc.hadoopConfiguration())
        path = lambda n: spark._jvm.org.apache.hadoop.fs.Path(f"{target}/v{n:012d}")
        done = sorted(s.getPath().getName() for s in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(target)) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(target)) else []
        before = [d for d in done if d < f"v{number:012d}"]
        if before:
            rows = rows.unionByName(spark.read.parquet(f"{target}/{before[-1]}"))
        w = Window.partitionBy("subject", "facet").orderBy(F.desc("log_seq"))
        rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").write.mode("overwrite").parquet(f"{target}/v{number:012d}")
        for d in before[:-1]:
            fs.delete(path(int(d[1:])), True)

    return sink


def ack(store: FactStore, slot: str, position: int, now: int) -> int:
    """Moves a named cursor, kept as a fact, forward; never back. Gives the position that holds."""
    from tidemark.functions.fields import resolve
    from tidemark.operators import temporal

    own = temporal.current(store.facts().where(F.col("subject") == f"slot:{slot}"))
    row = own.select(resolve(own, "position").number).first()
    held = int(row[0]) if row and row[0] is not None else 0
    if position > held:
        store.append([{"subject": f"slot:{slot}", "facet": "cursor", "value": {"position": position}}], now)
        return position
    return held


def since(store: FactStore, position: int, most: int = 0) -> tuple[DataFrame, int, bool]:
    """(facts appended after ``position`` in order, the new position, whether that is all there is); ``most`` facts at most."""
    tip = store.tip()
    top = min(position + most, tip) if most else tip
    rows = store.facts().where((F.col("log_seq") > position) & (F.col("log_seq") <= top)).orderBy("log_seq")
    return rows, top, top == tip
