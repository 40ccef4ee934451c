"""Session helpers shared by tests, benches and the query registry."""

from __future__ import annotations

import os
import tempfile

from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 4, app: str = "tidemark", shuffle_partitions: int = 8) -> SparkSession:
    """A session for one machine. On a cluster, bring your own: nothing here is needed."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the cluster's own setting. On a local master, and there alone, a temporary one if none is set."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-checkpoint-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 2000  # of long texts or sets, 10,000 at a time would be a large part of a worker's memory


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and continue from there, so that lost executors cost no replay. The shuffle files that led
    to it are dropped at once, and Python functions get ``BATCH_ROWS`` rows a batch at most. The folder's files go when nothing
    refers to them any more, where the session has ``spark.cleaner.referenceTracking.cleanCheckpoints``, as ``local_session`` has."""
    spark = df.sparkSession
    shared_dir(spark)
    rows = int(spark.conf.get(_BATCH_ROWS))
    wanted = {_DROP_SHUFFLES: "true", _BATCH_ROWS: str(min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        return df.select("*").checkpoint(eager=True)  # planned anew, under these settings
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def unsized(df: DataFrame) -> DataFrame:
    """A DataFrame that ``cut`` gave, without the size that Spark estimates for it. The estimate for a join is the product of its
    sides, also across checkpoints: in a loop that joins a table with itself, the number's digits multiply each time, until
    planning takes minutes."""
    spark = df.sparkSession
    jvm, plan = spark.sparkContext._jvm, df._jdf.logicalPlan()
    none = jvm.scala.Option.empty
    bare = jvm.org.apache.spark.sql.execution.LogicalRDD(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(), spark._jsparkSession, none(), none())
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, bare), spark)


def drop(df: DataFrame) -> None:
    """Deletes the files of a DataFrame that ``cut`` gave, which isn't read again."""
    sc = df.sparkSession.sparkContext
    file = df._jdf.logicalPlan().rdd().getCheckpointFile()
    if file.isDefined():
        path = sc._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def drop_shuffle(rdd: RDD) -> None:
    """Drops the files of the last shuffle that led to ``rdd``, which isn't read again."""
    cleaner = rdd.context._jsc.sc().cleaner()
    work = [rdd._jrdd.rdd()]
    while work and cleaner.isDefined():
        deps = work.pop().dependencies()
        for i in range(deps.size()):
            dep = deps.apply(i)
            if dep.getClass().getSimpleName() == "ShuffleDependency":
                cleaner.get().doCleanupShuffle(dep.shuffleId(), False)
                return
            work.append(dep.rdd())
