"""Session helpers: one place for the configuration the operators expect."""

from __future__ import annotations

import os
import shutil
import tempfile
from uuid import uuid4

from pyspark import SparkConf, SparkContext
from pyspark.sql import DataFrame, SparkSession


def _given(key: str) -> bool:
    """Whether the submit command already sets ``key``."""
    args = os.environ.get("PYSPARK_SUBMIT_ARGS", "")
    flag = {"spark.master": "--master", "spark.driver.memory": "--driver-memory"}.get(key)
    if f"{key}=" in args or (flag and flag in args):
        return True
    if "PYSPARK_GATEWAY_PORT" in os.environ:  # started by spark-submit: its settings are in the JVM
        SparkContext._ensure_initialized()
        return SparkConf().contains(key)
    return False


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "corpusdelta") -> SparkSession:
    """The active session as it is, else a new one.

    Settings of the submit command stay; only what it leaves unset gets the
    local defaults below (AQE, Arrow, no UI). Arguments count as set.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        ship_package(active)
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    defaults = {
        "spark.master": f"local[{cpus}]",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": cpus,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.driver.memory": os.environ.get("SPARK_DRIVER_MEMORY", "16g"),
    }
    given = {"spark.master": master, "spark.sql.shuffle.partitions": shuffle_partitions and str(shuffle_partitions)}
    builder = SparkSession.builder.appName(app)
    for key, value in defaults.items():
        if given.get(key) or not _given(key):
            builder = builder.config(key, given.get(key) or value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application: the
    driver's import path is not theirs."""
    sc = spark.sparkContext
    if getattr(sc, "_corpusdelta_sent", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="corpusdelta-"), "corpusdelta")
    sc.addPyFile(shutil.make_archive(out, "zip", os.path.dirname(root), os.path.basename(root)))
    sc._corpusdelta_sent = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, which driver and executors share.

    A local session without one gets a scratch folder; a cluster must name one
    in ``spark.checkpoint.dir``, as executors can't share a folder of one
    machine."""
    sc = spark.sparkContext
    cp = spark.conf.get("spark.checkpoint.dir", None)
    if not cp:
        cp = sc.getCheckpointDir()
        if cp:
            return cp
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        cp = tempfile.mkdtemp(prefix="corpusdelta-cp-")
        spark.conf.set("spark.checkpoint.dir", cp)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(cp)
    return cp


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder that nothing has used, in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid4().hex}"


def target_partitions(spark: SparkSession) -> int:
    """Parallelism to spread a text scan over: the shuffle partition count."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


#: Of the planner's size of a text table, what one task's tokens are made of: they
#: are sorted and counted in memory, and take some fifty times as much there.
TASK_BYTES = 4 << 20


def planned_bytes(df: DataFrame) -> int | None:
    """The planner's size of the tables that ``df`` is made of (a join's own size
    is a product), None if it does not know one."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(sizes) if all(size < 1 << 50 for size in sizes) else None


def text_partitions(df: DataFrame) -> int:
    """Partitions for texts and what is made of them: the shuffle partition
    count, and more for large tables, so that a task need not spill."""
    return max(target_partitions(df.sparkSession), -(-(planned_bytes(df) or 0) // TASK_BYTES))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition ``df`` on ``key`` when its input gives fewer splits than
    the cluster's parallelism (a single-file corpus is read as one task).

    The partitioning is on the document id, so every later per-document
    aggregation (``groupBy(doc_id, ...)``) reuses it without another exchange.
    The planner's size estimate decides, so nothing runs here; at scale, when
    the input is already wide, nothing is shuffled.
    """
    spark = df.sparkSession
    size = planned_bytes(df)
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(text_partitions(df), key) if size is not None and size < target_partitions(spark) * split else df


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the session's checkpoint folder and return a
    DataFrame reading it: later jobs (totals, rankings, second passes) reuse
    it instead of recomputing the lineage, and it survives executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Like :func:`cut` for wide or many rows: as compressed Parquet, without
    their order or partitioning."""
    path = new_folder(df.sparkSession, "kept")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
