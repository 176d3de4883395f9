"""Session settings and the one way this package cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "kinset", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; ``conf`` keys use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder on this machine; on a
    cluster a missing setting is an error, since executors could not share it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="kinset-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")


def shared_path(spark: SparkSession, name: str) -> str:
    """A path for new files in the checkpoint folder, which all executors reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/kinset-{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and read it back.

    Later rounds then start from files rather than from a growing plan, survive
    lost executors, and plan their joins with the true size. The checkpoint
    folder is one per application and can go when its results are written.
    """
    spark = df.sparkSession
    path = shared_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle_counted(df: DataFrame, which: Column | None = None) -> tuple[DataFrame, int]:
    """``settle``, with the number of rows (or of rows for which ``which`` holds)
    observed while they are written, at no extra job."""
    seen = Observation()
    wanted = F.lit(1) if which is None else F.when(which, 1)
    table = settle(df.observe(seen, F.count(wanted).alias("n")))
    return table, seen.get["n"]


def spread(df: DataFrame) -> DataFrame:
    """At least one partition per core: adaptive execution sizes partitions by
    bytes, too coarse for joins whose work is comparing what little they read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)
