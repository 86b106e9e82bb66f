"""Session settings and lineage cuts shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # distance scans cost far more CPU per byte than the planner assumes
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "32k",
    # the JVM never compiles methods of more bytes than this, so long geometry expressions leave whole-stage code
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # sizes estimated from compressed files and through explode are short by a factor of thousands, so
    # joins broadcast by measured size (or a hint) only
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
    # a table of few scenes fills few partitions; unless it is broadcast the rows of a scene meet in one task
    "spark.sql.adaptive.nonEmptyPartitionRatioForBroadcastJoin": "0",
}


DECIDING = {"spark.sql.session.timeZone", "spark.sql.execution.arrow.pyspark.enabled", "spark.sql.autoBroadcastJoinThreshold"}


def build_session(app: str = "atrium", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings the registered queries rely on, where a session built elsewhere has none of its own.

    Arrow transfer and the time zone decide results and are always set, as is that no join broadcasts by an
    estimate: the caller's limit, if any, holds for measured sizes.  Partition sizes are the caller's.
    """
    own = spark.sparkContext.getConf()
    measured = own.get("spark.sql.autoBroadcastJoinThreshold", DEFAULTS["spark.sql.adaptive.autoBroadcastJoinThreshold"])
    for key, value in {**DEFAULTS, "spark.sql.adaptive.autoBroadcastJoinThreshold": measured}.items():
        if key in DECIDING or not own.contains(key) and not key.endswith("minPartitionSize"):
            spark.conf.set(key, value)
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so that a loop survives lost executors and its plan stays short.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; a private one is made only
    where none is named (local tests).
    """
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def end_round(df: DataFrame) -> DataFrame:
    """What a round of a loop hands to the next: written below the checkpoint folder and read back.

    A checkpoint keeps the estimated size of its plan, and a join's estimate is the product of its
    sides.  In a loop that joins a table with what came from it that number doubles its digits in
    each round, until the driver does nothing but multiply it.  Files have their true size.
    """
    path = scratch_path(df.sparkSession, "round")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """New folder for files a query writes and reads back, below the shared checkpoint folder if one is named."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        return tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/" + name
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}/{name}"
