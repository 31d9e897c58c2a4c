"""Session settings, the shared folder, and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings the engine is tuned for.  None of them changes a result; they are
#: applied by ``build_session`` and left alone in sessions made elsewhere.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}

#: Row bound under which a lookup side may be broadcast.
BROADCAST_ROWS = 200_000


def build_session(app: str = "hushframe", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the engine's settings; ``extra`` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, also used for checkpoints.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session
    without that setting gets a folder of its own.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if current is None:
            context.setCheckpointDir(named)
        return named
    if current is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        context.setCheckpointDir(os.path.join(tempfile.gettempdir(), f"hushframe-{context.applicationId}"))
        current = context.getCheckpointDir()
    return current


def staged_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one staged table below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/staged/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str, root: str | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read again; two readers do not compute it twice.

    With ``root`` it lies in that folder, which whoever made it may drop as a whole.
    """
    path = staged_path(df.sparkSession, name) if root is None else f"{root}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def broadcast_if_small(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only after counting at most ``bound + 1`` rows.

    Larger sides come back without a hint, so the join shuffles on its keys and
    adaptive execution splits skewed partitions.
    """
    if df.limit(bound + 1).count() <= bound:
        return F.broadcast(df)
    return df
