"""Session settings, reliable checkpoints and size checks shared by all operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings that every plan here assumes; sizes of partitions are left to AQE.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}


def build_session(app: str = "gristmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS; keyword names use __ for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut df's lineage with a reliable checkpoint in the folder that the session names.

    Only where neither spark.checkpoint.dir nor the context has a folder (as in tests on one
    machine) a temporary one is made. On a cluster without a shared folder this is an error,
    because a machine-local folder would be lost with its machine.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="gristmill-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def broadcast_if_small(df: DataFrame, rows: int, limit: int = 200_000) -> DataFrame:
    """Hint a broadcast only when the counted rows stay within the limit; else the planner shuffles."""
    return F.broadcast(df) if rows <= limit else df
