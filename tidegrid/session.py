"""Session builder with the settings the operators are written for."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def builder(app: str = "tidegrid") -> SparkSession.Builder:
    """UTC, ANSI, adaptive execution with skew joins; everything else is left to the cluster."""
    return (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only a session that runs in one process, as in tests, gets one made where
    none is named; anywhere else that is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = sc._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else None
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="tidegrid_")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


#: Bytes of one Arrow batch between Spark and its Python workers. By rows alone a batch of long texts has no bound.
BATCH_BYTES = 4_000_000


def bounded_batches(spark: SparkSession) -> None:
    """Let the session hand texts to Python workers in batches of bounded bytes; a smaller bound in plain bytes stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"([0-9]+)b?", spark.conf.get(key) or "")
    if not now or int(now[1]) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def settled(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the shared folder: its rows are fixed, its lineage is cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
