"""Session, shared scratch folder and lineage cuts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "exprspark", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Folder every executor can reach. The cluster names it in spark.checkpoint.dir; where that is
    unset, a local one is made if driver and executors are one process, else this is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share.")
        current = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    return os.path.join(scratch_root(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def cut(df: DataFrame) -> DataFrame:
    """Write a table into the shared scratch folder once and go on from its files: they outlive
    executors, end the lineage, and give later joins true sizes."""
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def discard(table: DataFrame) -> None:
    """Delete the files of a table that `cut` returned, once everything that reads it has been written."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._scratch)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once per context, so that they need no copy of their own."""
    context = spark.sparkContext
    if getattr(context, "_exprspark_shipped", False):
        return
    package = Path(__file__).parent
    target = os.path.join(tempfile.mkdtemp(prefix="ship-"), "exprspark.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(package.rglob("*.py")):
            archive.write(path, path.relative_to(package.parent))
    context.addPyFile(target)
    context._exprspark_shipped = True
