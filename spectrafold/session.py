"""Session settings the operators are written for."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# AQE re-plans joins by measured size and splits skewed join partitions.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Recording a call site per Column costs more than building the plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


# What one task should sort: it fits in executor memory, and 100 TB stay at 200,000 tasks.
SHUFFLE_BYTES = 512 * 1024**2


def configure(
    builder: SparkSession.Builder, input_bytes: int | None = None
) -> SparkSession.Builder:
    """Apply the settings; ``input_bytes`` sizes the shuffles for that much data.

    AQE merges partitions that turn out small but never splits one that a window needs
    whole, so the number to start from has to grow with the data.
    """
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if input_bytes is not None:
        partitions = max(200, -(-input_bytes // SHUFFLE_BYTES))
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
        builder = builder.config("spark.sql.files.maxPartitionBytes", str(SHUFFLE_BYTES))
    return builder


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, the shared folder the cluster names.

    Where that setting is absent, a single-process session gets a local folder; on a cluster
    the executors would not see each other's files there, so it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spectrafold-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    For a small result of costly work that several passes read: the work is done once, the
    plan that follows is short, and a lost executor costs a re-read.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()
_offered: list[tempfile.TemporaryDirectory] = []  # files the driver serves; they stay until it ends


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once an application: they need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).parent
    _offered.append(tempfile.TemporaryDirectory(prefix="spectrafold-"))
    path = os.path.join(_offered[-1].name, "spectrafold.zip")
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, str(source.relative_to(root.parent)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
