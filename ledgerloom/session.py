"""Session helpers: a session with this engine's settings, and the library's place for Python workers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side up to which it is broadcast.
BROADCAST_ROWS = 200_000


def session(app: str = "ledgerloom", master: str | None = None, **conf) -> SparkSession:
    b = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this library from where the driver has it, unless they already can."""
    root, env = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most so many rows, else unchanged. It is counted, so pass what is cheap to count."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new local one where that is unset and all run in one process."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: By application, the folder in the shared one that holds what this run stages.
_RUNS: dict[str, str] = {}


def run_dir(spark: SparkSession) -> str:
    """This run's own folder in the shared one. The driver's file system deletes it when the session's process ends."""
    app = spark.sparkContext.applicationId
    if app not in _RUNS:
        path = f"{shared_dir(spark)}/ledgerloom-{app}-{uuid.uuid4().hex[:8]}"
        jvm = spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(place)
        fs.deleteOnExit(place)
        _RUNS[app] = path
    return _RUNS[app]


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the run's folder, and read: its plan ends there, and lost executors cost no more than their tasks."""
    spark, schema = df.sparkSession, df.schema
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)
