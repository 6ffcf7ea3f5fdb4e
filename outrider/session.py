"""Session settings that the library's results rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def build_session(app: str = "outrider", master: str | None = None, **more: str) -> SparkSession:
    """A session with UTC times and adaptive execution; ``more`` are further settings."""
    builder = SparkSession.builder.appName(app).config(map={**SETTINGS, **more})
    return (builder.master(master) if master else builder).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """A place for files that the driver and all executors read: under ``spark.checkpoint.dir``, which a cluster must set. It goes when the session's JVM ends."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='outrider-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    folder, jvm = f"{found.rstrip('/')}/{uuid.uuid4().hex}", spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(folder)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(target)
    files.deleteOnExit(target)
    return f"{folder}/files"
