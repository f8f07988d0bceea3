"""Session helpers: defaults for local runs, and the shared folder for cut lineage."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: str | int = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and for bench.py. A cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("marketlake")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def use_utc(spark: SparkSession) -> None:
    """All bucket and session arithmetic is defined in UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables.

    The cluster names one in ``spark.checkpoint.dir``. Only where that is unset in a local session, as
    in tests, is a temporary folder made and recorded in the same setting; on a cluster each executor
    would write to its own disk there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="marketlake-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path
