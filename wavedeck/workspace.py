"""A folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, or in a temporary folder where that is unset and Spark runs in one process."""
    base, master = spark.sparkContext.getConf().get("spark.checkpoint.dir"), spark.sparkContext.master
    if not base and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = base or tempfile.gettempdir()
    return f"{base.rstrip('/')}/wavedeck/{name}-{uuid.uuid4().hex}"
