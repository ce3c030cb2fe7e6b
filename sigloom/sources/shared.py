"""Folders that all executors see."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_local: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir; where that is unset, a local master alone gets one of this machine's."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[.*\])?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="spark-"))
        base = _local[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
